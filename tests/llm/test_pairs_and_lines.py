"""Jaccard join, line dedup and decontamination against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from stepquery.llm import bloom, decontaminate, jaccard_join, line_dedup, words

from .conftest import ODD, frame, prose


def near(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    base = prose(1, 150)
    rows = [(i, prose(100 + i, 40 + 7 * i)) for i in range(20)]
    rows += [(100 + i, near(base, i, i % 6)) for i in range(40)]  # one family, some too far from its centre
    rows += [(200 + i, base) for i in range(15)] + [(300 + i, near(prose(2, 80), i, 1)) for i in range(5)]
    chain = prose(3, 200).split()
    rows += [(400 + i, " ".join(chain[4 * i :] + [f"tail{k}" for k in range(4 * i)])) for i in range(6)]  # linked one to the next only
    return rows + ODD


def brute(rows, n, percent):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [k for k in sets if rows[k][0] is not None and sets[k]]
    for a in keys:
        for b in keys:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return sorted((i is None, i or 0, len(sets[k]), -1 if i is None else find(i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components(spark, corpus, n, percent):
    got = jaccard_join.components(frame(spark, corpus), words=n, percent=percent).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(corpus, n, percent)


@pytest.mark.parametrize(("tokens", "members"), [(900, 256), (2_000_000, 3), (300, 1)])
def test_blocks_lose_no_link(spark, corpus, monkeypatch, tokens, members):
    monkeypatch.setattr(jaccard_join, "FAMILY_TOKENS", tokens)
    monkeypatch.setattr(jaccard_join, "FAMILY_MEMBERS", members)
    got = jaccard_join.components(frame(spark, corpus, False)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(corpus, 4, 85)


@pytest.mark.parametrize("first", [4, 0.25])
def test_tokens_are_sent_to_one_family(spark, monkeypatch, first):
    """Texts of few words share tokens with many others by chance; groups of them are dealt out in blocks where `first` is small."""
    few = [f"w{i}" for i in range(12)]
    rows = [(i, prose(700 + i, 150 + 9 * i, few)) for i in range(50)]
    rows += [(100 + i, near(t, i, i % 9)) for i, t in rows[::3]]
    written, write = {}, jaccard_join.materialize

    def recorded(df, name, *more):
        written[name] = write(df, name, *more)
        return written[name]

    monkeypatch.setattr(jaccard_join, "materialize", recorded)
    if first < 1:
        monkeypatch.setattr(jaccard_join, "FAMILY_MEMBERS", 40)
        monkeypatch.setattr(jaccard_join, "FIRST", first, raising=False)
    got = jaccard_join.components(frame(spark, rows, False)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)
    sent = written["families"].collect()
    assert len({(r.s1, r.s2) for r in sent}) == len(sent) > 10
    assert sum(r.n for r in sent) < 0.7 * sum(r.n_shingles for r in got)
    assert ("accompanied" in written) == (first < 1)


def test_ties_join_what_may_be_similar():
    r = np.random.default_rng(5)
    base = r.integers(1, 1 << 63, 400, np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(400) < keep], r.integers(1, 1 << 63, extra, np.uint64)])) for keep in (1, 0.97, 0.93, 0.9, 0.5) for extra in (0, 10, 30, 60)]
    sizes = np.array([len(s) for s in sets])
    first = [s[: jaccard_join.screen_length(len(s), 85)].astype(np.uint32) for s in sets]
    for side in (np.zeros(len(sets), np.int64), np.arange(len(sets)) % 2):
        label = list(range(len(sets)))
        for a, b in jaccard_join.ties(first, sizes, side, 85):
            label = [label[a] if x == label[b] else x for x in label]
        for a in range(len(sets)):
            for b in range(a):
                if side.any() and side[a] == side[b]:
                    continue
                inter = len(np.intersect1d(sets[a], sets[b]))
                assert label[a] == label[b] or not jaccard_join.similar(inter, len(sets[a]), len(sets[b]), 85)


def test_keep_one(spark, corpus):
    df = frame(spark, corpus)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, i, _, c in brute(corpus, 4, 85) if c >= 0}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_an_id_with_several_texts_links_them(spark):
    a, b, c, d = (prose(40 + k, 60) for k in range(4))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (5, c), (5, ""), (5, d), (6, d), (7, ""), (7, None), (8, prose(45, 60))]
    df = frame(spark, rows)
    got = jaccard_join.components(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert sorted(r.doc_id for r in jaccard_join.keep_one(df).collect()) == [1, 4, 7, 8]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard_join.components(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert decontaminate.find(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_star_steps(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.root for r in jaccard_join.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 90, 95: 90}


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """with many shuffle partitions a round of a few edges wrote a file for each of them."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100 + k, 200) for k in range(40)], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = jaccard_join.connected(edges)
        assert len(got.inputFiles()) == 1
        assert {r.node: r.root for r in got.collect()} == {k: 0 for k in range(1, 61)} | {k: 100 for k in (*range(101, 140), 200)}
        monkeypatch.setattr("stepquery.llm.common.ROWS_A_FILE", 50)  # larger tables keep several
        several = jaccard_join.connected(edges)
        assert 1 < len(several.inputFiles()) <= 8 and several.count() == 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@settings(max_examples=60, deadline=None)
@given(st.text("aB c\n\t.é", max_size=60))
def test_word_hashes(text):
    data = text.encode()
    h, start, end = words.split(data)
    assert [data[a:b] for a, b in zip(start, end, strict=True)] == data.split()
    assert len(set(h.tolist())) == len(set(data.split()))
    low = words.split(data, fold=True)[0]
    assert low.tolist() == words.split(data.lower())[0].tolist()


def test_long_words():
    data = b"Ab " * 100_000 + b"x" * 600_000 + b" cd\n" + b"y" * 200_000 + b" cd"
    h, start, end = words.split(data)
    assert [len(w) for w in data.split()] == (end - start).tolist() and h[-1] == h[-3] and h[0] == h[99_999]


def test_bloom(spark):
    values = spark.range(5000).selectExpr("xxhash64(id) as v")
    f = bloom.build(values, "v")
    known = np.array([r.v for r in values.collect()])
    assert f.has(known).all() and f.has(known + 1).mean() < 0.05


# -- lines ------------------------------------------------------------------------------------------------------------
def spread(passage, text, at):
    w = text.split()
    return " ".join([*w[:at], passage, *w[at:]])


def test_passages_go_from_later_documents(spark):
    passage = prose(7, 70)
    rows = [(i, prose(500 + i, 120)) for i in range(12)]
    rows = [(i, spread(passage, t, 13 * i % 100)) if i in (2, 5, 9) else (i, t) for i, t in rows]
    rows += [(20, rows[4][1]), (21, passage + "\n" + passage), *ODD]
    out = line_dedup.dedup(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "n", "lang", "key", "words_deleted"]
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].text == rows[2][1] and by[2].words_deleted == 0
    for i in (5, 9):
        assert passage not in by[i].text and 40 <= by[i].words_deleted <= 70 and by[i].text.split()[0] == rows[i][1].split()[0]
    assert by[20].text == "" and len(by[21].text.split()) < 24
    for i, t in rows[:12]:
        if i not in (2, 5, 9):
            assert by[i].text == t
    for i, t in ODD:
        if i is not None and i != 906:
            assert by[i].text == t
    assert out.count() == len(rows)


def test_line_dedup_with_clashing_names_and_odd_ids(spark):
    text = prose(3, 60)
    names = "doc_id, text, doc, version, spans, _0_1, Words_deleted2"
    df = spark.createDataFrame([(i, text, 1, 2, 3, 4, 5) for i in (4, 2)], "doc_id int, text string, doc int, version int, spans int, _0_1 int, Words_deleted2 int")
    out = line_dedup.dedup(df)
    assert out.columns == [*names.split(", "), "words_deleted"]
    assert {(r.doc_id, r.text, r.doc, r.spans, r.words_deleted) for r in out.collect()} == {(2, text, 1, 3, 0), (4, "", 1, 3, 60)}
    with pytest.raises(TypeError, match="whole numbers"):
        line_dedup.dedup(spark.createDataFrame([("a", text)], "doc_id string, text string"))


def test_windows_are_shared_and_winnowed():
    made = line_dedup.Windows(32)
    a, b = prose(1, 200), spread(prose(1, 200), prose(9, 90), 33)
    text, first, last, prints, h1, h2 = made.of([a.encode(), b"", b.encode()])
    keys = list(zip(h1.tolist(), h2.tolist(), strict=True))
    x, y = set(np.array(keys)[text == 0][:, 0]), set(np.array(keys)[text == 2][:, 0])
    assert len(x & y) > 0.7 * len(x) and set(text.tolist()) == {0, 2}
    assert len(np.unique(prints[text == 0])) < 0.6 * (text == 0).sum()  # fingerprints are fewer than windows
    at: dict = {}
    assert all(at.setdefault(k, p) == p for k, p in zip(keys, prints.tolist(), strict=True))
    data = [a.encode(), b"", b.encode()]
    assert all(len(data[t][f:e].split()) >= 32 for t, f, e in zip(text.tolist(), first.tolist(), last.tolist(), strict=True))
    assert first[text == 0].min() == 0 and last[text == 0].max() == len(data[0])
    alone = made.of([b.encode()])
    assert all((u == v[text == 2]).all() for u, v in zip(alone[1:], (first, last, prints, h1, h2), strict=True))


def test_least_at_takes_the_leftmost():
    x = np.random.default_rng(0).integers(0, 9, 300).astype(np.uint64) << np.uint64(32)
    for width in (1, 2, 5, 21, 32):
        assert line_dedup.least_at(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]


def test_merge_joins_spans_of_one_text():
    r = np.random.default_rng(1)
    rows = sorted({(int(d), int(v), int(a), int(a + n)) for d, v, a, n in zip(r.integers(0, 3, 99), r.integers(0, 2, 99), r.integers(0, 60, 99), r.integers(1, 6, 99), strict=True)})
    got = set()
    for d, v, a, b in zip(*(c.tolist() for c in line_dedup.merge(*(np.array(c) for c in zip(*rows, strict=True)))), strict=True):
        got |= {(d, v, i) for i in range(a, b)}
        assert (d, v, b) not in got and not any(x[0] == d and x[1] == v and x[2] <= a - 1 < x[3] for x in rows)
    assert got == {(d, v, i) for d, v, a, b in rows for i in range(a, b)}


def test_without():
    text = "Keep this. Drop all of this.\nAnd keep é that."
    a = text.encode().index(b"Drop")
    assert line_dedup.without(text, [(a, a + 17)]) == "Keep this.\nAnd keep é that."


# -- benchmark --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def items():
    return [(i, prose(2000 + i, 16 + 3 * i)) for i in range(40)] + [(50, "Short. Yes."), (51, ""), (52, None)]


def test_leaks_and_clean(spark, items):
    docs, want = [], set()
    for i in range(60):
        text = prose(4000 + i, 300 + i)
        if i % 3 == 0:
            k = i % 40
            text = spread(items[k][1], text, (i * 17) % 290)
            want.add((i, k))
        if i % 10 == 1:  # half an item is no leak
            half = items[i % 40][1].split()
            text = spread(" ".join(half[: len(half) // 2]), text, 20)
        docs.append((i, text))
    docs.append((70, "Before. " + items[5][1].upper().replace(" ", "  ") + "! After"))
    want.add((70, 5))
    docs += ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    found = decontaminate.find(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 and r.bm25 > 0 for r in found)
    parts = decontaminate.find(df, bench, part_bytes=900)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == want
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_parts_find_what_one_index_finds(spark, items):
    docs = [(i, spread(items[i][1], prose(7000 + i, 260), 11 * i % 250)) for i in range(40)] + ODD
    bench, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs)
    one, parts = (sorted(map(tuple, decontaminate.find(df, bench, part_bytes=b).collect()), key=str) for b in (decontaminate.PART_BYTES, 900))
    assert one == parts and len(one) > 5


def test_search_equals_brute_force(items):
    x = decontaminate.index(items)
    texts = [prose(6000 + i, 90 + 11 * i) + " " + (items[i][1] if i % 2 else " ".join(items[i][1].split()[:9])) for i in range(12)]
    ids = [np.array([x.terms.get(w, -1) for w in decontaminate.words_of(t)], np.int64) for t in texts]
    want = set()
    for d, t in enumerate(ids):
        for first in range(0, len(t), x.half):
            for i, own in enumerate(x.own):
                score = sum(own.get(int(v), 0) for v in np.unique(t[first : first + 2 * x.half]))
                if own and score >= x.least[i] * (1 - 1e-9):
                    want.add((d, first, i))
    assert {(d, f, i) for d, f, i, _ in decontaminate.search(x, ids)} == want and want


def brute_find(docs, items):
    """Every passage against every item, by the formulas alone."""
    bags = [Counter(decontaminate.words_of(t or "")) for _, t in items]
    df, sizes = Counter(w for b in bags for w in b), [sum(b.values()) for b in bags]
    mean, half = max(1.0, sum(sizes) / len(sizes)), max(decontaminate.HALF, *sizes)
    own = [{w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * s / mean)) for w, n in b.items()} for b, s in zip(bags, sizes, strict=True)]
    out = {}
    for d, text in docs:
        w = decontaminate.words_of(text or "")
        for first in range(0, max(1, len(w)), half):
            passage, near = set(w[first : first + 2 * half]), w[max(0, first - half) : first + 3 * half]
            for (item, t), o in zip(items, own, strict=True):
                score = sum(x for v, x in o.items() if v in passage)
                if o and score >= sum(o.values()) / 2 * (1 - 1e-9):
                    q, a = (len(p & decontaminate.shingles(near, min(5, len(next(iter(p)))))) / len(p) for p in map(decontaminate.shingles, map(decontaminate.words_of, decontaminate.parts(t))))
                    if q >= 0.8 and a >= 0.8:
                        out[d, item] = max(out.get((d, item), (0, 0, 0)), (score, q, a))
    return out


def test_find_equals_brute_force(spark, items):
    short = [(100, "ends here. now"), (101, "ba"), (102, None), (103, ""), (104, items[3][1] + " " + items[4][1])]
    bench = [*items, *short]
    docs = [(i, spread(bench[i % len(bench)][1] or "", prose(7500 + i, 40 + 9 * i), 7 * i % 40)) for i in range(60)] + [x for x in ODD if x[0] not in (None, 907)]
    want = brute_find(docs, bench)
    table = spark.createDataFrame(bench, "item_id short, text string")
    for part_bytes, n in ((decontaminate.PART_BYTES, 1), (2000, 3), (700, 2)):
        found = decontaminate.find(frame(spark, docs).repartition(n), table, part_bytes=part_bytes).collect()
        got = {(r.doc_id, r.item_id): (r.bm25, r.question_overlap, r.answer_overlap) for r in found}
        assert got.keys() == want.keys() and len(want) > 30 and len(found) == len(got)
        assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_bounds_by_tiles(items):
    x = decontaminate.index(items)
    ids = [np.array([x.terms.get(w, -1) for w in decontaminate.words_of(prose(6100 + i, 400) + items[i][1])], np.int64) for i in range(9)]
    small, some, all_ = (sorted(decontaminate.search(x, ids, tile=t)) for t in (1, 7, decontaminate.TILE))
    assert small == some == all_ != []
    assert len(x.block) <= len(x.item)


def test_no_benchmark_finds_nothing(spark):
    df = frame(spark, [(1, "text of some words")])
    assert decontaminate.find(df, spark.createDataFrame([], "item_id long, text string")).columns == ["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"]
    assert decontaminate.clean(df, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 1


# -- runs that repeat inside one document -----------------------------------------------------------------------------
def test_a_block_repeated_in_one_document_only(spark):
    block = prose(31, 20)
    rows = [(1, " ".join([block] * 12)), (2, prose(32, 90)), (3, prose(33, 40) + " " + "\n".join([prose(34, 9)] * 15) + " " + prose(35, 40))]
    by = {r.doc_id: r for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert by[1].words_deleted >= 180 and by[1].text.startswith(block)
    assert by[2].words_deleted == 0 and by[3].words_deleted >= 60
    assert by[3].text.startswith(rows[2][1][:80]) and by[3].text.endswith(rows[2][1][-80:])


def brute_runs(rows, least=line_dedup.MIN_WORDS):
    """Words that are left of each row, and how many go: every run of at least `least` words that occurs earlier by (id, position)."""
    at, split = {}, [(t or "").encode().split() for _, t in rows]
    place = [(i is None, i or 0) for i, _ in rows]
    for p, w in zip(place, split, strict=True):
        for j in range(len(w) - least + 1):
            k = tuple(w[j : j + least])
            at[k] = min(at.get(k, (p, j)), (p, j))
    out = []
    for p, w in zip(place, split, strict=True):
        gone = {j + d for j in range(len(w) - least + 1) if at[tuple(w[j : j + least])] < (p, j) for d in range(least)}
        out.append((*p, b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(gone)))
    return sorted(out)


def cut_corpus():
    """Passages of 22 to 70 words in the middle of lines, twice in a text, back to back, and inside copies with edits."""
    r, rows = random.Random(5), []
    for k, n in enumerate((22, 23, 24, 25, 30, 40, 51, 51, 51, 51, 55, 60, 70)):
        for j in range(3):
            rows.append((10 * k + j, spread(prose(700 + k, n), prose(800 + 10 * k + j, 150), r.randrange(150))))
    base = prose(61, 400)
    rows += [(200 + i, near(base, i, 3 * i)) for i in range(8)] + [(220 + i, base) for i in range(2)]
    rows += [(230, " ".join([prose(62, 7)] * 30)), (231, "\n".join([prose(63, 45)] * 3)), (232, "go " * 80 + "stop"), (233, " ".join(["tick", "tock"] * 60))]
    rows += [(234, spread(prose(64, 51), spread(prose(64, 51), prose(65, 90), 70), 20)), (235, prose(66, 200) + "\n\n" + prose(67, 50)), (236, prose(67, 50) + "  " + prose(66, 200).replace(" ", "  "))]
    return rows + [(None, prose(68, 60)), (240, prose(68, 60)), *ODD]


def test_lines_equal_brute_force(spark):
    rows = cut_corpus()
    want = brute_runs(rows)
    for parts in (1, 7):
        out = line_dedup.dedup(frame(spark, rows).repartition(parts)).collect()
        got = sorted((r.doc_id is None, r.doc_id or 0, " ".join(x.decode() for x in (r.text or "").encode().split()), r.words_deleted) for r in out)
        assert got == want
    by = {r[1]: r for r in want}
    assert all(by[10 * k + 1][3] >= 51 for k in range(6, 13)) and by[21][3] >= 24 and by[11][3] == 0 and by[230][3] > 150 and by[0][3] == by[1][3] == 0


def test_pipeline_rows_equal_brute_force(spark):
    import corpus_pipeline as c

    rows = cut_corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    stages, want = dict(c.STAGES), [(None if null else i, t, gone) for null, i, t, gone in brute_runs(rows)]
    want = [(i, t) for i, t, gone in want if t or not gone]

    def rows_of(df):
        return sorted((r.doc_id is None, r.doc_id or 0, " ".join(x.decode() for x in (r.text or "").encode().split())) for r in df.collect())

    lines = stages["line dedup"](spark, docs, "")
    assert rows_of(lines) == sorted((i is None, i or 0, t) for i, t in want)
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())
    first = {i for _, i, _, component in brute(want, c.NEAR_WORDS, c.NEAR_PERCENT) if component == i}
    left = {(False, i, t) for i, t in want if i in first} | {(True, 0, t) for i, t in want if i is None}
    assert rows_of(stages["near copies"](spark, lines, "")) == sorted(left) and len(left) < len(want)
