"""BPE, sharding, WARC, HTML, audio, quality and chat against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepquery.llm import audio, bpe, chat, common, html, quality, shard, warc

from .conftest import ODD, frame, prose

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


# -- BPE --------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [*ODD, (1, prose(1, 4000)), (2, "  a" * 700 + " " * 900 + "b" * 3000 + "'re x" * 300), (3, "<|endoftext|> \n\n \t ok")]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (200, 40), (64, 8)])
def test_bpe(spark, tiktoken_encoding, chunk, overlap):
    got = bpe.encode(frame(spark, TEXTS), VOCABULARY, P.PATTERN, chunk=chunk, overlap=overlap)
    want = sorted((i is None, i or 0, tiktoken_encoding.encode_ordinary(t or "")) for i, t in TEXTS)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in got.collect()) == want
    back = bpe.decode(got, VOCABULARY, P.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in TEXTS)


def test_stitching_a_run_without_boundaries_is_linear(tiktoken_encoding):
    tok, cut = bpe.Tokenizer(open(VOCABULARY, "rb").read(), P.PATTERN), 0

    def ends(text):
        nonlocal cut
        cut += len(text)
        return tok.ends(text)

    text = "a" * 200_000 + " b c d" * 50
    parts = [(s, x, tok.ends(x)) for s, x in bpe.chunks_of(text, 1000, 50)]
    pieces = bpe.stitch(parts, ends)
    assert cut < 4 * len(text) and "".join(p[1] for p in pieces) == text
    assert [int(e + s) for s, _, es in pieces for e in es] == tok.ends(text).tolist()


def test_row_names_do_not_depend_on_order():
    rows = [(1, "a"), (2, "a"), (1, "a"), (1, "b"), (None, "a")]
    names = []
    for order in (rows, rows[::-1]):
        seen = Counter()
        names.append(sorted((str(r), bpe.row_name(seen, 3, *r)) for r in order))
    assert names[0] == names[1] and len({n for _, n in names[0]}) == len(rows)


def test_bpe_digest(spark, tiktoken_encoding):
    for r in bpe.encode(frame(spark, [(i, t) for i, t in TEXTS if i not in (None, 907)]), VOCABULARY, P.PATTERN, result="digest", chunk=300, overlap=30).collect():
        text = dict(TEXTS)[r.doc_id] or ""
        ids = tiktoken_encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode(frame(spark, []), VOCABULARY, P.PATTERN).count() == 0


# -- shards -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("per", "rows"), [(256 << 20, None), (900, None), (400, "hot")])
def test_shards(spark, per, rows):
    data = [(i, prose(i, 5 + i % 40)) for i in range(600)] + ODD
    if rows == "hot":  # a third of all rows are one text
        data += [(5000 + i, "the same text again") for i in range(300)]
    df = frame(spark, data).repartition(7)
    out = shard.shard(df, bucket_bytes=per)
    assert out.columns[:5] == df.columns
    got = out.collect()
    assert len(got) == len(data) and {r.shard for r in got} <= set(range(16))
    size = np.bincount([r.shard for r in got], [r["size"] for r in got], 16)
    largest = max(len((t or "").encode()) + 1 for _, t in data)
    assert abs(size - size.mean()).max() <= 2 * largest + 0.01 * size.mean()
    if rows == "hot":
        assert abs(size[:16] - size.mean()).max() <= 2 * largest
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r["size"] == len((r.text or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None for r in got)


def test_probes_of_a_bracket_are_bounded(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) as h", "id as i", "1L as size").repartition(64)
    whole = [((shard.LOW, shard.LOW), ((1 << 63) - 1, (1 << 63) - 1))]
    found = shard._sample(keys, whole, 10, 64)
    assert len(found) == 10 and found == shard._sample(keys, whole, 10, 64)
    s = shard.splitters(keys, 4, 1000)
    assert s.per_shard == 5 and abs(np.diff([0, *s.rows, 20_000]) - 1000).max() <= 2


def test_shards_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, prose(i, 9), 1, 2, 3, 4, 5) for i in range(20)], "doc_id int, text string, _h int, _i int, _b int, _0_1 int, _p int")
    out = shard.shard(df, shards=3)
    assert out.columns[:7] == df.columns and {(r._h, r._i, r._b, r._0_1, r._p) for r in out.collect()} == {(1, 2, 3, 4, 5)}
    with pytest.raises(TypeError, match="whole numbers"):
        shard.shard(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_shards_empty(spark):
    assert shard.shard(frame(spark, [])).count() == 0
    assert [r.slot for r in shard.shard(frame(spark, [(1, None)])).collect()] == [0]


def test_bucket_of():
    r = np.random.default_rng(1)
    h, i = r.integers(0, 5, 300), r.integers(0, 9, 300)
    probes = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 5, 20), r.integers(0, 9, 20), strict=True)})
    ph, pi = (np.array([p[k] for p in probes]) for k in (0, 1))
    assert shard.bucket_of(h, i, ph, pi).tolist() == [sum(p < (a, b) for p in probes) for a, b in zip(h, i, strict=True)]


# -- WARC -------------------------------------------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    pages = [(i, f"http://h{i % 3}.example/{i}\nx", f"<p>{prose(i % 20, 60)}</p>") for i in range(60)] + [(70, None, None), (71, "u", ""), (72, "u", None), (None, "v", "only here"), (72, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archives = warc.write(df, f"file://{tmp_path}/a", archive_bytes=6000)
    uris = [r.archive for r in archives.collect()]
    assert len(uris) > 3
    for uri in uris:
        head = open(uri.removeprefix("file://"), "rb").read(8)
        assert int.from_bytes(head[:4], "little") == 0x184D2A5D
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    got = warc.read(archives).collect()
    assert len(got) == len(pages)
    for r in got:
        text = next(h or "" for i, _, h in pages if i == r.page_id)
        f = first.get(text, r.page_id)
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == f else ("revisit", f))
        assert bytes(r.payload) == (text.encode() if r.record_type == "response" else b"")
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_every_archive_is_read_by_a_task(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", prose(i, 300)) for i in range(200)], "page_id long, url string, html string").repartition(4)
    archives = warc.write(df, f"file://{tmp_path}/a", archive_bytes=20_000)
    n = archives.count()
    parts = warc.read(archives).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum(F.length("payload")).alias("n")).collect()
    assert n > 8 and len(parts) == n and max(r.n for r in parts) < 40_000


def test_records_are_separate_frames(tmp_path):
    import zstandard

    a = warc.Archive(f"file://{tmp_path}/x.warc.zst")
    data = [warc.record(i, "u", prose(i, 200).encode(), i, False) for i in range(40)]
    for d in data:
        a.add(d)
    a.close()
    raw = open(f"{tmp_path}/x.warc.zst", "rb").read()
    n = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    rest, frames = raw[8 + n :], []
    while rest:
        o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        got = o.decompress(rest)
        frames.append(got)
        rest = o.unused_data
    assert frames == data and len(raw) < sum(map(len, data))


# -- shared folder ----------------------------------------------------------------------------------------------------
def test_scratch_tables_go(spark):
    with common.scratch(spark):
        gone, kept = (common.materialize(spark.range(3), "scratch-test", keep=k) for k in (False, True))
        assert gone.count() == kept.count() == 3
        files = gone.inputFiles()
    assert kept.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_no_local_folder_on_a_cluster():
    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_root(Session)
    Session.conf = {"spark.master": "local[2]"}
    assert common.shared_root(Session) == common.LOCAL_ROOT


# -- HTML -------------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="x">
<header><h2>Site</h2></header><nav><ul><li><a href=a>Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">Cookies?</div>
<div class="wrap"><div class="post-%d body"><h1>Title &amp; more</h1><p>First <b>bo</b>ld<br>line.<p>Second&nbsp;&#x41; < 3 <script>x</script>part
here</p><aside>Aside</aside><form><input value=z>Form</form><p style="display: none">hidden</p><ul><li>one<li>two</ul></div>
<div class="comments"><p>A very long comment of some reader that is longer than all of the article itself, really, on and on and on and on it goes without an end.</p></div></div>
<div class="sidebar">Side</div><footer>Foot</footer></body></html>"""
MAIN = "Title & more First bold line. Second A < 3 part here one two"


def test_extract():
    assert html.extract(PAGE % 1, None) == MAIN
    assert html.extract("<article><p>cut off", None) == "cut off"
    assert html.extract("no markup &lt;at all&gt;", None) == "no markup <at all>"
    assert html.extract("<script>x", None) == html.extract("<nav>only</nav>", None) == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>one</p><video-player></video-player><svg-icon name=a></svg-icon><p>two</p></article>", "one two"),
        ("<main><title-bar>bar</title-bar><p>two</p><select-menu><p>three</p></select-menu></main>", "bar two three"),
        ("<p>a<svg/>b</p><p>c<math/></p><p>d</p>", "ab c d"),
        ("<article><p>one<video src=x></p><p>two</p></article>", "one two"),
        ("<article><p>one<svg><path d=1><p>two</p></article>", "one two"),
        ("<article><ul><li>a<audio src=x><li>b</ul><div><select><option>no</div><p>c</p></article>", "a b c"),
        ("<article><p>one</p><iframe src=x><p>two</p></article>", "one two"),
        ("<div><object data=x>no</div><p>two</p>", "two"),
        ("<p>a<svg><title/><style>p>q{}</style><path d=1 /><text>no</text></svg>b<canvas>no</canvas>c</p>", "abc"),
        ("<p>a</p><svg><foreignObject><div>no</div></foreignObject></svg><template><p>no</p></template><p>b<script>x</SCRIPT >c</p>", "a bc"),
        ("<p>a</p><noscript><p>no</p></noscript><textarea>no</p>", "a"),
    ],
)
def test_dropped_elements_end(page, text):
    assert html.extract(page, None) == text


def test_the_heading_of_an_article_is_text():
    inside = '<header class="page-header">Site</header><article><header class="entry-header"><h1 class="header">Title</h1></header><p>a</p><div class="share-box">no</div><footer>no</footer></article>'
    assert html.extract(inside, None) == "Title a"
    assert html.extract('<div><h2 class="post-header">Head</h2><div class="header">no</div><p>text of some length</p></div>', None) == "Head text of some length"


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<a " * 350_000 + ">", '<a "' * 250_000, "<a \">\"" * 200_000, "<script>" + "</script " * 100_000, "<b>" * 50_000 + "<h1></h1>" * 50_000, "<div>" * 100_000 + "</x>" * 100_000, "<nav><svg>" + "<i>" * 90_000, "<ul>" * 50_000 + "<li>" * 50_000, "<!-- " * 200_000],
    ids=["open", "last closes", "quotes", "quoted ends", "raw", "scopes", "unknown ends", "foreign", "lists", "comments"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.extract(page, "/html/body/div")
    assert time.process_time() - began < 30


def test_deep_pages_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    assert html.extract("<div>" * 100_000 + "deep text", None) == "deep text"
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20


def test_consensus_equals_a_plain_count(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()[:120]
    rows = [(r.page_id, f"http://h{r.page_id % 7}.example/", r.html.replace("<article>", f'<div class="c{"x" * (r.page_id % 3)} n{r.page_id}">') if r.page_id % 5 else r.html) for r in rows]
    votes: dict = {}
    for i, _, x in rows:
        page = html.parse(x)
        choice, weight = html.best(page)
        if choice >= 0:
            of = votes.setdefault(f"h{i % 7}.example", {})
            of[page.path(choice)] = of.get(page.path(choice), 0) + weight
    want = {h: max(v, key=lambda p: (round(v[p], 6), p)) for h, v in votes.items()}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.host: r.path for r in html.consensus(df).collect()} == want and len(want) == 7
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == {i: html.extract(x, want[f"h{i % 7}.example"]) for i, _, x in rows}


def test_consensus(spark):
    pages = [(i, "http://Host.example:80/a", PAGE % i) for i in range(6)]
    # alone, the other box would win on this page; its host knows better
    pages.append((6, "https://user@host.example:80/b", f'<body><div class="wrap"><div class="post-9 body"><p>short</p></div></div><div class="more"><p>{prose(1, 90)}</p></div></body>'))
    pages += [(7, None, f"<main><p>{prose(2, 9)}</p></main>"), (8, "not a url", None), (9, "http://host.example:80/x", "")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, path int")
    for limit in (1 << 20, 0):
        got = {r.page_id: r.text for r in html.main_text(df, broadcast=limit).collect()}
        assert got == {**{i: MAIN for i in range(6)}, 6: "short", 7: prose(2, 9), 8: "", 9: ""}
    assert html.main_text(df.limit(0)).count() == 0


# -- audio ------------------------------------------------------------------------------------------------------------
def test_audio(spark):
    rows = [*ODD, (1, "x" * 64), (2, prose(5, 9000)), (3, prose(5, 9000))]
    got = audio.features(audio.store(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id not in (None, 907):
            data = (dict(rows)[r.doc_id] or "").encode()
            full = data + bytes(-len(data) % 64 or (0 if data else 64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
            assert r.media_bytes == len(full) + 44 and r.media_sha256 == hashlib.sha256(audio.wav(full)).hexdigest()
            table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
            assert table.schema.field("logmel").type.shape == [audio.FRAMES, audio.MELS] and sum(table["frames"].to_pylist()) == r.frames
            assert table["end_ms"][-1].as_py() >= table["start_ms"][-1].as_py()
    by = {r.doc_id: r for r in got}
    assert bytes(by[2].tensors) == bytes(by[3].tensors) and by[2].spans_ms == by[3].spans_ms and by[2].frames > 100
    assert audio.store(frame(spark, [])).count() == 0


def test_resampling_is_the_naive_sum():
    x = np.random.default_rng(0).normal(size=301).astype(np.float32)
    up, down, h = audio.phases()
    taps = h[:, ::-1].T.reshape(-1)  # the whole filter
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    want = np.convolve(stuffed, taps)[: len(stuffed)][::down]
    assert np.allclose(audio.resample(x), want, atol=1e-4)


def test_hysteresis():
    e = np.array([0, 0, 1, 2, 1, 0, 1, 0, 0, 3, 0, -1, 0, 1], float)
    want, k = [], 0
    low, high = e >= np.median(e) + audio.CLOSE_DB, e >= np.median(e) + audio.OPEN_DB
    while k < len(e):
        j = k
        while j < len(e) and low[j]:
            j += 1
        if high[k:j].any():
            want.append([k, j - 1])
        k = max(j, k) + 1
    assert audio.active(e).tolist() == want


# -- quality ----------------------------------------------------------------------------------------------------------
def test_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, most=300)
    assert len(model.label) <= 300
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    right = np.mean([(r.score >= 0.3) == (r.quality == 1) for r in got])
    assert len(got) > 50 and right > 0.95
    odd = {r.doc_id: r.score for r in quality.score(frame(spark, ODD), model).collect()}
    assert odd[900] == odd[901] == odd[902] == 0 and all(0 <= s <= 1 for s in odd.values())
    kept = quality.keep(frame(spark, ODD), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in odd.items() if s >= 0.3}
    assert kept.columns == frame(spark, ODD).columns


def test_quality_blocks_equal_all_pairs():
    r = np.random.default_rng(2)
    counts = np.stack([quality.terms(prose(i, 30 + i).encode()) for i in range(60)])
    label = r.integers(0, 2, 60)
    rows = [quality.pack(c) for c in counts]
    assert np.array_equal(quality.unpack(rows), counts)
    m = quality.fit(rows, label)
    z = m.latent(counts)
    for i in (0, 7, 59):
        cosine = sorted(((float(z[i] @ v), -k) for k, v in enumerate(m.voters)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(c, 1e-3) ** quality.POWER for c, _ in cosine]
        assert m.score(counts[i : i + 1])[0] == pytest.approx(sum(x * label[-k] for x, (_, k) in zip(w, cosine, strict=True)) / sum(w), rel=1e-4)


def test_nearest_takes_the_earlier_of_ties():
    r = np.random.default_rng(3)
    cosine = r.integers(0, 4, (200, 50)).astype(np.float32)
    want = np.argsort(-cosine, axis=1, kind="stable")[:, :7]
    assert np.array_equal(np.sort(quality.nearest(cosine, 7), 1), np.sort(want, 1))


def test_directions_span_the_leading_eigenvectors():
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 120)) * (0.9 ** np.arange(120))
    gram = (x.T @ x).astype(np.float32)
    want = np.linalg.eigh(gram.astype(np.float64))[1][:, ::-1][:, :16]
    got = quality.directions(gram, 16)
    assert np.allclose(np.abs(np.linalg.svd(want.T @ got)[1]), 1, atol=1e-3)


def test_quality_takes_one_text_of_a_repeated_id(spark):
    labels = spark.createDataFrame([(903, 1), (907, 0)], "doc_id long, quality int")
    rows = [(903, "one"), (903, "two words"), (907, "three more words"), (903, "one")]
    a, b = (quality.train(frame(spark, x).repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 3)))
    assert np.array_equal(a.voters, b.voters) and len(a.label) == 2


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(frame(spark, ODD), none)
    assert {r.score for r in quality.score(frame(spark, ODD), model).collect()} == {0.0, 0.5}
    twice = spark.createDataFrame([(903, 1), (903, 1), (907, 1), (1, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(frame(spark, ODD), quality.train(frame(spark, ODD), twice)).collect()} <= {0.0, 1.0, 0.5}


# -- chat -------------------------------------------------------------------------------------------------------------
TURNS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "x<|im_end|>y"), (1, 3, "ann", "x<|im_end|>y"), (2, None, None, "alone"), (2, 5, "c|d", "é"), (3, 0, "system", "nobody"), (None, 1, "eve", "lost"), (None, 0, "ann", "found")]


@pytest.mark.parametrize("block", [1024, 2])
def test_chat(spark, block):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, pos int")
    got = chat.rotate(df, block=block).collect()
    people = {(c, s or "unknown") for c, _, s, _ in TURNS if s != "system"}
    assert {(r.conv_id, r.perspective) for r in got} == people
    for c, who in people:
        rows = sorted((r for r in got if (r.conv_id, r.perspective) == (c, who)), key=lambda r: r.pos)
        said = sorted((t for t in TURNS if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or ""))
        assert [r.pos for r in rows] == list(range(len(said)))
        dialogue = "".join(r.message for r in rows)
        for r, (_, _, s, t) in zip(rows, said, strict=True):
            body = (t or "").replace("<|im_end|>", "< |im_end|>")
            assert dialogue[r.char_start : r.char_end] == r.message
            if (s or "unknown") == who:
                assert r.role == "assistant" and dialogue[r.mask_start : r.mask_end] == f"{body}<|im_end|>"
            else:
                assert r.mask_start is None and r.role == ("system" if s == "system" else "user") and body in r.message
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_cells(spark):
    """Null, negative and equal turns; texts that begin alike; many rows of the null dialogue."""
    from ..conftest import rows

    data = [(None if i % 3 else i % 2, (None, 5, -3000, 2)[i % 4], ("a", "b", None, "system")[i % 5 % 4], f"{'begin the same' if i % 2 else i % 7} {i % 40}") for i in range(400)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    import duckdb

    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by name
    assert rows(chat.rotate(df).toPandas()) == rows(duckdb.sql(chat.ORACLE).df())


def test_chat_sql(spark, sf_dir, duck):
    from ..conftest import rows

    assert rows(chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")).toPandas()) == rows(duck.sql(chat.ORACLE).df())


def test_chat_is_native(spark, sf_dir):
    plan = chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# -- pipeline ---------------------------------------------------------------------------------------------------------
def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, frames = [n for n, _ in c.STAGES], [docs]
    from stepquery.llm.common import materialize

    for name, stage in c.STAGES:
        frames.append(materialize(stage(spark, frames[-1], sf_dir), f"test-{len(names)}"))
        if name != names[-1]:
            assert frames[-1].columns == docs.columns and frames[-1].schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    counts = [f.count() for f in frames]
    assert all(a >= b for a, b in zip(counts, counts[1:], strict=False)) and counts[-1] == counts[-2] > 0
    assert sorted(map(tuple, frames[-1].collect())) == sorted(map(tuple, c.run(spark, sf_dir).collect()))
    leaks = {r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert not any(t in r.text for r in frames[4].collect() for t in leaks)
    assert all(r.n_chars == len(r.text) for r in frames[4].collect())
