"""N-gram Jaccard join by filtering under several global token orders.

A document's set holds the hashes of its distinct word n-grams. Equal sets are one class, found by a 128-bit digest. Two
sets that reach the similarity share a token in their prefixes (the first |x| - ceil(t|x|) + 1 tokens) under every global
order. Four orders are used. The first is that of the hashes themselves: sets of a similar pair share many of the first
tokens of one and a half prefixes, so a set of which too few are found in a second set is out before anything else is
done (the shared tokens' Bloom filter lets through some more, never fewer). The others put frequent tokens last, by a
corpus-wide count sketch, with ties by three different hashes. The second order's prefixes are the index; each of its
buckets names the most central member that its members know, and all buckets with the same one make a group, so every
pair of a bucket meets in a group.

Long texts share some tokens with many others by chance and are in many groups, the more the larger the corpus is. So only
32 bits of each of a set's first tokens by hash are sent to its groups; two sets of which too few agree cannot be similar.
The pairs that are left join the sets to families: every set is in one family only and its tokens are sent once, and every
similar pair is in one family. A group of more than FIRST times FAMILY_TOKENS or FAMILY_MEMBERS first loses the members of
which too few first tokens occur among those of all others, counted by value without copies; what is left is dealt out in
blocks that meet pairwise. In a family, candidates must share prefix tokens under the other orders before their overlap is
counted exactly.

Only links between different components are looked for: the most central member is taken first, which joins most of a
group of near copies at once, and pairs that are already connected are passed over. A family of more than FAMILY_TOKENS or
FAMILY_MEMBERS is dealt out in blocks, so no task holds an unbounded group: first every block meets the family's centre
(the member in most of the pairs) alone, which costs in proportion to its size; then the members that are not linked to it
(the rest) are dealt out in blocks of their own, which meet each other and all other blocks pairwise. Members that are
linked to the centre need not meet, they are connected. No link between different components is lost; the work within one
family grows with the square of its rest only. Components are then joined by alternating large-star and small-star steps,
each written to the shared folder.

Defined results: A-Z are lower-cased and words are split at ASCII white space; a text with fewer words than n is one
shingle; a null, empty or blank text has an empty set and is linked with nothing; rows with a null id are returned with
a null component and linked with nothing; rows of the same id are one document for the component; repeated rows repeat;
other columns do not matter. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import words as words_module
from .common import as_bytes, few_files, materialize, small_batches, whole_number

WORDS, PERCENT = 4, 85
#: Counters of the frequency sketch (log2), fixed whatever the data.
SKETCH = 20
#: Tokens and members of a family (or of one of its blocks) in one task.
FAMILY_TOKENS, FAMILY_MEMBERS = 2_000_000, 2048
#: So many times as many where only first tokens are sent.
FIRST = 4
#: Removed ids of up to so many bytes are broadcast; more are joined by a shuffle.
BROADCAST = 32 << 20
#: Digests of equal sets that a task remembers.
CACHE = 1_000_000
#: One odd multiplier for each global order.
ORDERS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))
A, B = words_module.A, words_module.B


def shingles(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    h = words_module.split(data, fold=True)[0]
    if 0 < len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    if not len(h):
        return h
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= A
        out ^= out >> np.uint64(31)
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(33)
    out *= B
    out ^= out >> np.uint64(33)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def screen_length(n: int, percent: int) -> int:
    return min(n, prefix_length(n, percent) * 3 // 2)


def screen_least(n: int, percent: int) -> int:
    """How many of a set's first tokens a similar set shares at least, whatever its own size."""
    smallest = max(1, (percent * n + 99) // 100)
    return 1 + screen_length(smallest, percent) - prefix_length(smallest, percent)


def similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def order_keys(tokens: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """Sort keys of the k-th global order: frequency level first, then a hash of its own."""
    with np.errstate(over="ignore"):
        h = (tokens * ORDERS[k]) ^ (tokens >> np.uint64(29))
        h *= B
    return (level[slots(tokens)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << SKETCH) - 1)).astype(np.int64)


def _scan(plain: DataFrame, n: int) -> DataFrame:
    """One row for each document (doc, n, s1, s2), and the frequent counters of each task (doc null, slot, seen)."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH, np.int64)
        for batch in small_batches(batches, 512):
            sets = [shingles(x, n) for x in as_bytes(batch.column(1))]
            if sets:
                sketch += np.bincount(slots(np.concatenate(sets)), minlength=len(sketch))
            ids = [digest(s) if len(s) else (None, None) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()), none, none], names=["doc", "n", "s1", "s2", "slot", "seen"])
        at = np.nonzero(sketch >= max(4, 4 * sketch.mean()))[0]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at), pa.array(sketch[at])], names=["doc", "n", "s1", "s2", "slot", "seen"])

    return plain.mapInArrow(run, "doc long, n long, s1 long, s2 long, slot long, seen long")


def levels(scan: DataFrame) -> np.ndarray:
    """log2 of every counter's sum over all documents; at most 2^SKETCH numbers reach the driver."""
    got = scan.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()
    seen = np.zeros(1 << SKETCH)
    seen[got["slot"].to_numpy()] = got["seen"].to_numpy()
    return np.log2(1 + seen).astype(np.uint8)


def _first_tokens(plain: DataFrame, n: int, percent: int) -> DataFrame:
    """(token, s1) for each of the first tokens of every set, in the order of their hashes."""

    def run(batches):
        done = set()
        for batch in small_batches(batches, 512):
            out = []
            for x in as_bytes(batch.column(1)):
                s = shingles(x, n)
                if len(s) and (d := digest(s)) not in done:
                    done.add(d)
                    first = s[: screen_length(len(s), percent)].view(np.int64)
                    out.append((first, np.full(len(first), d[0])))
            if len(done) > CACHE:
                done.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "s1"])

    return plain.mapInArrow(run, "token long, s1 long")


def _index(plain: DataFrame, n: int, percent: int, level, common) -> DataFrame:
    """(token, s1, s2, n, rank) for every prefix token of the sets that pass the screen; rank: centrality, then digest."""

    def run(batches):
        done = set()
        for batch in small_batches(batches, 256):
            out = []
            for x in as_bytes(batch.column(1)):
                s = shingles(x, n)
                if not len(s) or (d := digest(s)) in done:
                    continue
                done.add(d)
                if np.count_nonzero(common.value.has(s[: screen_length(len(s), percent)].view(np.int64))) < screen_least(len(s), percent):
                    continue
                keys = order_keys(s, level.value, 0)
                p = prefix_length(len(s), percent)
                first = s[np.argpartition(keys, p - 1)[:p]] if p < len(s) else s
                centre = int(level.value[slots(s)].mean() * 512)
                rank = centre << 48 | (d[0] & (1 << 64) - 1) >> 16
                out.append((first.view(np.int64), *(np.full(p, v, np.int64) for v in (*d, len(s), rank))))
            if len(done) > CACHE:
                done.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "s1", "s2", "n", "rank"])

    return plain.mapInArrow(run, "token long, s1 long, s2 long, n long, rank long")


def _sets(plain: DataFrame, n: int, wanted, percent: int | None = None) -> DataFrame:
    """(s1, s2, tokens) of the sets that may be in a family; with a percentage, only 32 bits of each of their first tokens."""

    def run(batches):
        done = set()
        for batch in small_batches(batches, 256):
            out = []
            sets = [s for x in as_bytes(batch.column(1)) if len(s := shingles(x, n))]
            ids = [digest(s) for s in sets]
            ok = wanted.value.has(np.array([d[0] for d in ids], np.int64))
            for s, d, keep in zip(sets, ids, ok, strict=True):
                if keep and d not in done:
                    done.add(d)
                    out.append((*d, (s if percent is None else s[: screen_length(len(s), percent)].astype(np.uint32)).tobytes()))
            if len(done) > CACHE:
                done.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["s1", "s2", "tokens"])

    return plain.mapInArrow(run, "s1 long, s2 long, tokens binary").dropDuplicates(["s1", "s2"])


def _accompanied(members: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """The members (family, s1, s2, n) of which enough first tokens are also first tokens of other members of the family.

    A family's first tokens are dealt out by their value in parts of bounded size, each of them to one part only. Tokens
    that agree in their 32 bits count as equal, which lets through some more members, never fewer.
    """
    parts = members.groupBy("family").agg(F.ceil(F.sum("n") / FAMILY_TOKENS).cast("long").alias("parts"))

    def deal(batches):
        for batch in small_batches(batches, 256):
            row, part, tokens = [], [], []
            for k, (x, of) in enumerate(zip(batch["tokens"].to_pylist(), batch["parts"].to_pylist(), strict=True)):
                t = np.frombuffer(x, np.uint32)
                to = t % of
                for at in np.unique(to) if of > 1 else (0,):
                    row.append(k)
                    part.append(int(at))
                    tokens.append(t[to == at].tobytes() if of > 1 else x)
            if row:
                own = batch.select(["family", "s1", "s2", "n"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(part, pa.int64()), pa.array(tokens, pa.binary())], names=["family", "s1", "s2", "n", "part", "tokens"])

    def count(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint32) for x in group["tokens"].to_pylist()]
        _, local, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = np.bincount(owner[often[local] > 1], minlength=len(sets))
        least = [screen_least(k, percent) for k in group["n"].to_pylist()]
        return pa.table({**{c: group[c] for c in ("family", "s1", "s2", "n")}, "shared": pa.array(shared, pa.int64()), "least": pa.array(least, pa.int64())})

    dealt = members.join(parts, "family").join(first, ["s1", "s2"]).select("family", "s1", "s2", "n", "parts", "tokens").mapInArrow(deal, "family long, s1 long, s2 long, n long, part long, tokens binary")
    counted = dealt.groupBy("family", "part").applyInArrow(count, "family long, s1 long, s2 long, n long, shared long, least long")
    return counted.groupBy("family", "s1", "s2").agg(F.first("n").alias("n"), F.sum("shared").alias("shared"), F.first("least").alias("least")).where("shared >= least").select("family", "s1", "s2", "n")


def ties(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that join all sets that may be similar by their first tokens; pairs of equal `side` are passed over where both occur."""
    m = len(sets)
    # the first k tokens that two similar sets share are among the first k - 1 + prefix_length of both
    share = np.array([1 + screen_length(k, percent) - prefix_length(k, percent) for k in sizes.tolist()])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, local, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    centre = np.bincount(owner, often[local], m) / np.maximum(1, np.bincount(owner, minlength=m))
    owner, local = owner[often[local] > 1], local[often[local] > 1]
    begin = np.searchsorted(owner, np.arange(m + 1))
    by = np.argsort(local, kind="stable")
    members, posts = owner[by], np.searchsorted(local[by], np.arange(len(often) + 1))
    turn = np.lexsort((np.arange(m), -centre))
    place = np.empty(m, np.int64)
    place[turn] = np.arange(m)
    crossing = len(np.unique(side)) > 1
    label, out = np.arange(m), []
    for u in turn:
        ok = (label != label[u]) & (place > place[u]) & (100 * np.minimum(sizes, sizes[u]) >= percent * np.maximum(sizes, sizes[u]))
        if crossing:
            ok &= side != side[u]
        if not ok.any():
            continue
        mine = local[begin[u] : begin[u + 1]]
        length = posts[mine + 1] - posts[mine]
        where = np.arange(length.sum()) + np.repeat(posts[mine] - np.cumsum(length) + length, length)
        ok &= np.bincount(members[where], minlength=m) >= np.minimum(share, share[u])
        found = np.nonzero(ok)[0]
        if len(found):
            joined, which = np.unique(label[found], return_index=True)
            out += [(int(u), int(y)) for y in found[which]]
            label[np.isin(label, joined)] = label[u]
    return out


def _candidates(members: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """(a1, a2, an, b1, b2, bn): pairs that join all members that may be similar, with their sizes. first: (s1, s2, tokens)."""

    def run(group: pa.Table) -> pa.Table:
        block, n = group["block"].to_numpy(), group["n"].to_numpy()
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        got = ties([np.frombuffer(x, np.uint32) for x in group["tokens"].to_pylist()], n, block if low != high else np.zeros(len(n), np.int64), percent) if low == high or len(np.unique(block)) > 1 else []
        ends = [np.array([g[k] for g in got], np.int64) for k in (0, 1)]
        return pa.table({e + c: group[x].to_numpy()[at] for e, at in zip("ab", ends, strict=True) for c, x in (("1", "s1"), ("2", "s2"), ("n", "n"))})

    def sized(of):
        return of.join(of.groupBy("family").agg(blocks_of(F.sum("n") / FIRST, F.count("*") / FIRST).alias("blocks"), F.count("*").alias("several")).where("several > 1").drop("several"), "family")

    some = materialize(sized(members), "sized")
    small, big, one = some.where("blocks = 1"), some.where("blocks > 1"), F.lit(0).cast("long")
    placed = small.select("family", "s1", "s2", "n", one.alias("block"), one.alias("low"), one.alias("high"))
    if not big.isEmpty():
        big = sized(materialize(_accompanied(big.drop("blocks"), first, percent), "accompanied"))
        dealt = big.withColumn("block", F.pmod("s2", "blocks")).withColumn("other", F.explode(F.sequence(one, F.col("blocks") - 1)))
        placed = placed.unionByName(dealt.select("family", "s1", "s2", "n", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    return placed.join(first, ["s1", "s2"]).groupBy("family", "low", "high").applyInArrow(run, "a1 long, a2 long, an long, b1 long, b2 long, bn long")


def _gathered(pairs: DataFrame) -> DataFrame:
    """(family, s1, s2, n, degree): every end of the pairs once, in the family of all that the pairs connect it with."""
    ends = pairs.selectExpr("a1 s1", "a2 s2", "an n").unionByName(pairs.selectExpr("b1 s1", "b2 s2", "bn n")).groupBy("s1", "s2").agg(F.first("n").alias("n"), F.count("*").alias("degree"))
    roots = connected(pairs.select(F.col("a1").alias("a"), F.col("b1").alias("b")))
    return ends.join(roots, F.col("s1") == F.col("node"), "left").select(F.coalesce("root", "s1").alias("family"), "s1", "s2", "n", "degree")


def links(sets: list[np.ndarray], side: np.ndarray, level: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of the sets; pairs of equal `side` (0 or 1) are passed over where both sides occur."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(local)
    centre = np.add.reduceat(often[local], start[:-1]) / size
    turn = np.lexsort((np.arange(m), -centre))
    place = np.empty(m, np.int64)
    place[turn] = np.arange(m)
    # postings of the prefixes under every order
    owner = np.repeat(np.arange(m), size)
    lengths = np.array([prefix_length(k, percent) for k in size])
    prefixes = []
    for k in range(len(ORDERS)):
        by = np.lexsort((order_keys(tokens, level, k)[local], owner))
        within = np.arange(len(by)) - start[owner[by]]
        first = by[within < lengths[owner[by]]]
        first = first[often[local[first]] > 1]
        post = first[np.argsort(local[first], kind="stable")]
        prefixes.append((local[first], np.searchsorted(owner[first], np.arange(m + 1)), owner[post], np.searchsorted(local[post], np.arange(len(tokens) + 1))))
    crossing = len(np.unique(side)) > 1
    label, mark, out = np.arange(m), np.zeros(len(tokens), bool), []
    for u in turn:
        ok = (label != label[u]) & (place > place[u]) & (100 * np.minimum(size, size[u]) >= percent * np.maximum(size, size[u]))
        if crossing:
            ok &= side != side[u]
        for mine, bounds, members, posts in prefixes:
            if not ok.any():
                break
            hit = np.zeros(m, bool)
            for t in mine[bounds[u] : bounds[u + 1]]:
                hit[members[posts[t] : posts[t + 1]]] = True
            ok &= hit
        found = np.nonzero(ok)[0]
        if not len(found):
            continue
        mark[local[start[u] : start[u + 1]]] = True
        if len(found) * 4 > m:
            inter = np.add.reduceat(mark[local].astype(np.int64), start[:-1])[found]
        else:
            inter = np.array([np.count_nonzero(mark[local[start[y] : start[y + 1]]]) for y in found])
        mark[local[start[u] : start[u + 1]]] = False
        for y in found[similar(inter, size[u], size[found], percent)]:
            if label[y] != label[u]:
                out.append((int(u), int(y)))
                label[label == label[y]] = label[u]
        if (label == label[0]).all():
            break
    return out


def _verify(families: DataFrame, level, percent: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        s1, s2, block = (group[c].to_numpy() for c in ("s1", "s2", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in group["tokens"].to_pylist()]
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        got = links(sets, block if low != high else np.zeros(len(sets), np.int64), level.value, percent) if low == high or len(np.unique(block)) > 1 else []
        a, b = (np.array([g[k] for g in got], np.int64) for k in (0, 1))
        return pa.table({"a1": s1[a], "a2": s2[a], "b1": s1[b], "b2": s2[b]})

    return families.groupBy("family", "low", "high").applyInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def _to_centre(sets: DataFrame, percent: int) -> DataFrame:
    """(family, s1, s2, c1, c2, linked): whether each set is similar to its family's centre. sets: also tokens and centre."""

    def run(batches):
        for batch in small_batches(batches, 256):
            linked = []
            for x, c in zip(batch["tokens"].to_pylist(), batch["centre"].to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                linked.append(bool(similar(np.count_nonzero(b[at] == a), len(a), len(b), percent)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("family", "s1", "s2", "c1", "c2")), pa.array(linked, pa.bool_())], names=["family", "s1", "s2", "c1", "c2", "linked"])

    return sets.mapInArrow(run, "family long, s1 long, s2 long, c1 long, c2 long, linked boolean")


def blocks_of(tokens: F.Column, members: F.Column) -> F.Column:
    """In how many blocks so many tokens of so many members are dealt out."""
    return F.greatest(F.ceil(tokens / FAMILY_TOKENS), F.ceil(members / FAMILY_MEMBERS), F.lit(1)).cast("long")


def _large(plain: DataFrame, words: int, big: DataFrame, level, percent: int) -> DataFrame:
    """Links (a1, a2, b1, b2) within families of several blocks. big: (family, s1, s2, n, degree, blocks)."""
    context = plain.sparkSession.sparkContext
    centres = big.groupBy("family").agg(F.max(F.struct("degree", "s1", "s2")).alias("c")).select("family", F.col("c.s1").alias("c1"), F.col("c.s2").alias("c2"))
    wanted = context.broadcast(bloom.build(big.select("s1").distinct(), "s1"))
    sets = materialize(big.join(_sets(plain, words, wanted), ["s1", "s2"]), "large-sets")
    wanted.destroy()
    own = centres.join(sets, (centres["family"] == sets["family"]) & (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2")))
    # a centre meets each block of its family in a task of its own
    spread = own.select(centres["family"], "c1", "c2", F.col("tokens").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    judged = materialize(_to_centre(sets.withColumn("block", F.pmod("s2", "blocks")).join(spread.hint("shuffle_hash"), ["family", "block"]), percent), "to-centre")
    to_centre = judged.where("linked and (s1 <> c1 or s2 <> c2)").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    sized = sets.select("family", "s1", "s2", "n").join(judged.select("family", "s1", "s2", "linked"), ["family", "s1", "s2"])
    count = lambda of: blocks_of(F.sum(F.when(of, F.col("n")).otherwise(0)), F.count_if(of))
    dealt = sized.groupBy("family").agg(F.count_if(~F.col("linked")).alias("left"), count(~F.col("linked")).alias("rest"), count(F.col("linked")).alias("near")).where("left > 0").drop("left")
    block = F.when(F.col("linked"), F.col("rest") + F.pmod("s2", "near")).otherwise(F.pmod("s2", "rest"))
    meets = F.when(F.col("linked"), F.col("rest")).otherwise(F.col("rest") + F.col("near"))
    placed = sized.join(dealt, "family").select("family", "s1", "s2", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)).alias("other"))
    placed = placed.select("family", "s1", "s2", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return to_centre.unionByName(_verify(placed.join(sets.select("family", "s1", "s2", "tokens"), ["family", "s1", "s2"]), level, percent))


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge (a, b) to another one."""
    state = lambda of: of.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    step = materialize(edges.where("a <> b").distinct(), "edges")
    last = state(step)
    for _ in range(most_rounds):
        both = step.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(step.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        # of each edge at most one row comes down, and each row at most names one least node
        step = materialize(few_files(small, 2 * last[0]), "edges")
        now = state(step)
        if now == last:
            return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError("components did not settle")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id), one row per input row."""
    context = docs.sparkSession.sparkContext
    plain = docs.select(whole_number(docs, key).alias("doc"), F.col(f"`{text}`").alias("text"))
    scan = materialize(_scan(plain, words), "sets")
    level = context.broadcast(levels(scan))
    rows = scan.where("slot is null").drop("slot", "seen")
    plain = plain.where("doc is not null")
    twice = materialize(_first_tokens(plain, words, percent).groupBy("token").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("token"), "tokens")
    common = context.broadcast(bloom.build(twice, "token"))
    index = _index(plain, words, percent, level, common)
    shared = index.groupBy("token").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.max("rank").alias("family")).where("lo < hi").select("token", "family")
    hits = materialize(index.select("token", "s1", "s2", "n").join(shared, "token"), "hits")
    common.destroy()
    # buckets of one group of near copies may name several members: each takes the highest name that its members know
    known = hits.groupBy("s1", "s2").agg(F.max("family").alias("known"))
    bucket = materialize(hits.join(known, ["s1", "s2"]).groupBy("token").agg(F.max("known").alias("family")), "buckets")
    members = materialize(hits.drop("family").join(bucket, "token").groupBy("family", "s1", "s2").agg(F.first("n").alias("n")), "members")
    wanted = context.broadcast(bloom.build(members.select("s1").distinct(), "s1"))
    first = materialize(_sets(plain, words, wanted, percent), "first")
    wanted.destroy()
    members = materialize(_gathered(materialize(_candidates(members, first, percent), "candidates")), "gathered")
    parts = members.groupBy("family").agg(blocks_of(F.sum("n"), F.count("*")).alias("blocks"))
    sizes = materialize(members.join(parts, "family"), "families")
    small, big = sizes.where("blocks = 1"), sizes.where("blocks > 1")
    wanted = context.broadcast(bloom.build(small.select("s1").distinct(), "s1"))
    one = F.lit(0).cast("long")
    families = small.select("family", "s1", "s2", one.alias("block"), one.alias("low"), one.alias("high")).join(_sets(plain, words, wanted), ["s1", "s2"])
    found = _verify(families, level, percent)
    if not big.isEmpty():
        found = found.unionByName(_large(plain, words, big, level, percent))
    found = materialize(found.distinct(), "links")
    for shared in (level, wanted):  # all that needs them is written
        shared.destroy()
    classes = materialize(rows.where("doc is not null and s1 is not null").groupBy("s1", "s2").agg(F.min("doc").alias("first")), "classes")
    named = classes.select("s1", "s2", "first")
    ends = found.join(named.toDF("a1", "a2", "a"), ["a1", "a2"]).join(named.toDF("b1", "b2", "b"), ["b1", "b2"]).select("a", "b")
    # rows of one id that have different texts link the classes of those
    several = rows.where("doc is not null").groupBy("doc").agg(*(f(F.coalesce(c, F.lit(0))).alias(n) for f, c, n in ((F.min, "s1", "lo1"), (F.max, "s1", "hi1"), (F.min, "s2", "lo2"), (F.max, "s2", "hi2")))).where("lo1 < hi1 or lo2 < hi2").select("doc")
    same = rows.where("s1 is not null").select("doc", "s1", "s2").join(several, "doc").join(named, ["s1", "s2"]).select(F.col("first").alias("a"), F.col("doc").alias("b"))
    roots = connected(ends.unionByName(same))
    of = classes.join(roots, classes["first"] == roots["node"], "left").select("s1", "s2", F.coalesce("root", "first").alias("component_id"))
    joined = rows.where("s1 is not null").join(of, ["s1", "s2"], "left").select("doc", "n", "component_id")
    empty = rows.where("s1 is null").join(roots, F.col("doc") == F.col("node"), "left").select("doc", "n", F.col("root").alias("component_id"))
    joined = joined.unionByName(empty)
    alone = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return joined.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), alone.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, all columns unchanged; one of repeated rows."""
    found = materialize(components(docs, key, text, words, percent), "components")
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() * 16 <= broadcast else gone, key, "left_anti")
    if found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        named = kept.where(F.col(key).isNotNull()).dropDuplicates([key])
        kept = named.unionByName(kept.where(F.col(key).isNull()))
    return kept.select(*docs.columns)
