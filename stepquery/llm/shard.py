"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), a key that spreads over its whole range and splits groups of equal texts.
Candidate splitters ("probes") are keys of the data. Each round counts, over all rows and partitions, the exact bytes and
rows at or below every probe; boundaries within tolerance are done, and the next probes come from inside the brackets
that the others still have. When every boundary is met, all rows are exchanged once. A shard is cut into buckets of
bounded bytes, so no task holds a whole shard, and the counted rows below a bucket number its slots without another pass.

Law `bytes`: a shard's bytes differ from the mean by at most the tolerance on either side, or by one row where a single
row is larger. Rows with an equal key (same text hash and id) stay together.

Defined results: a null text has one byte (its size is its UTF-8 bytes plus 1) and checksum 0; null ids sort first;
an empty table gives no rows; other columns, whatever their names, are carried along unless their name is one of the
result's; ids must be whole numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, whole_number

SHARDS = 16
#: Bytes of text in a bucket (one task of the exchange).
BUCKET_BYTES = 256 << 20
#: A boundary may miss its place by this share of a bucket.
TOLERANCE = 0.001
#: Probes of a round, over all boundaries, and the least for one boundary.
PROBES, LEAST = 4096, 8
LOW = -(1 << 63)


@dataclass(frozen=True)
class Splitters:
    """Upper keys of all buckets but the last, and the rows at or below each."""

    hashes: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    shards: int
    per_shard: int


def bucket_of(h: np.ndarray, i: np.ndarray, ph: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """How many of the sorted keys (ph, pi) lie below each key (h, i)."""
    left, right = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = left.copy()
    tied = np.nonzero(left < right)[0]
    for a in np.unique(left[tied]):
        rows = tied[left[tied] == a]
        out[rows] = a + np.searchsorted(pi[a : right[rows[0]]], i[rows], "left")
    return out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)


def _count(keys: DataFrame, ph: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of every interval between the probes."""

    def run(batches):
        size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        for batch in batches:
            h, i, s = _columns(batch)
            j = bucket_of(h, i, ph, pi)
            np.add.at(size, j, s)
            rows += np.bincount(j, minlength=len(rows))
        j = np.nonzero(rows)[0]
        yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(size[j]), pa.array(rows[j])], names=["j", "size", "rows"])

    got = keys.mapInArrow(run, "j long, size long, rows long").groupBy("j").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
    for r in got:
        size[r.j], rows[r.j] = r["size"], r["rows"]
    return size, rows


def _sample(keys: DataFrame, brackets: list[tuple[tuple, tuple]], wanted: int, partitions: int) -> set[tuple[int, int]]:
    """Keys inside the open brackets (low, high), evenly spaced by bytes within each partition.

    Executors thin them out by hash, so the driver gets a bounded number for each bracket, however many partitions there are.
    """
    lo_h, lo_i = (np.array([b[0][k] for b in brackets], np.int64) for k in (0, 1))
    hi_h, hi_i = (np.array([b[1][k] for b in brackets], np.int64) for k in (0, 1))
    most = max(LEAST, math.ceil(wanted / len(brackets)))
    each = math.ceil(most / partitions)

    def run(batches):
        from pyspark import TaskContext

        held = []
        for batch in batches:
            h, i, s = _columns(batch)
            b = bucket_of(h, i, lo_h, lo_i) - 1
            ok = b >= 0
            over = (h > hi_h[b]) | ((h == hi_h[b]) & (i >= hi_i[b]))
            ok &= ~over
            held.append((b[ok], h[ok], i[ok], s[ok]))
        if not held:
            return
        b, h, i, s = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((i, h, b))
        b, h, i, s = b[order], h[order], i[order], s[order]
        shift = (TaskContext.get().partitionId() * 0.6180339887 + 0.5) % 1
        for k in np.unique(b):
            at = np.nonzero(b == k)[0]
            upto = np.cumsum(s[at])
            pick = np.unique(np.minimum(np.searchsorted(upto, (np.arange(each) + shift) / each * upto[-1]), len(at) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(b[at[pick]]), pa.array(h[at[pick]]), pa.array(i[at[pick]])], names=["b", "h", "i"])

    place = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("i", "h"), "h", "i"))
    got = keys.mapInArrow(run, "b long, h long, i long").distinct().withColumn("place", place).where(F.col("place") <= most).select("h", "i").toArrow()
    return set(zip(got["h"].to_pylist(), got["i"].to_pylist(), strict=True))


def splitters(keys: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, tolerance: float = TOLERANCE) -> Splitters:
    """Refine probes until every bucket boundary meets the tolerance. keys: (h, i, size).

    What comes to the driver is a row for each probe; their number follows the buckets, not the rows.
    """
    total = keys.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    size, n = total["size"] or 0, total["n"]
    per = max(1, math.ceil(size / shards / bucket_bytes))
    targets = [size * k / (shards * per) for k in range(1, shards * per)]
    slack = tolerance * size / (shards * per)
    low, high = (LOW, LOW), ((1 << 63) - 1, (1 << 63) - 1)
    points: list[tuple[tuple, int, int]] = [(low, 0, 0), (high, size, n)]  # key, bytes and rows at or below it
    partitions, closed = max(1, keys.rdd.getNumPartitions()), set()
    while n:
        at = np.searchsorted([p[1] for p in points], targets)
        open_ = set()
        for t, j in zip(targets, at, strict=True):
            a, b = points[j - 1], points[j]
            if min(abs(a[1] - t), abs(b[1] - t)) > slack and b[2] - a[2] > 1 and (a[0], b[0]) not in closed:
                open_.add((a[0], b[0]))
        if not open_:
            break
        known = {p[0] for p in points}
        found = _sample(keys, sorted(open_), PROBES, partitions) - known
        closed |= {o for o in open_ if not any(o[0] < f < o[1] for f in found)}
        if not found:
            continue
        probes = sorted(found | known - {low, high})
        ph, pi = (np.array([p[k] for p in probes], np.int64) for k in (0, 1))
        sizes, rows = (np.cumsum(x) for x in _count(keys, ph, pi))
        points = [(low, 0, 0), *((p, int(s), int(r)) for p, s, r in zip(probes, sizes, rows, strict=False)), (high, size, n)]
    chosen = [min((points[j - 1], points[j]), key=lambda p: abs(p[1] - t)) for t, j in zip(targets, np.searchsorted([p[1] for p in points], targets), strict=True)] if n else []
    return Splitters(*(np.array(x, np.int64) for x in ([c[0][0] for c in chosen], [c[0][1] for c in chosen], [c[2] for c in chosen])), shards, per)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """`docs` with size, law, shard, slot and grown_shard, its rows laid out by shard and slot."""
    new = ["size", "law", "shard", "slot", "grown_shard"]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    size = (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long")
    h, i = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.coalesce(whole_number(docs, key), F.lit(LOW + 1))
    keys = materialize(kept.select(h.alias("h"), i.alias("i"), size.alias("size")), "shard-keys")
    s = splitters(keys, shards, bucket_bytes, tolerance)
    below = np.concatenate([[0], s.rows])
    first = below - np.repeat(below[:: s.per_shard], s.per_shard)[: len(below)]

    @F.pandas_udf("bucket int, first long")
    def place(h: pd.Series, i: pd.Series) -> pd.DataFrame:
        b = bucket_of(h.to_numpy(), i.to_numpy(), s.hashes, s.ids)
        return pd.DataFrame({"bucket": b.astype("int32"), "first": first[b]})

    hash_, id_, place_, bucket_, first_ = free_names(docs, 5)
    placed = kept.withColumns({hash_: h, id_: i, "size": size}).withColumn(place_, place(hash_, id_))
    placed = placed.withColumns({bucket_: F.col(f"{place_}.bucket"), first_: F.col(f"{place_}.first")}).drop(place_)
    placed = placed.repartitionById(s.shards * s.per_shard, F.col(bucket_))
    slot = F.row_number().over(Window.partitionBy(bucket_).orderBy(hash_, id_)) - 1 + F.col(first_)
    shard_ = F.expr(f"{bucket_} div {s.per_shard}").cast("int")
    placed = placed.withColumns({"law": F.lit("bytes"), "shard": shard_, "slot": slot.cast("long"), "grown_shard": F.lit(None).cast("int")})
    return placed.drop(hash_, id_, bucket_, first_)
