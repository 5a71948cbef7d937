"""A Bloom filter of bounded size, folded in Spark.

What it lets through by mistake only costs time: every user checks exactly afterwards. Its size is bounded by MOST bits
whatever the data; beyond that it lets more through, and results stay whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a filter at most (16 MB), and words for each value below that.
MOST, EACH = 1 << 21, 0.25
#: Odd multipliers that take a 64-bit hash to its bits.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _bits(values: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, top = [], np.uint64(64 - (words * 64).bit_length() + 1)
    for m in MIX:
        with np.errstate(over="ignore"):
            bit = (values.view(np.uint64) * np.uint64(m)) >> top
        out.append(((bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)))
    return out


class Filter:
    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value], np.int64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        """For each hash (int64), whether it may be among the filter's values."""
        ok = np.ones(len(values), bool)
        for word, bit in _bits(np.ascontiguousarray(values, np.int64), len(self.words)):
            ok &= (self.words[word] >> bit) & np.uint64(1) == 1
        return ok


def build(values: DataFrame, column: str) -> Filter:
    """From the hashes (longs) in `column`. The driver gets at most MOST words, merged by the executors."""
    n = values.count()
    words = min(MOST, 1 << max(10, int(n * EACH).bit_length()))

    def run(batches):
        import pyarrow as pa

        held = np.zeros(words, np.uint64)
        for batch in batches:
            for word, bit in _bits(batch.column(0).to_numpy(zero_copy_only=False), words):
                np.bitwise_or.at(held, word, np.uint64(1) << bit)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], names=["word", "bits"])

    got = values.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(out)
