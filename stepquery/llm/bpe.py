"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised on its own (in parallel), neighbours are
stitched at the first pre-token boundary that both have in their overlap, and the pre-tokens of the stitched pieces are
encoded. From a common boundary on both chunks see the same text, so the matches of the pattern are the same. Where an
overlap holds no common boundary (one run longer than the overlap), the two chunks are joined and split again, so the
result is that of the undivided text in every case. Decoding concatenates the raw bytes of the ids.

Defined results: a null text encodes as the empty text (no ids); an empty text has no ids; repeated rows give repeated
results; other columns, whatever their names, are neither read nor changed. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, small_batches

#: Characters of a chunk and of its overlap with the next one. The overlap is longer than any usual word.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A boundary closer than this to the end of a chunk may differ in the whole text: the pattern looks ahead by at most
#: three characters (apostrophe and two letters, or one character behind white space).
MARGIN = 4
#: Pre-tokens whose ids a worker keeps.
CACHE = 400_000


class Tokenizer:
    """Ranks of a tiktoken file with the pattern that splits text before the merges."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe
        self.pattern = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in table.items()}
        self.name_of = {v: str(v) for v in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = {}

    def ends(self, text: str) -> np.ndarray:
        """End offsets of the pre-tokens."""
        return np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), np.int64))

    def ids(self, pieces: list[str]) -> list[int]:
        known, encode = self.known, self.core.encode_single_piece
        if len(known) > CACHE:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = tuple(encode(p.encode("utf-8", "surrogatepass")))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return self.ids(self.pattern.findall(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        names = ",".join(map(self.name_of.__getitem__, ids))
        return len(ids), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def chunks_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, text) of the overlapping chunks; the last one ends with the text."""
    start = 0
    while True:
        yield start, text[start : start + chunk + overlap]
        if start + chunk + overlap >= len(text):
            return
        start += chunk


def stitch(parts: list[tuple[int, str, np.ndarray]], ends: Callable[[str], np.ndarray]) -> list[tuple[int, str, np.ndarray]]:
    """Pieces (start, text, ends within it) that follow each other without overlap.

    parts: (start, text, ends) of the chunks in order. ends: pre-tokenises a text, for chunks that have to be joined.
    """
    pieces, (start, text, cuts) = [], parts[0]
    need = 2 * len(text)
    for start2, text2, cuts2 in parts[1:]:
        at = -1
        if cuts is not None:
            mine = cuts + start
            mine = mine[(mine >= start2) & (mine <= start + len(text) - MARGIN)]
            both = np.intersect1d(mine, np.append(cuts2 + start2, start2))
            at = int(both[0]) if len(both) and both[0] < start2 + len(text2) else -1
        if at >= 0:
            pieces.append((start, text[: at - start], cuts[cuts <= at - start]))
            skip = at - start2
            start, text, cuts = at, text2[skip:], cuts2[cuts2 > skip] - skip
            need = 2 * len(text2)
        else:
            # joined chunks are cut again only when they have doubled, so a run of any length costs in proportion to it
            text += text2[start + len(text) - start2 :]
            cuts = ends(text) if len(text) >= need else None
            need = 2 * len(text) if cuts is not None else need
    pieces.append((start, text, ends(text) if cuts is None else cuts))
    return pieces


def _shared(vocabulary: str, pattern: str):
    """Makes a worker's tokenizer once; the ranks travel with the function (a fixed vocabulary file, about 1 MB)."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    made: dict[int, Tokenizer] = {}

    def get() -> Tokenizer:
        if 0 not in made:
            made[0] = Tokenizer(ranks, pattern)
        return made[0]

    return get


def row_name(seen: Counter, task: int, key: object, text: str) -> str:
    """A name for a row that does not depend on the order in which its task reads, which may change when it is run again.

    Rows that are equal in key and text get different names, but any of them may get any of these.
    """
    same = hashlib.blake2b(f"{key!r}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    seen[same] += 1
    return f"{task}-{same}-{seen[same]}"


RESULT = {
    "ids": ("ids array<int>", [pa.field("ids", pa.list_(pa.int32()))]),
    "digest": (
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
        [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())],
    ),
}


def _columns(kind: str, tok: Tokenizer, rows: list[list[int]]) -> list[pa.Array]:
    if kind == "ids":
        return [pa.array(rows, pa.list_(pa.int32()))]
    made = [tok.digest(x) for x in rows]
    return [pa.array([m[i] for m in made], f.type) for i, f in enumerate(RESULT["digest"][1])]


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", result: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """`key` and, by `result`, either `ids` or the digests of ids and decoded bytes, one row per input row.

    Texts within one chunk are encoded where they are read, without a shuffle. Only longer ones are cut; their chunks
    are dealt out by (row, chunk), so that one huge text is pre-tokenised and encoded by many tasks.
    """
    tok, (ddl, fields) = _shared(vocabulary, pattern), RESULT[result]
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = plain.schema["key"].dataType.simpleString()
    limit = chunk + overlap

    def whole(batches):
        for batch in small_batches(batches, 256):
            t = tok()
            rows = [t.encode(x or "") for x in as_strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(result, t, rows)], names=["key", *(f.name for f in fields)])

    short = plain.where(F.col("text").isNull() | (F.length("text") <= limit)).mapInArrow(whole, f"key {key_type}, {ddl}")
    return short.unionByName(_long(plain.where(F.length("text") > limit), key_type, tok, result, chunk, overlap)).withColumnRenamed("key", key)


def _long(plain: DataFrame, key_type: str, tok, result: str, chunk: int, overlap: int) -> DataFrame:
    ddl, fields = RESULT[result]
    names = [f.name for f in fields]

    def cut(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in small_batches(batches, 1):
            text = as_strings(batch.column(1))[0]
            row = row_name(seen, task, batch.column(0)[0].as_py(), text)
            for no, (start, part) in enumerate(chunks_of(text, chunk, overlap)):
                yield pa.RecordBatch.from_arrays([pa.array([row]), batch.column(0), pa.array([no], pa.int32()), pa.array([start], pa.int64()), pa.array([part], pa.large_string())], names=["row", "key", "no", "start", "part"])

    def split(batches):
        for batch in small_batches(batches, 8):
            t = tok()
            cuts = [t.ends(x).astype("<i4").tobytes() for x in as_strings(batch.column("part"))]
            yield batch.append_column("cuts", pa.array(cuts, pa.binary()))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        parts = [(s, x, np.frombuffer(c, "<i4").astype(np.int64)) for s, x, c in zip(table["start"].to_pylist(), table["part"].to_pylist(), table["cuts"].to_pylist(), strict=True)]
        pieces = stitch(parts, tok().ends)
        n = len(pieces)
        return pa.table(
            {
                "row": pa.array([table["row"][0].as_py()] * n),
                "key": pa.array([table["key"][0].as_py()] * n, table.schema.field("key").type),
                "no": pa.array(range(n), pa.int32()),
                "part": pa.array([p[1] for p in pieces]),
                "cuts": pa.array([p[2].astype("<i4").tobytes() for p in pieces], pa.binary()),
            }
        )

    def merge(batches):
        for batch in small_batches(batches, 8):
            t = tok()
            out = []
            for part, cuts in zip(as_strings(batch.column("part")), batch.column("cuts").to_pylist(), strict=True):
                ends = np.frombuffer(cuts, "<i4").tolist()
                out.append(t.ids([part[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "no")), pa.array(out, pa.list_(pa.int32()))], names=["row", "key", "no", "ids"])

    def concat(table: pa.Table) -> pa.Table:
        ids = list(chain.from_iterable(table.sort_by("no")["ids"].to_pylist()))
        return pa.table([table["key"].slice(0, 1).combine_chunks(), *_columns(result, tok(), [ids])], names=["key", *names])

    head = f"row string, key {key_type}, no int"
    parts = plain.mapInArrow(cut, f"{head}, start long, part string").repartition("row", "no").mapInArrow(split, f"{head}, start long, part string, cuts binary")
    pieces = parts.groupBy("row").applyInArrow(join, f"{head}, part string, cuts binary").repartition("row", "no").mapInArrow(merge, f"{head}, ids array<int>")
    return pieces.groupBy("row").applyInArrow(concat, f"key {key_type}, {ddl}")


def decode(tokens: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """`key` and `bytes`, the concatenated raw bytes of `ids`; null ids decode to no bytes."""
    tok = _shared(vocabulary, pattern)
    plain = tokens.select(F.col(key).alias("key"), "ids")

    def run(batches):
        for batch in small_batches(batches, 256):
            t = tok()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["key", "bytes"])

    return plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, bytes binary").withColumnRenamed("key", key)
