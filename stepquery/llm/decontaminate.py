"""Benchmark decontamination.

An inverted index over the benchmark's items holds BM25 impacts, with the largest impact of each term in each block of
items. Every document is cut into passages that overlap by half, each at least twice as long as the longest item, so an
item lies whole in one of them. A passage is a query of all its words. An item is retrieved when its BM25 score reaches
SHARE of the score it gets from its own words.

Retrieval is block-max WAND worked on many passages at once instead of cursor by cursor. In place of a pivot for each
query, an item's most frequent terms whose impacts together stay below its threshold have no postings (no item can reach
its threshold with them alone). The other terms' largest impacts, kept only for the blocks of items that hold the term,
are added for each passage and block; blocks whose bound cannot reach the least threshold in them are skipped; what is
left is scored exactly. So all items above the threshold are found, and no others. The index grows with the items' words
alone, and the bounds are made for so many passages at once that they take TILE numbers.

A retrieved item is verified: the word shingles of its question (all sentences but the last) and of its answer (the last
one, and those before it while it has fewer words than a shingle) must each occur in the passage to OVERLAP or more.

Defined results: words are runs of characters between white space and ASCII punctuation, in lower case; a null or empty
text holds nothing; an item without words matches nothing; an item that cannot be divided so is
question and answer at once, and one shorter than a shingle is one shingle; repeated rows give repeated results in `find` and share their fate in
`clean`; with an empty benchmark nothing is found; other columns are carried along by `clean`; ids may be of any type.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_strings, materialize, small_batches

#: BM25's constants, and the share of an item's own score that retrieves it.
K1, B, SHARE = 1.2, 0.75, 0.5
SHINGLE, OVERLAP = 5, 0.8
#: Items of a block with its own largest impacts.
BLOCK = 32
#: Half a passage in words, at least.
HALF = 64
#: Bytes of items that are indexed and broadcast at once; a larger benchmark is worked through part by part, with the
#: document frequencies, mean length and longest item of the whole.
PART_BYTES = 16 << 20
#: Bounds (of a passage for a block of items) that are held at once.
TILE = 1 << 20
TABLE = bytes(32 if chr(c) in string.punctuation or c < 33 else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def overlap(part: set[tuple[bytes, ...]], words: list[bytes]) -> float:
    """The share of a part's shingles that occur among the words."""
    return len(part & shingles(words, len(next(iter(part))))) / len(part) if part else 0.0


def parts(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence, or so many of the last ones that they fill a shingle."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(s)]
    for k in range(len(sentences) - 1, 0, -1):
        question, answer = " ".join(sentences[:k]), " ".join(sentences[k:])
        if len(words_of(answer)) >= SHINGLE:
            return (question, answer) if len(words_of(question)) >= SHINGLE else (text, text)
    return text, text


@dataclass(frozen=True)
class Index:
    ids: list
    terms: dict[bytes, int]
    own: list[dict[int, float]]  # every item's impacts
    least: np.ndarray  # every item's threshold
    skipped: np.ndarray  # impacts of an item that are not looked up
    start: np.ndarray  # postings of each term that are looked up
    item: np.ndarray
    impact: np.ndarray
    block_start: np.ndarray  # blocks of each term that hold it,
    block: np.ndarray
    most: np.ndarray  # and its largest impact there
    need: np.ndarray  # least threshold of each block, less what is not looked up
    parts: list[tuple[set, set]]
    half: int


@dataclass(frozen=True)
class Whole:
    """Figures of a whole benchmark, for an index of a part of it."""

    items: int
    mean: float  # words of an item
    longest: int
    df: dict[bytes, int]  # of the part's words: items of the whole that have them


def index(items: list[tuple[object, str]], whole: Whole | None = None) -> Index:
    bags = [Counter(words_of(t or "")) for _, t in items]
    df = whole.df if whole else Counter(w for b in bags for w in b)
    terms = {w: i for i, w in enumerate(sorted(df))}
    length = np.array([sum(b.values()) for b in bags])
    mean = max(1.0, whole.mean if whole else float(length.mean()) if len(bags) else 0.0)
    count = whole.items if whole else len(bags)
    idf = {w: float(np.log(1 + (count - n + 0.5) / (n + 0.5))) for w, n in df.items()}
    own = [{terms[w]: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * l / mean)) for w, n in b.items()} for b, l in zip(bags, length, strict=True)]
    least = np.array([SHARE * sum(o.values()) for o in own])
    frequency = {terms[w]: n for w, n in df.items()}
    postings, skipped = defaultdict(list), np.zeros(len(own))
    for i, o in enumerate(own):
        for t in sorted(o, key=lambda t: (-frequency[t], t)):
            if skipped[i] + o[t] < 0.8 * least[i] and not postings[("on", i)]:
                skipped[i] += o[t]
            else:
                postings[("on", i)].append(t)
    looked = [[] for _ in terms]
    for i, o in enumerate(own):
        for t in postings[("on", i)]:
            looked[t].append((i, o[t]))
    tops: list[dict[int, float]] = []
    for ps in looked:
        tops.append({})
        for i, x in ps:
            tops[-1][i // BLOCK] = max(tops[-1].get(i // BLOCK, 0.0), x)
    flat, tall = [p for ps in looked for p in ps], [p for ps in tops for p in ps.items()]
    return Index(
        [i for i, _ in items],
        terms,
        own,
        least,
        skipped,
        np.cumsum([0, *map(len, looked)]),
        np.array([p[0] for p in flat], np.int64),
        np.array([p[1] for p in flat], np.float64),
        np.cumsum([0, *map(len, tops)]),
        np.array([p[0] for p in tall], np.int64),
        np.array([p[1] for p in tall], np.float64),
        np.array([(least - skipped)[b : b + BLOCK].min() for b in range(0, len(own), BLOCK)]),
        [tuple(shingles(words_of(p)) for p in parts(t or "")) for _, t in items],
        max(HALF, whole.longest if whole else int(length.max(initial=0))),
    )


def _score(own: dict[int, float], passage: np.ndarray) -> float:
    return sum(own.get(t, 0.0) for t in np.unique(passage).tolist())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def search(x: Index, ids: list[np.ndarray], tile: int = TILE) -> list[tuple[int, int, int, float]]:
    """(document, first word, item, score) of every passage and item at or above the item's threshold. ids: term of each word, -1: none."""
    blocks = len(x.need)
    if not blocks or not ids or not x.terms:
        return []
    halves = [max(1, -(-len(t) // x.half)) for t in ids]
    base = np.concatenate([[0], np.cumsum([n + 1 for n in halves])])  # one empty half behind each document
    cell = np.concatenate([b + np.arange(len(t)) // x.half for b, t in zip(base, ids, strict=False)])
    term = np.concatenate(ids)
    # a word that repeats within a half counts once there; the halves are in order
    key = np.unique(cell[term >= 0] * len(x.terms) + term[term >= 0])
    cell, term = key // len(x.terms), key % len(x.terms)
    held = x.start[term + 1] > x.start[term]
    cell, term = cell[held], term[held]
    out, step = [], max(1, tile // blocks)
    for low in range(0, int(base[-1]) - 1, step):  # passages low to high, each of two halves
        n = min(step, int(base[-1]) - 1 - low)
        a, b = np.searchsorted(cell, [low, low + n + 1])
        for h, i in _candidates(x, cell[a:b] - low, term[a:b], n):
            doc = int(np.searchsorted(base, h + low, "right")) - 1
            first = (int(h) + low - int(base[doc])) * x.half
            score = _score(x.own[i], ids[doc][first : first + 2 * x.half])
            if x.own[i] and score >= x.least[i] * (1 - 1e-9):
                out.append((doc, first, int(i), score))
    return out


def _candidates(x: Index, cell: np.ndarray, term: np.ndarray, n: int):
    """(passage, item) of the items that may reach their thresholds, among n passages: halves k and k + 1."""
    blocks = len(x.need)
    size = x.block_start[term + 1] - x.block_start[term]
    where = _ranges(x.block_start[term], size)
    bound = np.bincount(np.repeat(cell, size) * blocks + x.block[where], x.most[where], (n + 1) * blocks).reshape(n + 1, blocks)
    live = bound[:-1] + bound[1:] >= x.need * 0.999
    for b in np.nonzero(live.any(0))[0]:
        use, at = np.zeros(n + 1, bool), np.nonzero(live[:, b])[0]
        use[at] = use[at + 1] = True
        c, t = cell[use[cell]], term[use[cell]]
        size = x.start[t + 1] - x.start[t]
        where = _ranges(x.start[t], size)
        item, c = x.item[where], np.repeat(c, size)
        mine, width = item // BLOCK == b, min(BLOCK, len(x.own) - b * BLOCK)
        sums = np.bincount(c[mine] * width + item[mine] - b * BLOCK, x.impact[where[mine]], (n + 1) * width).reshape(n + 1, width)
        enough = sums[:-1] + sums[1:] >= (x.least - x.skipped)[b * BLOCK : b * BLOCK + width] * 0.999
        for h, i in zip(*np.nonzero(enough), strict=True):
            yield h, i + b * BLOCK


def leaks(x: Index, texts: list[str | None]) -> list[tuple[int, object, float, float, float]]:
    """(row, item id, score, question overlap, answer overlap), one row for each document and item: the best passage."""
    words = [words_of(t or "") for t in texts]
    get = x.terms.get
    ids = [np.array([get(w, -1) for w in ws], np.int64) for ws in words]
    best: dict[tuple[int, int], tuple] = {}
    for doc, first, i, score in search(x, ids):
        # half a passage more on either side: an item that starts in the passage may end beyond it
        near = words[doc][max(0, first - x.half) : first + 3 * x.half]
        question, answer = (overlap(p, near) for p in x.parts[i])
        if question >= OVERLAP and answer >= OVERLAP:
            best[doc, i] = max(best.get((doc, i), (0.0, 0.0, 0.0)), (score, question, answer))
    return [(doc, x.ids[i], *v) for (doc, i), v in sorted(best.items())]


def _indexes(benchmark: DataFrame, item: str, text: str, part_bytes: int):
    """One index for each part of the benchmark, each of bounded size."""
    rows = benchmark.select(F.col(item).alias("id"), F.col(text).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // part_bytes)
    whole = _whole(rows, n) if n > 1 else lambda k: None
    for k in range(n):
        part = rows.where(_part(n) == k) if n > 1 else rows
        items = [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]
        if items:
            yield benchmark.sparkSession.sparkContext.broadcast(index(items, whole(k)))


def _part(n: int):
    return F.pmod(F.xxhash64("id", "text"), F.lit(n))


def _whole(rows: DataFrame, n: int):
    """Each part's view of the whole benchmark; the driver holds the words of one part at a time."""

    def run(batches):
        for batch in small_batches(batches, 512):
            bags = [Counter(words_of(t or "")) for t in as_strings(batch.column(1))]
            part = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(b) + 1 for b in bags])
            # a null word has the item's length
            word, times = [w for b in bags for w in (None, *b)], [x for b in bags for x in (sum(b.values()), *b.values())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(word, pa.binary()), pa.array(times, pa.int64())], names=["part", "word", "times"])

    said = rows.select(_part(n).cast("long").alias("part"), "text").mapInArrow(run, "part long, word binary, times long")
    counts = materialize(said.groupBy("part", "word").agg(F.count("*").alias("items"), F.sum("times").alias("times"), F.max("times").alias("longest")), "benchmark-words")
    items, times, longest = counts.where("word is null").agg(F.sum("items"), F.sum("times"), F.max("longest")).first()
    total = counts.where("word is not null").groupBy("word").agg(F.sum("items").alias("df"))

    def view(k: int) -> Whole:
        got = counts.where(F.col("part") == k).join(total, "word").select("word", "df").toArrow()
        return Whole(items, times / items, longest, dict(zip(got["word"].to_pylist(), got["df"].to_pylist(), strict=True)))

    return view


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, item, bm25, question_overlap, answer_overlap) of every contaminated document; no shuffle."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = plain.schema["key"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    schema = f"key {kinds[0]}, item {kinds[1]}, bm25 double, question_overlap double, answer_overlap double"
    found = None
    for shared in _indexes(benchmark, item, item_text, part_bytes):

        def run(batches, shared=shared):
            for batch in small_batches(batches, 64):
                got = leaks(shared.value, as_strings(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), *(pa.array([g[k] for g in got], item_type if k == 1 else pa.float64()) for k in range(1, 5))],
                    names=["key", "item", "bm25", "question_overlap", "answer_overlap"],
                )

        part = plain.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    found = docs.sparkSession.createDataFrame([], schema) if found is None else found
    return found.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of `docs` that hold no item, all columns unchanged; no shuffle."""
    for shared in _indexes(benchmark, item, item_text, part_bytes):

        def run(batches, shared=shared):
            for batch in small_batches(batches, 64):
                bad = {g[0] for g in leaks(shared.value, as_strings(batch.column(text)))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
