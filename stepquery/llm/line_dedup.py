"""Dedup of repeated runs by winnowing.

Every run of at least MIN_WORDS words that occurs earlier, by (id, position), is deleted, wherever in a line it begins and
ends: a word goes exactly when one of the windows of MIN_WORDS words around it has the same words as an earlier window.

Windows are not joined one by one. Each selects a seed, the leftmost of its SEED-word hashes that is least, so equal
windows select the same seed at the same place in them (winnowing). Windows in a row that select one seed make a span. Seeds
selected once are dropped. The spans of the others are joined on the hash of all their words with the first position of
those words: a span that occurs earlier goes whole, and so do its windows. A window can also occur earlier in another span,
one with the same seed and other words at its ends; so where a seed has several spans, the windows of each span's first
occurrence are joined in the same way. No two documents are ever paired.

Defined results: a null text stays null and matches nothing; an empty text stays empty; in a document that loses a run,
blank lines go and lines are trimmed, and other documents keep their text unchanged; rows with the same id are at the
same place, none is later than another, so repeated rows stay equal; a null id is later than all others; other columns
are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, words
from .common import as_bytes, as_strings, free_names, materialize, small_batches, whole_number

#: Words in a row that make a run.
MIN_WORDS = 24
#: Words of a seed are so many eighths of a window's.
SEED = 3
LAST = (1 << 63) - 1
PLACE = np.uint64(0xFFFFFFFF)
PLACE_OF_RUN = "doc", "version", "first", "last"
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes of the spans, which begin and end with words."""
    data, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in sorted(spans):
        kept.append(data[at : max(at, a)])
        at = max(at, b)
    out = b" ".join(x for k in (*kept, data[at:]) if (x := k.strip(b" ")))
    return re.sub(rb" *\n[ \n]*", b"\n", out).strip().decode("utf-8", "surrogatepass")


def bytes_of(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of spans of words."""
    gap = np.concatenate([[True], words.SPACE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], [True]])
    edge = np.nonzero(gap[1:] != gap[:-1])[0]
    return [(int(edge[2 * a]), int(edge[2 * b - 1])) for a, b in spans]


class Windows:
    """Makes the windows of several texts at once, and the spans of those that select the same seed."""

    def __init__(self, least: int):
        self.least, self.seed, self.tables = least, max(1, least * SEED // 8), [words.powers(4096, b) for b in BASES]

    def read(self, texts: list[bytes]) -> bool:
        """Hashes the texts and finds their windows; False if there are none."""
        data = b"\n".join(texts)
        self.offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.word, self.start, self.end = words.split(data)
        w, self.sums = self.word, {}
        if len(w) < self.least:
            return False
        self.base = np.searchsorted(self.start, self.offset)  # each text's first word
        text = np.searchsorted(self.base, np.arange(len(w)), "right") - 1
        begin = np.nonzero(text[: len(w) - self.least + 1] == text[self.least - 1 :])[0]
        if not len(begin):
            return False
        if len(w) >= len(self.tables[0][0]):
            self.tables = [words.powers(2 * len(w), x) for x in BASES]
        at = np.arange(len(w) - self.seed + 1)
        seeds = self.hash(0, at, at + self.seed) * np.uint64(0xC4CEB9FE1A85EC53)
        seeds ^= seeds >> np.uint64(32)
        self.begin, self.text, self.at = begin, text[begin], least_at(seeds, self.least - self.seed + 1)[begin]
        self.prints = seeds[self.at].view(np.int64)
        return True

    def hash(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash k of the words a to b."""
        up, down = self.tables[k]
        if k not in self.sums:
            v = (self.word * np.uint64(0xFF51AFD7ED558CCD)) ^ (self.word >> np.uint64(29)) if k else self.word
            self.sums[k] = np.concatenate([[np.uint64(0)], np.cumsum(v * up[: len(v)], dtype=np.uint64)])
        return (self.sums[k][b] - self.sums[k][a]) * down[a]

    def runs(self, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first word, end word, hash, other hash): words counted within their text."""
        return a - self.base[text], b - self.base[text], self.hash(0, a, b).view(np.int64), self.hash(1, a, b).view(np.int64)

    def selected(self) -> np.ndarray:
        """The first window of each span."""
        return np.nonzero(np.concatenate([[True], self.at[1:] != self.at[:-1]]))[0]

    def spans(self, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans that start with these windows, of all `selected` ones, as `runs`."""
        last = np.concatenate([first[1:], [len(self.begin)]]) - 1
        return self.runs(self.begin[first], self.begin[last] + self.least, self.text[first])

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, first byte, end byte, fingerprint, hash, other hash) of every window, in order of text and first word."""
        if not self.read(texts):
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        stop = self.begin + self.least
        _, _, h1, h2 = self.runs(self.begin, stop, self.text)
        return self.text, self.start[self.begin] - self.offset[self.text], self.end[stop - 1] - self.offset[self.text], self.prints, h1, h2


def _groups(keys: list, versions: list, texts: list[bytes], size: int = 1 << 18):
    """Rows in order, so many at a time that their texts have about `size` bytes."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size or k == len(texts) - 1:
            yield np.array(keys[at : k + 1], np.int64), np.array(versions[at : k + 1], np.int64), texts[at : k + 1]
            at, held = k + 1, 0


def least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of the upper halves of each x[i : i + width]: place and upper half are one number."""
    low, k = (x & ~PLACE) | np.arange(len(x), dtype=np.uint64), 1
    while k < width:
        step = min(k, width - k)
        low = np.minimum(low[:-step], low[step:])
        k += step
    return (low & PLACE).astype(np.int64)


RUN = "doc long, version long, first int, last int, h1 long, h2 long, again boolean"


def _scan(docs: DataFrame, least: int, schema: str, rows, only: bloom.Filter | None = None) -> DataFrame:
    """The columns that `rows` makes of the windows of each group of texts. only: passes over all other documents."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        made = Windows(least)
        for batch in small_batches(batches, 512):
            if only:
                batch = batch.filter(pa.array(only.has(batch.column(0).to_numpy())))
            for doc, version, texts in _groups(batch.column(0).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(1))):
                if made.read(texts):
                    columns = rows(made, doc, version)
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n in ("first", "last") else c) for c, n in zip(columns, names, strict=True)], names=names)

    return docs.mapInArrow(run, schema)


def _prints(made: Windows, doc: np.ndarray, version: np.ndarray) -> tuple[np.ndarray, ...]:
    """One fingerprint for each seed selected."""
    return (made.prints[made.selected()],)


def repeats(text: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which runs have the words of an earlier one of their own text; the runs are in order."""
    with np.errstate(over="ignore"):
        order = np.argsort(h1 ^ (text * np.int64(0x5851F42D4C957F2D)), kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    for c in (text, h1, h2):
        same &= c[order[1:]] == c[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


def _spans(shared: bloom.Filter):
    """Spans whose fingerprint is among `shared`."""

    def rows(made, doc, version):
        first = made.selected()
        ok, text = shared.has(made.prints[first]), made.text[first]
        a, b, h1, h2 = made.spans(first)
        return tuple(c[ok] for c in (doc[text], version[text], a, b, h1, h2, repeats(text, h1, h2), made.prints[first]))

    return rows


def _windows(chosen: bloom.Filter):
    """Windows of the spans whose first hash and document are among `chosen`."""

    def rows(made, doc, version):
        first = made.selected()
        ok = chosen.has(made.spans(first)[2] ^ doc[made.text[first]])
        k = np.nonzero(np.repeat(ok, np.diff(np.concatenate([first, [len(made.begin)]]))))[0]
        text, begin = made.text[k], made.begin[k]
        a, b, h1, h2 = made.runs(begin, begin + made.least, text)
        return doc[text], version[text], a, b, h1, h2, repeats(text, h1, h2)

    return rows


def place_of(docs: DataFrame, key: str) -> F.Column:
    return F.coalesce(whole_number(docs, key), F.lit(LAST))


def _later(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, version, first, last) of the runs whose words occur earlier. groups: (h1, h2, home, n), home the smallest document."""
    again, once = runs.where("again"), runs.where("not again").join(groups.where("n > 1").select("h1", "h2", "home"), ["h1", "h2"])
    return again.select(*PLACE_OF_RUN).unionByName(once.where("doc > home").select(*PLACE_OF_RUN))


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc, version, first, last): spans of words that occur earlier."""
    plain = docs.select(place_of(docs, key).alias("doc"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("version"))
    prints = _scan(plain, least, "print long", _prints).groupBy("print").count().where("count > 1")
    shared = bloom.build(materialize(prints.select("print"), "fingerprints"), "print")
    spans = materialize(_scan(plain, least, RUN + ", print long", _spans(shared)), "spans")
    # the smallest document, a plain number, folds in a hash table; what repeats in one text needs no group
    home = F.min("doc").alias("home"), F.count("*").alias("n")
    groups = materialize(spans.where("not again").groupBy("h1", "h2").agg(*home, F.max("print").alias("print")), "groups")
    several = groups.groupBy("print").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("print")
    first = materialize(groups.join(several, "print").select(F.col("h1").bitwiseXOR(F.col("home")).alias("key"), "home"), "chosen")
    chosen, only = bloom.build(first, "key"), bloom.build(first.select("home").distinct(), "home")
    windows = materialize(_scan(plain, least, RUN, _windows(chosen), only), "windows")
    return _later(spans, groups).unionByName(_later(windows, windows.where("not again").groupBy("h1", "h2").agg(*home)))


def merge(doc: np.ndarray, version: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Disjoint spans of spans that are in order of document, version and first word."""
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])
    shift = np.cumsum(other) << 32
    reach = np.maximum.accumulate(last + shift) - shift  # of the spans so far, in one text
    at = np.nonzero(other | np.concatenate([[True], first[1:] > reach[:-1]]))[0]
    return doc[at], version[at], first[at], reach[np.concatenate([at[1:], [len(doc)]]) - 1]


def _merged(runs: DataFrame) -> DataFrame:
    """(doc, version, spans): disjoint spans in order, each as first word times 2^32 plus end word.

    Runs are sorted by place and merged as they stream by, so no set of a document's runs is ever held.
    """
    ordered = runs.repartition("doc", "version").sortWithinPartitions("doc", "version", "first")

    def pack(doc, version, first, last):
        at = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]))[0]
        offsets = np.concatenate([at, [len(doc)]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(version[at]), pa.ListArray.from_arrays(offsets, first << 32 | last)], names=["doc", "version", "spans"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            if batch.num_rows:
                spans = merge(*(np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)))
                done = np.nonzero((spans[0] != spans[0][-1]) | (spans[1] != spans[1][-1]))[0]
                cut = int(done[-1]) + 1 if len(done) else 0
                if cut:
                    yield pack(*(c[:cut] for c in spans))
                held = [c[cut:] for c in spans]
        if len(held[0]):
            yield pack(*held)

    return ordered.mapInArrow(run, "doc long, version long, spans array<long>")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """`docs` with later repeated runs deleted from `text`, and `words_deleted`."""
    doc, version, spans = free_names(docs, 3)
    runs = materialize(_merged(repeated_runs(docs, key, text, least)), "runs").toDF(doc, version, spans)
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "words_deleted"))
    # by a shuffle whatever the size: texts move once, and costs grow evenly
    joined = kept.join(runs.hint("merge"), (place_of(docs, key) == F.col(doc)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(version)), "left").drop(doc, version)
    schema = kept.schema.add("words_deleted", "long")

    def run(batches):
        for batch in small_batches(batches, 512):
            found = batch.column(spans).to_pylist()
            batch = batch.drop_columns([spans])
            gone, texts = list(repeat(0, batch.num_rows)), None
            for i, s in enumerate(found):
                if s:
                    texts = as_strings(batch.column(text)) if texts is None else texts
                    if texts[i] is None:
                        continue
                    shorter = without(texts[i], bytes_of(texts[i], [(x >> 32, x & 0xFFFFFFFF) for x in s]))
                    gone[i] = len(texts[i].split()) - len(shorter.split())
                    texts[i] = shorter
            if texts is not None:
                batch = batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, batch.schema.field(text).type))
            yield batch.append_column("words_deleted", pa.array(gone, pa.int64()))

    return joined.mapInArrow(run, schema)
