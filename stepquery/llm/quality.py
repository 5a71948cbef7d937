"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte bigrams and a few measures of form (repetition, symbols, capitals), weighted by tf-idf. The latent
space is the truncated singular value decomposition of a bounded sample of labelled rows; the sample's latent vectors
(at most LABELLED x DIMENSIONS numbers, a proven bound) are broadcast. Every document's cosine with every one of them is
computed exactly, block by block, and the labels of the NEIGHBOURS most similar ones are weighted by similarity.

Defined results: a text that is null or has no character but white space scores 0; without any labelled row every other text scores 0.5, and
with labels of one kind that kind's; ties between neighbours fall to the earlier row of the sample, which is ordered by
a hash of its id; repeated label rows count once; a row's other columns (id, lang, source, labels) are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

#: The bound of the sample of labelled rows.
LABELLED = 4096
#: Hashed terms, latent dimensions, voters, and the power of the similarity that weights a vote.
TERMS, DIMENSIONS, NEIGHBOURS, POWER = 2048, 64, 24, 8
#: Steps of each measure of form, and how much a measure weighs beside the bigrams.
STEPS, FORM = 8, 1.5
THRESHOLD = 0.3
MEASURES = 5
WIDTH = TERMS + MEASURES * STEPS
#: Columns beyond the dimensions and rounds of the subspace iteration; labelled rows worked on at once.
OVERSAMPLE, ROUNDS, BLOCK = 32, 12, 512

#: The bucket of each pair of bytes (multiplicative hashing).
BUCKET = ((np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.uint16)
SYMBOL = np.array([chr(b) in "!#$%&*+/<=>@\\^_`{|}~[]" for b in range(256)])


def terms(data: bytes) -> np.ndarray:
    """Counts of hashed bigrams, then the measures of form as soft steps."""
    out = np.zeros(WIDTH, np.float32)
    b = np.frombuffer(data, np.uint8)
    words = data.split()
    if not words:
        return out
    if len(b) > 1:
        out[:TERMS] = np.bincount(BUCKET[(b[:-1].astype(np.uint16) << 8) | b[1:]], minlength=TERMS)
    counts = np.bincount(b, minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    measures = (
        sum(map(eq, words, words[1:])) / len(words),
        len(set(words)) / len(words) ** 0.8,
        counts[SYMBOL].sum() * 4 / len(b),
        counts[65:91].sum() / max(1, letters),
        min(1.0, len(b) / len(words) / 40),
    )
    for k, m in enumerate(measures):
        at = min(max(float(m), 0.0), 0.999) ** 0.5 * (STEPS - 1)
        lo = int(at)
        out[TERMS + k * STEPS + lo] += 1 - (at - lo)
        out[TERMS + k * STEPS + lo + 1] += at - lo
    return out


@dataclass(frozen=True)
class Model:
    """What is broadcast: weights, the latent basis, and the voters' unit vectors with their labels."""

    weight: np.ndarray
    basis: np.ndarray
    voters: np.ndarray
    label: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = unit(weighted(counts) * self.weight) @ self.basis
        return unit(z)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes for every row of a block against all voters."""
        empty = counts.sum(1) == 0
        if not len(self.label):
            return np.where(empty, 0.0, 0.5)
        cosine = self.latent(counts) @ self.voters.T
        near = nearest(cosine, min(NEIGHBOURS, len(self.label)))
        w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3).astype(np.float64) ** POWER
        return np.where(empty, 0.0, np.clip((w * self.label[near]).sum(1) / w.sum(1), 0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; of equal values the earlier columns."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    chosen = np.take_along_axis(cosine, near, 1)
    last = chosen.min(1, keepdims=True)
    # only a tie at the last place leaves a choice
    for row in np.nonzero((cosine == last).sum(1) > (chosen == last).sum(1))[0]:
        near[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return near


def weighted(counts: np.ndarray) -> np.ndarray:
    x = counts.copy()
    x[:, :TERMS] = unit(np.log1p(x[:, :TERMS]))
    x[:, TERMS:] *= FORM
    return x


def pack(counts: np.ndarray) -> bytes:
    """A row's places that are not zero, then their values."""
    at = np.nonzero(counts)[0].astype(np.uint16)
    return at.tobytes() + counts[at].tobytes()


def unpack(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH), np.float32)
    for i, row in enumerate(rows):
        n = len(row) // 6
        out[i, np.frombuffer(row, np.uint16, n)] = np.frombuffer(row, np.float32, n, 2 * n)
    return out


def directions(gram: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors, by subspace iteration from a fixed start; no more than k + OVERSAMPLE columns are held."""
    q = np.random.Generator(np.random.PCG64(7)).standard_normal((len(gram), min(len(gram), k + OVERSAMPLE))).astype(np.float32)
    for _ in range(ROUNDS):
        q = np.linalg.qr(gram @ q)[0]
    _, turn = np.linalg.eigh(q.T @ (gram @ q))
    return np.ascontiguousarray((q @ turn)[:, ::-1][:, :k])


def fit(rows: list[bytes], label: np.ndarray) -> Model:
    """Weights and basis from the labelled sample, packed rows that are unpacked a block at a time."""
    if not len(label):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    blocks = [rows[at : at + BLOCK] for at in range(0, len(rows), BLOCK)]
    seen = sum((unpack(b) > 0).sum(0) for b in blocks)
    rare = np.log((1 + len(rows)) / (1 + seen)) + 1
    rare[TERMS:] = 1
    weight, gram = rare.astype(np.float32), np.zeros((WIDTH, WIDTH), np.float32)
    for b in blocks:
        x = unit(weighted(unpack(b)) * weight)
        gram += x.T @ x
    basis = directions(gram, min(DIMENSIONS, len(rows)))
    model = Model(weight, basis, np.zeros((0, 1), np.float32), label.astype(np.float64))
    return Model(weight, basis, np.concatenate([model.latent(unpack(b)) for b in blocks]), model.label)


def held_out(key) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED) -> Model:
    """Fit on at most `most` labelled rows that are not held out: those with the smallest hash of their id."""
    marked = labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    sample = marked.orderBy(F.xxhash64("key"), "key").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")

    def run(batches):
        for batch in small_batches(batches, 256):
            made = [pack(terms(x)) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label").cast(pa.int32()), pa.array(made, pa.binary())], names=["key", "label", "terms"])

    kind = rows.schema["key"].dataType.simpleString()
    # of rows with one id the least counts as its text, wherever they lie
    once = rows.mapInArrow(run, f"key {kind}, label int, terms binary").groupBy("key", "label").agg(F.min("terms").alias("terms"))
    got = once.orderBy(F.xxhash64("key"), "key").select("label", "terms").toArrow()
    return fit(got["terms"].to_pylist(), got["label"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` columns `key` and `score`, one row per input row, computed where the text is read (no shuffle)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in small_batches(batches, 256):
            got = shared.value.score(np.stack([terms(x) for x in as_bytes(batch.column(1))])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["key", "score"])

    return plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `least`, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches, 256):
            if batch.num_rows:
                got = shared.value.score(np.stack([terms(x) for x in as_bytes(batch.column(text))]))
                yield batch.filter(pa.array(got >= least))

    return docs.mapInArrow(run, docs.schema)
