"""Quality by random-indexing word vectors and a small network.

Every word has a fixed sparse random vector (by its hash); a word's context vector is the sum of its neighbours' random
vectors over all documents. Words share BUCKETS rows by hash, so the table has one size however large the corpus is,
while the sums in it come from every word of it. A document is the pooled vectors of its words; a network of two layers
in numpy, fitted on a sample of at most SAMPLE labelled rows, gives its score, and a temperature fitted on rows it was
not trained on makes the score a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignal.llm.common import settle, text_of
from pairsignal.llm.labelled import Remembered, sampled, with_labels, words_in_parts

BUCKETS = 1 << 14
DIMENSIONS = 48
NONZERO = 4
REACH = 2  # neighbours on each side
SAMPLE = 20_000
HIDDEN = 24
THRESHOLD = 0.3
WORDS = re.compile(r"\w+|[^\w\s]+")


def _bucket(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word) % BUCKETS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's random vector."""
    draw = np.random.default_rng(7)
    return draw.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), draw.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _ids(known: Remembered, text: str | None) -> Iterator[np.ndarray]:
    for words in words_in_parts(WORDS, text):
        yield np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vector of every bucket, of unit length, summed over all documents (each word of all texts)."""
    schema = "bucket int, sums array<float>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (places, signs) = Remembered(_bucket), index_vectors()
        sums, filled = np.zeros(BUCKETS * DIMENSIONS), False
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for ids in _ids(known, text):
                    for step in range(1, REACH + 1):
                        for a, b in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                            if len(a):
                                filled = True
                                at = (a[:, None] * DIMENSIONS + places[b]).ravel()
                                np.add.at(sums, at, signs[b].ravel())
        if filled:
            table = sums.reshape(BUCKETS, DIMENSIONS).astype(np.float32)
            own = np.flatnonzero(table.any(1))
            yield _arrays(own, table[own])

    def _arrays(buckets: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * DIMENSIONS)
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))], names=["bucket", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, row in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, DIMENSIONS)):
                total[bucket] = total[bucket] + row if bucket in total else row.astype(np.float64)
        if total:
            yield _arrays(np.array(list(total)), np.array(list(total.values()), np.float32))

    table = np.zeros((BUCKETS, DIMENSIONS))
    for r in docs.select(text_of().alias("text")).mapInArrow(gather, schema).repartition("bucket").mapInArrow(add, schema).collect():  # BUCKETS rows
        table[r["bucket"]] = r["sums"]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(known: Remembered, vectors: np.ndarray, text: str | None) -> np.ndarray:
    """Mean, mean square and mean product with the next word's, of the vectors of a text's words."""
    total, square, beside, n, m, same = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0, 0, 0
    for ids in _ids(known, text):
        for i in range(0, len(ids), 1 << 14):
            v = vectors[ids[i:i + (1 << 14)]]
            total += v.sum(0)
            square += np.einsum("ij,ij->j", v, v)
            beside += np.einsum("ij,ij->j", v[:-1], v[1:])
            n, m = n + len(v), m + max(0, len(v) - 1)
            same += int((ids[i:i + (1 << 14)][:-1] == ids[i:i + (1 << 14)][1:]).sum())
    mean = total / max(n, 1)
    return np.concatenate([mean, square / max(n, 1), beside / max(m, 1), [np.linalg.norm(mean), same / max(m, 1), beside.sum() / max(m, 1), np.log1p(n) / 10]])


WIDTH = 3 * DIMENSIONS + 4


def vectors_of(rows: DataFrame, vectors: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns named and `v`, the pooled vector of the text."""
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("v", T.ArrayType(T.FloatType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(_bucket)
        for batch in batches:
            v = np.array([pooled(known, vectors, t) for t in batch.column(len(keep)).to_pylist()], np.float32).reshape(-1, WIDTH)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * WIDTH)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=schema.fieldNames())

    return rows.select(*keep, text_of().alias("_text")).mapInArrow(work, schema)


class Network:
    """Two layers; scale, weights and temperature are arrays, so that it travels to the tasks as it is."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60):
        draw = np.random.default_rng(seed)
        self.mean, self.sd = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        self.rate = float(np.clip(y.mean(), 0, 1)) if len(y) else 0.5
        self.flat = len(y) < 20 or y.min() == y.max()  # nothing to learn from: the base rate is the score
        self.p = [draw.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        if self.flat:
            return
        order = draw.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5:]
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        moments = [(np.zeros_like(a), np.zeros_like(a)) for a in self.p]
        step = 0
        for _ in range(epochs):
            turn = draw.permutation(used)
            for i in range(0, len(turn), 256):
                at = turn[i:i + 256]
                h = np.tanh(z[at] @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[at]) / len(at)
                back = np.outer(e, self.p[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((z[at].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ e + 1e-4 * self.p[2], np.array([e.sum()]))):
                    a, b = moments[k]
                    a[...] = 0.9 * a + 0.1 * g
                    b[...] = 0.999 * b + 0.001 * g * g
                    self.p[k] -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        logit = self.logits(x[held])
        losses = [(float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / t))), t) for t in np.exp(np.linspace(-1.5, 2.5, 81))]
        self.temperature = min(losses)[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.sd, -8, 8) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    known = settle(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().filter(~_held_out()))
    rows = vectors_of(with_labels(docs, known, ["quality"], sampled(known, sample)), vectors, ["doc_id", "quality"])
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["v"]))  # the bounded sample
    return Network(np.array([r["v"] for r in got], float).reshape(-1, WIDTH), np.array([r["quality"] for r in got], float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Rows whose crc32(doc_id) divides by 5 are held out of training (a null id counts as the empty string, and so is
    held out). Null and empty texts get the score of a text without words. With too few labels, or one class, the score
    is the base rate. Other columns of docs and labels are not read.
    """
    vectors = context_vectors(docs)
    network = train(docs, labels, vectors, sample)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(_bucket)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.array([pooled(known, vectors, t) for t in texts]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(x))], names=schema.fieldNames())

    scored = docs.select("doc_id", text_of().alias("_text")).mapInArrow(work, schema)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
