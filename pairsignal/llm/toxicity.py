"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models; each later model sees the probabilities of the
earlier ones. In training these are out-of-fold predictions, so that a later model learns from probabilities as they
are on unseen documents. Features are words and beginnings of words. Their counts per category are taken over all
labelled documents; the features that tell a category apart best make the models' input, and only the fit itself uses
a sample of at most SAMPLE rows.
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
from pairsignal.llm.tokens import parts

CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
SAMPLE = 20_000
FEATURES = 3_000  # of each category
TELLING = 1.0  # least difference of a feature's log rates inside and outside a category
COUNTED = 4 << 20  # bytes of text whose features are added up at once
PREFIXES = (4, 5, 6)
FOLDS = 4
WORDS = re.compile(r"[^\W\d_]+")


def _hash(name: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(name) >> 1


def features_of(word: str) -> tuple[int, ...]:
    """The word and its beginnings, as numbers."""
    word = word.lower()
    return (_hash("=" + word), *(_hash(f"{n}{word[:n]}") for n in PREFIXES if len(word) > n))


def _words(text: str | None) -> set[str]:
    found: set[str] = set()
    for words in words_in_parts(WORDS, text):
        found.update(words)
    return found


def feature_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, n and one count per category, over all rows; added up inside each batch first."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("feature", "n", *names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(features_of)
        for batch in parts(batches, "text", COUNTED):
            marks = np.array([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))], np.int64).reshape(len(names), -1)
            held, owner = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = {f for w in _words(text) for f in known[w]}
                held.append(np.fromiter(own, np.int64, len(own)))
                owner.append(np.full(len(own), i))
            if not held:
                continue
            every, who = np.concatenate(held), np.concatenate(owner)
            distinct, at = np.unique(every, return_inverse=True)
            sums = [np.bincount(at, minlength=len(distinct)), *(np.bincount(at, weights=m[who], minlength=len(distinct)).astype(np.int64) for m in marks)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *(pa.array(x.astype(np.int64)) for x in sums)], names=schema.fieldNames())

    return rows.select("text", *names).mapInArrow(work, schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


class Rows:
    """Sparse 0/1 rows for numpy."""

    def __init__(self, lists: list[list[int]], width: int):
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.col = np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=e[self.row], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100, ridge: float = 1e-4) -> np.ndarray:
    """Weights for the sparse columns, the extra columns and a constant: logistic loss, Adam with full gradients."""
    dense = np.hstack([extra, np.ones((x.n, 1))])
    w = np.zeros(x.width + dense.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    weight = weight / max(weight.sum(), 1e-12)
    for t in range(1, steps + 1):
        e = (_sigmoid(x.dot(w[: x.width]) + dense @ w[x.width:]) - y) * weight
        g = np.concatenate([x.back(e), dense.T @ e]) + ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w


def predict(x: Rows, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x.dot(w[: x.width]) + np.hstack([extra, np.ones((x.n, 1))]) @ w[x.width:])


def fit_chain(x: Rows, marks: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], float]:
    """One model per category, the earlier ones' out-of-fold probabilities among its inputs, and the last one's threshold."""
    models, seen = [], np.zeros((x.n, 0))
    for y in marks:
        out = np.full(x.n, y.mean() if x.n else 0.0)
        for f in range(FOLDS):
            inside = (folds != f).astype(float)
            if inside.any() and not inside.all():
                w = fit_linear(x, seen, y, inside)
                out[folds == f] = predict(x, seen, w)[folds == f]
        models.append(fit_linear(x, seen, y, np.ones(x.n)))
        seen = np.hstack([seen, out[:, None]])
    best, threshold = -1.0, 0.5
    for t in sorted(np.arange(0.2, 0.91, 0.05), key=lambda t: abs(t - 0.5)):  # of equally good ones that nearest to a half
        said = seen[:, -1] >= t
        score = 2 * (said & (marks[-1] > 0)).sum() / max(1, said.sum() + marks[-1].sum())
        if score > best + 1e-9:
            best, threshold = score, float(t)
    return models, threshold


def train(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, sample: int = SAMPLE, most: int = FEATURES) -> tuple[dict[int, int], list[np.ndarray], float]:
    """The selected features with their columns, the models and the threshold."""
    names = [name for name, _ in chain]
    marked = settle(labels.select("doc_id", *[F.expr(e).cast("long").alias(n) for n, e in chain]))
    counts = settle(feature_counts(with_labels(docs, marked, names), names))
    totals = with_labels(docs.select("doc_id", F.lit("").alias("text")), marked, names).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    chosen: dict[int, int] = {}
    for name in names:
        positive, n = totals[name] or 0, totals["n"]
        if not 0 < positive < n:
            continue
        rate = (F.col(name) + 0.5) / (positive + 1)
        other = (F.col("n") - F.col(name) + 0.5) / (n - positive + 1)
        ratio = F.abs(F.log(rate / other))
        best = counts.filter("n >= 3").filter(ratio >= TELLING).select("feature", (ratio * F.sqrt("n")).alias("tells")).orderBy(F.desc("tells"), "feature").limit(most)
        for r in best.collect():  # at most `most` rows
            chosen.setdefault(r["feature"], len(chosen))
    rows = with_labels(docs, marked, names, sampled(marked, sample))
    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("columns", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.LongType()) for c in names]])

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda w: tuple(chosen[f] for f in features_of(w) if f in chosen))
        for batch in batches:
            lists = [sorted({c for w in _words(t) for c in known[w]}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), *(batch.column(i + 2) for i in range(len(names)))], names=schema.fieldNames())

    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    got = rows.select(fold.alias("fold"), "text", *names).mapInArrow(columns, schema).collect()  # the bounded sample
    got.sort(key=lambda r: (r["fold"], r["columns"], *(r[c] for c in names)))
    x = Rows([r["columns"] for r in got], len(chosen))
    marks = np.array([[r[c] for r in got] for c in names], float).reshape(len(names), len(got))
    models, threshold = fit_chain(x, marks, np.array([r["fold"] for r in got], int))
    return chosen, models, threshold


def score(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, sample: int = SAMPLE, most: int = FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, one probability per category (p_<name>), and `rejected`: the last category's is over the threshold.

    One row per row of docs. Null and empty texts get what the constants say; null ids and labels are not learned
    from; with no labels, or one class only, nothing is rejected. `keep` names columns of docs to pass through.
    """
    names = [name for name, _ in chain]
    chosen, models, threshold = train(docs, labels, chain, sample, most)
    width = len(chosen)
    weights = np.array([m[:width] for m in models]).reshape(len(models), width)
    chained = [m[width:] for m in models]
    passed = list(keep) or ["doc_id"]
    schema = T.StructType([*[docs.schema[c] for c in passed], *[T.StructField(f"p_{c}", T.DoubleType()) for c in names], T.StructField("rejected", T.BooleanType())])
    able = width > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda w: tuple(chosen[f] for f in features_of(w) if f in chosen))
        for batch in parts(batches, "_text"):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sums = np.zeros((len(texts), len(models)))
            for i, text in enumerate(texts):
                columns = {c for w in _words(text) for c in known[w]}
                if columns:
                    sums[i] = weights[:, list(columns)].sum(1)
            seen = np.zeros((len(texts), 0))
            for j, own in enumerate(chained):
                p = _sigmoid(sums[:, j] + np.hstack([seen, np.ones((len(texts), 1))]) @ own)
                seen = np.hstack([seen, p[:, None]])
            rejected = (seen[:, -1] >= threshold) & able
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(passed))), *(pa.array(seen[:, j]) for j in range(len(names))), pa.array(rejected)], names=schema.fieldNames())

    return docs.select(*passed, text_of().alias("_text")).mapInArrow(work, schema)
