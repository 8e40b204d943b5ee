"""What the two classifiers share: labelled rows, a bounded sample of them, and word lists of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.llm.common import hinted, parts_of, settle

REMEMBERED = 400_000  # words a worker keeps values for; then it starts anew


class Remembered(dict):
    """Values of words, worked out once each."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.make(word)
        return value


def words_in_parts(pattern: re.Pattern, text: str | None) -> Iterator[list[str]]:
    for part in parts_of(text or ""):
        yield pattern.findall(part)


def with_labels(docs: DataFrame, labels: DataFrame, columns: list[str], keep: Column | None = None) -> DataFrame:
    """doc_id, text and label columns of the documents that have all these labels; of repeated labels the largest."""
    known = labels.select("doc_id", *columns).dropna()
    if keep is not None:
        known = known.filter(keep)
    known = settle(known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns]))
    return docs.select("doc_id", "text").join(hinted(known), "doc_id")


def sampled(labels: DataFrame, most: int) -> Column:
    """Keeps about `most` labelled documents at most, chosen by a hash of doc_id."""
    n = labels.select("doc_id").distinct().count()
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))
