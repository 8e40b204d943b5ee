"""Helpers the text operators share: words, row keys, numbering in sorted order, joins by key."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignal.session import settle

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words once A-Z are lower-cased; letters, digits and all beyond ASCII make words
BROADCAST_ROWS = 200_000  # rows of a table that may be broadcast after it has been counted
_SPACE = re.compile(r"[\t-\r ]")
POSITION_BITS = 33  # monotonically_increasing_id puts the place inside a partition into its lower 33 bits


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Only A-Z lower-cased. A text without other letters takes the short way through lower()."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased, in order."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


PART_CHARS = 1 << 20


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of about PART_CHARS, cut before white space, so that lists of its words need little memory."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = _SPACE.search(text, at + PART_CHARS)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def row_key(*columns: Column) -> Column:
    """A key from a row's content: the same on every run and after every retry; rows that share it are the same row."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("\u0001", *marked), 256))


def word_places(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per word with its place; `words` stays beside it and is read in the same pass, never shuffled."""
    return (
        docs.select(*keep, words_of(text_of()).alias("words"))
        .select(*keep, "words", F.posexplode_outer("words").alias("pos", "word"))
        .filter(F.col("word").isNotNull())
    )


def small(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a settled table has few enough rows to be broadcast."""
    return table.limit(limit + 1).count() <= limit


def hinted(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if counting proves it small; otherwise the join shuffles."""
    return F.broadcast(table) if small(table, limit) else table


def sorted_places(table: DataFrame, *order: str) -> DataFrame:
    """`part` and `at`: where each row stands in a sort over all partitions. Written once, so they stay as they are.

    Sorting is by range, so equal leading values that fill several partitions are split by the columns behind them.
    """
    ordered = table.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return settle(
        ordered.withColumn("_n", number)
        .withColumn("part", F.shiftright("_n", POSITION_BITS))
        .withColumn("at", F.col("_n").bitwiseAND((1 << POSITION_BITS) - 1))
        .drop("_n")
    )


def ranked(table: DataFrame, by: str, *order: str) -> DataFrame:
    """`rank`: the row's place from 0 among those with its value of `by`, in the order given, without one task per value.

    Rows are sorted over all partitions; a table with one row per (value, partition) carries the counts across.
    """
    from pyspark.sql import Window

    placed = sorted_places(table, by, *order)
    pieces = placed.groupBy(by, "part").agg(F.min("at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = settle(pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))))
    return (
        placed.join(hinted(pieces), [by, "part"])
        .withColumn("rank", F.col("at") - F.col("_first") + F.col("_before"))
        .drop("part", "at", "_first", "_rows", "_before")
    )
