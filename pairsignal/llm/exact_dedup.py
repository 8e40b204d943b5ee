"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. All distinct blocks are sorted and get integers as names; then neighbouring
names are paired, the distinct pairs sorted and named, and so on until one name is left. Two texts have the same last
name on the same level if and only if they are equal: nothing rests on a hash being free of collisions.

Sorting by whole blocks would shuffle every text twice. Blocks are therefore sorted by a 128-bit fingerprint of which
the job has proved, by grouping the blocks themselves, that no two distinct blocks share it; if some do, another seed
is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.llm.common import lower_ascii, settle, sorted_places, text_of

BLOCK_CHARS = 4096


def _blocks(text: Column, block_chars: int) -> Column:
    """The text cut behind every block_chars characters; behind a character outside the basic plane it stays whole."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_remove(F.split(text, f"(?s)(?<=\\G.{{{block_chars}}})"), ""))


def _finger(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(seed + 1), block).alias("b"))


def _proved(docs: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """The fingerprints of all distinct blocks, and a seed for which none is shared."""
    seed = 0
    while True:
        distinct = docs.select(F.explode_outer(_blocks(F.col("_text"), block_chars)).alias("block")).filter(F.col("block").isNotNull()).distinct()
        fingers = settle(distinct.groupBy(_finger(F.col("block"), seed).alias("finger")).agg(F.count("*").alias("n")))
        if not fingers.filter("n > 1").limit(1).count():
            return fingers.select("finger.*"), seed
        seed += 2


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Integers in sorted order for distinct rows (with gaps between the partitions of the sort)."""
    placed = sorted_places(distinct, *order)
    return placed.select(*order, (F.shiftleft("part", 33) + F.col("at")).alias("name"))


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`_row, doc_id, text_sha256, level, name` for every row of docs; equal texts (A-Z lower-cased) share level and name.

    An empty or null text has level -1. Rows with a null doc_id and repeated rows are rows like all others.
    """
    lowered = docs.select("doc_id", lower_ascii(text_of()).alias("_text"))
    fingers, seed = _proved(lowered, block_chars)
    rows = settle(lowered.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.sha2("_text", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("_text"), block_chars), lambda b: _finger(b, seed)).alias("fingers"),
    ))
    names = _named(fingers, "a", "b")
    state = settle(
        rows.select("_row", F.size("fingers").alias("left"), F.posexplode("fingers").alias("pos", "f"))
        .select("_row", "left", "pos", F.col("f.a").alias("a"), F.col("f.b").alias("b"))
        .join(names, ["a", "b"]).select("_row", "left", "pos", "name")
    )
    level = 0
    done = state.filter("left = 1").select("_row", F.lit(0).alias("level"), "name")
    state = state.filter("left > 1")
    while state.limit(1).count():
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = settle(
            state.groupBy("_row", "left", F.expr("pos div 2").alias("half"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        )
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        state = settle(
            pairs.join(names, ["a", "b"])
            .select("_row", F.expr("(left + 1) div 2").alias("left"), F.col("half").alias("pos"), "name")
        )
        done = done.unionByName(state.filter("left = 1").select("_row", F.lit(level).alias("level"), "name"))
        state = state.filter("left > 1")
    done = done.unionByName(rows.filter(F.size("fingers") == 0).select("_row", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name")))
    return rows.select("_row", "doc_id", "text_sha256").join(done, "_row")


def deduplicate(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (a null is smaller than every id); of several rows that carry
    this id one stays. Other columns of docs are not read, so their names cannot clash.
    """
    named = settle(identities(docs, block_chars))
    groups = settle(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", F.negative("_row").alias("_back"))).alias("_best"), F.count("*").alias("group_size")))
    best = F.col("_best")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", best["doc_id"].alias("keep_id"), "group_size", (F.negative("_row") == best["_back"]).alias("kept"), "text_sha256",
    )
