"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (13 words in a row, or the whole of a shorter item) is a set of shingles that a document has to
contain completely, so its prefix is one shingle: the rarest, by counts over all documents. Only that shingle is
joined. Its place gives the window's place in the document; windows that would begin before the first or end after the
last word are out by position and length, the others are compared word by word.

The words of a document are read, joined and compared in one pass over the text; only true occurrences are shuffled.
The windows are broadcast in blocks of at most BLOCK_ROWS, whatever the benchmark's size: more items mean more passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.llm.common import BROADCAST_ROWS, hinted, row_key, settle, text_of, word_places, words_of

WINDOW = 13
SHINGLE = 3
BLOCK_ROWS = 100_000
SHARE = 20  # contaminated: one word in 20 or more is hit


def _shingle(words: Column, pos: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, pos + i) for i in range(size)])


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window_id, win, len) and which item has which (window_id, item)."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(text_of()).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = settle(words.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i") + 1, window).alias("win")).distinct())
    wins = settle(cut.select("win").distinct().withColumn("window_id", F.monotonically_increasing_id()).withColumn("len", F.size("win")))
    held = settle(cut.filter("item is not null").join(wins, "win").select("window_id", "item").distinct())
    return wins, held


def _blocks(table: DataFrame, rows: int, limit: int) -> list[DataFrame]:
    """The table in pieces of about `limit` rows at most, by a hash, so that each piece may be broadcast."""
    n = -(-max(rows, 1) // limit)
    return [table.filter(F.pmod(F.xxhash64("window_id"), F.lit(n)) == i) for i in range(n)]


def occurrences(docs: DataFrame, wins: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every place of every window: key, start, len, window_id. docs has key and text."""
    size = F.least(F.col("len"), F.lit(SHINGLE))
    at = wins.select("window_id", "win", "len", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("off"))
    hashes = F.when(F.col("size") == 1, _shingle(F.col("win"), F.col("off"), 1)).when(F.col("size") == 2, _shingle(F.col("win"), F.col("off"), 2)).otherwise(_shingle(F.col("win"), F.col("off"), SHINGLE))
    at = settle(at.withColumn("hash", hashes))
    sizes = sorted(r["size"] for r in at.select("size").distinct().collect())  # 1, 2 or 3
    places = word_places(docs, "key")

    def probes(size: int) -> DataFrame:
        return places.withColumn("hash", _shingle(F.col("words"), F.col("pos"), size)).filter(F.col("pos") + size <= F.size("words"))

    found = []
    for size in sizes:
        own = at.filter(F.col("size") == size)
        wanted = settle(own.groupBy("hash").agg(F.max("window_id").alias("window_id")))
        counts = None
        for block in _blocks(wanted, wanted.count(), block_rows):
            seen = probes(size).join(F.broadcast(block.select("hash")), "hash").groupBy("hash").agg(F.count("*").alias("n"))
            counts = seen if counts is None else counts.unionByName(seen)
        counts = settle(counts.groupBy("hash").agg(F.sum("n").alias("n")))
        # A window with a shingle that no document has cannot occur; the others are looked for by their rarest one.
        known = own.join(counts, "hash", "left")
        prefix = settle(
            known.groupBy("window_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "off", "win", "len")).alias("p"))
            .filter("p.n > 0").select("window_id", "p.hash", "p.off", "p.win", "p.len")
        )
        for block in _blocks(prefix, prefix.count(), block_rows):
            start = F.col("pos") - F.col("off")
            fits = (start >= 0) & (start + F.col("len") <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
            found.append(
                probes(size).join(F.broadcast(block.withColumnRenamed("hash", "h")), (F.col("hash") == F.col("h")) & fits)
                .select("key", start.cast("long").alias("start"), F.col("len").cast("long").alias("len"), "window_id")
            )
    if not found:
        return docs.sparkSession.createDataFrame([], "key binary, start long, len long, window_id long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    key is row_key(doc_id, text).
    A null text has no words. Rows equal in doc_id and text get the same figures. Items without words match nothing;
    items without an id mark words but are neither counted nor listed. An empty benchmark marks nothing. Only doc_id
    and text, item_id and text are read.
    """
    base = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    wins, held = windows_of(items, window)
    hits = settle(occurrences(base, wins, block_rows).distinct())
    before = Window.partitionBy("key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    seen = F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("start"))
    covered = hits.select("key", F.greatest(end - seen, F.lit(0)).alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))
    listed = (
        hits.select("key", "window_id").distinct().join(hinted(held), "window_id")
        .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("ids"))  # no longer than a document's own items
    )
    marked = settle(covered.join(listed, "key", "left").select(
        "key", "n_hit", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",").alias("ids"),
    ))
    counted = base.select("key", "doc_id", F.size(words_of(text_of())).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counted.join(hinted(marked, BROADCAST_ROWS), "key", "left").select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(SHARE) * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
