"""Shards by balanced label propagation.

Documents with equal texts are linked through their group. Every document starts on a shard by its id. In each round
a group's members look at the shards where their neighbours are and want to go where most of them are; shards that are
full are tried by turns, for exchanges; quotas per pair of shards let only so many go as come back or as there is room for. Members of a group
on one shard are alike, so a round works on one row per (group, shard) with a count, however large a group is.
Documents without neighbours fill what is left, and counts per shard end at most one apart (law "rows").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.llm.common import hinted, ranked, settle, text_of

SHARDS = 16
ROUNDS = 24
QUIET = 3  # rounds in a row without a move that end the work


def _share(*columns: Column | str) -> Column:
    """A number from 0 to below 1 that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) / F.lit(float(1 << 32))


def _round(state: DataFrame, quota: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """The wanted moves of one round, and what the quotas let through (both one row per (group, shard))."""
    loads = state.groupBy("shard").agg(F.sum("n").alias("load"))
    room = settle(quota.join(F.broadcast(loads), "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room"), "quota"))
    # A group of any size aims at its largest part whose shard is open: it has room, or it may exchange members with others.
    # Which full shards are tried and which of equal parts is taken changes by hash every round. What is on a full
    # shard follows if it is no larger, or if the whole group then fits into the room; a part of half a shard stays.
    open_ = (
        state.join(F.broadcast(room), "shard")
        .withColumn("turn", F.xxhash64("group", "shard", F.lit(number)))
        .withColumn("open", (F.col("room") > 0) | ((F.col("n") < F.col("quota") / 2) & (_share("shard", "group", F.lit(number)) < 0.5)))
    )
    best = open_.groupBy("group").agg(F.sum("n").alias("all"), F.max(F.when(F.col("open"), F.struct("n", "turn", "shard", "room"))).alias("best"))
    there = F.col("best.n")
    ahead = (there > F.col("n")) | ((there == F.col("n")) & (~F.col("open") | (F.col("best.turn") > F.col("turn"))))
    fits = ~F.col("open") & (F.col("all") - there <= F.col("best.room"))
    wish = open_.join(best, "group").select(
        "group", "shard", "n", F.when((F.col("best.shard") != F.col("shard")) & (ahead | fits), F.col("best.shard")).alias("to"),
    )
    wish = settle(wish)
    flows = settle(wish.filter("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("wants")))  # shards squared at most
    back = flows.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("wants").alias("back"))
    into = Window.partitionBy("to")
    allowed = (
        flows.join(F.broadcast(back), ["shard", "to"], "left").withColumn("swap", F.least("wants", F.coalesce("back", F.lit(0))))
        .join(F.broadcast(room.select(F.col("shard").alias("to"), F.greatest("room", F.lit(0)).alias("room"))), "to")
        .withColumn("extra", F.col("wants") - F.col("swap"))
        .withColumn("fit", F.least(F.lit(1.0), F.col("room") / F.greatest(F.sum("extra").over(into), F.lit(1))))
        .select("shard", "to", ((F.col("swap") + F.col("extra") * F.col("fit")) / F.col("wants")).alias("ratio"))
    )
    moved = F.floor(F.col("n") * F.col("ratio") + _share("group", "shard", F.lit(number))).cast("long")
    moves = wish.join(F.broadcast(allowed), ["shard", "to"], "left").withColumn("go", F.least("n", F.coalesce(moved, F.lit(0))))
    return wish, moves


def propagate(state: DataFrame, quota: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Move the members of groups (group, shard, n) under the quotas (shard, quota) until nobody moves."""
    state, quiet = settle(state), 0
    for number in range(rounds):
        _, moves = _round(state, quota, number)
        moves = settle(moves)
        if not moves.filter("go > 0").limit(1).count():
            quiet += 1
            if quiet == QUIET:
                break
            continue
        quiet = 0
        state = settle(
            moves.select("group", F.explode(F.array(
                F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.coalesce("to", "shard").alias("shard"), F.col("go").alias("n")),
            )).alias("x")).select("group", "x.*").filter("n > 0").groupBy("group", "shard").agg(F.sum("n").alias("n"))
        )
    return state


def shard(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    A null text is empty (size 1) and equal to other empty texts; null ids and repeated rows are placed like all
    others; an empty table gives no rows. Only doc_id and text are read.
    """
    text = text_of()
    rows = settle(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), text), F.lit(n_shards)).cast("int").alias("start"),
    ))
    total = rows.count()
    spark = docs.sparkSession
    quota = spark.createDataFrame([(s, total // n_shards + (s < total % n_shards)) for s in range(n_shards)], "shard int, quota long")
    counts = rows.groupBy("group", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    linked = settle(rows.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1"))
    state = propagate(counts.join(linked.select("group"), "group"), quota, rounds)

    # Places inside a group, dealt out to its shards from the largest part down (at most one entry per shard).
    largest = Window.partitionBy("group").orderBy(F.desc("n"), "shard").rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        state.withColumn("end", F.sum("n").over(largest))
        .groupBy("group").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("parts"))
    )
    rows = rows.withColumn("_tie", F.xxhash64("doc_id", "size", "text_crc32")).drop("start")
    placed = ranked(rows.join(linked.select("group"), "group"), "group", "doc_id", "_tie").join(parts, "group")
    settled = placed.withColumn("want", F.filter("parts", lambda p: p["end"] > F.col("rank"))[0]["shard"]).drop("parts", "rank")
    alone = rows.join(linked.select("group"), "group", "left_anti").withColumn("want", F.lit(n_shards))
    wanted = settled.unionByName(alone)
    # Inside a shard groups stand together; what is over its quota, and all without neighbours, fill the other shards.
    inside = settle(ranked(wanted, "want", "group", "doc_id", "_tie"))
    quotas = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}
    loads = {r["want"]: r["n"] for r in inside.groupBy("want").agg(F.count("*").alias("n")).collect()}  # one number per shard
    over, lacks, spare, gap = {}, [], 0, 0
    for s in range(n_shards + 1):
        over[s] = spare
        spare += max(0, loads.get(s, 0) - quotas.get(s, 0))
    for s in range(n_shards):
        room = quotas[s] - min(loads.get(s, 0), quotas[s])
        lacks.append((s, gap, gap + room, quotas[s] - room))
        gap += room
    label = F.create_map(*[F.lit(x) for s in range(n_shards + 1) for x in (s, over[s])])
    limit = F.create_map(*[F.lit(x) for s in range(n_shards + 1) for x in (s, quotas.get(s, 0))])
    turn = F.col("rank") - limit[F.col("want")] + label[F.col("want")]
    home, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, low, high, first in lacks:
        here = (turn >= low) & (turn < high)
        home, slot = F.when(here, F.lit(s)).otherwise(home), F.when(here, turn - low + first).otherwise(slot)
    stays = F.col("rank") < limit[F.col("want")]
    return inside.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(stays, F.col("want")).otherwise(home).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
