"""Near duplicates by the chosen-path set similarity join.

A document is the set of its word shingles, embedded as minwise tokens: under each of many hash functions the shingle
with the smallest hash. Two sets have equal tokens at a coordinate with a probability that is their similarity. A tree
starts with all sets in one node, split by BRANCHES tokens, one after the other. A node below branches WIDTH times, each
time by DEPTH tokens at once that are chosen by its path, so similar sets meet further down with a probability that
hardly falls with the depth: with s for the similarity a pair that is in a node is lost below it with probability
q = (1 - s ** DEPTH * (1 - q)) ** WIDTH, which is 0.013 for s = 0.85. In nodes of up to NODE sets all are compared.
TREES independent trees lose less than one link in a million at the similarity asked for (0.15 ** 8 where the first
split is enough), and far fewer beyond it.

Sets are compared by size and by one bit of each of 256 minwise hashes first, and what that leaves by the whole sets.
The bound on the bits is so wide that it loses one link in 10 million.

Equal sets are one member. A larger node first compares all its members with its leader, the one whose bits are nearest
to the majority's, as the original of a group of near copies has them. Members similar to it leave the node with it, so
a group costs comparisons in proportion to its size; the others branch on, or are compared if few are left.
Members that stay are compared with each other only if what they lack and add to the leader leaves their likeness open.
A member that stays may still be similar to one that left: by the triangle inequality of the Jaccard distance its
similarity with the leader is then at least 2 * similarity - 1. Where such a member is not in the leader's component in
the end, it is compared with those that left with this leader, under the same condition.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.llm.common import hinted, settle
from pairsignal.llm.simhash import connected
from pairsignal.llm.word_sets import FEATURES, MARKS, alike, compared, sketch, through_followers, within, without_copies

SHINGLE = 5
PERCENT = 85
TREES = 4
BRANCHES = 2  # tokens a tree's root splits by, each for itself
WIDTH, DEPTH = 6, 4  # branches below, and the tokens each of them splits by together
NODE = 32
SPARSE = 1024  # larger nodes of up to this size are compared whole too, if few are similar to their leader
MARKED = 50  # percent of similarity with the leader from which on it is kept how a member differs from it
COORDINATES = 64  # tokens that are kept for branching


def _roots() -> Column:
    """The nodes below the roots of all trees, each by a coordinate of its own."""
    found = [F.xxhash64(F.lit(c // BRANCHES), F.lit(c), F.get("tokens", F.lit(c))) for c in range(TREES * BRANCHES)]
    return F.explode(F.array(*found)).alias("node")


def _children(level: int) -> Column:
    """The nodes below a node: each branch splits by the tokens at DEPTH coordinates that depend on the node's path."""
    first, rest = TREES * BRANCHES, COORDINATES - TREES * BRANCHES
    start = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(rest)).cast("int")
    strides = [k for k in range(1, rest // 2) if gcd(k, rest) == 1]  # a stride visits every coordinate once
    stride = F.element_at(F.lit(strides), F.pmod(F.xxhash64("node", F.lit(-level)), F.lit(len(strides))).cast("int") + 1)
    found = []
    for branch in range(WIDTH):
        coordinates = [F.lit(first) + F.pmod(start + F.lit(branch * DEPTH + d) * stride, F.lit(rest)) for d in range(DEPTH)]
        found.append(F.xxhash64("node", *[x for c in coordinates for x in (c, F.get("tokens", c))]))
    return F.explode(F.array(*found)).alias("child")


def _leaders(many: DataFrame) -> DataFrame:
    """node and leader: the member with the fewest bits that differ from the majority of the node's members."""
    voted = ["b0"]  # 64 bits tell the original of a group from its copies well enough

    def bit(word: Column, k: int) -> Column:
        return F.shiftrightunsigned(word, k).bitwiseAND(F.lit(1))

    votes = many.groupBy("node").agg(*[F.sum(2 * bit(F.col(w), k) - 1).alias(f"{w}_{k}") for w in voted for k in range(64)])
    one = [F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)]
    none = F.lit(0).cast("bigint")
    majority = votes.select("node", *[reduce(Column.bitwiseOR, [F.when(F.col(f"{w}_{k}") > 0, one[k]).otherwise(none) for k in range(64)]).alias(f"m_{w}") for w in voted])
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"m_{w}"))) for w in voted), F.lit(0))
    nearest = F.min(F.struct(apart.alias("apart"), F.xxhash64("row").alias("h"), "row", *FEATURES)).alias("leader")
    return many.join(settle(majority), "node").groupBy("node").agg(nearest)


def links(members: DataFrame, docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, node: int = NODE, sparse: int = SPARSE) -> DataFrame:
    """x, y: pairs of members (rows with different sets) at or over the percentage, enough to connect all that are."""
    heads = members.select("row", "key")
    loose = max(0, 2 * percent - 100)
    current = settle(members.select("row", *FEATURES, _roots()))
    few_pairs: list[DataFrame] = []
    led: list[DataFrame] = []
    level = 0

    def all_pairs(few: DataFrame) -> DataFrame:
        x, y = few.alias("x"), few.alias("y")
        open_ = F.coalesce(within("x", "y", percent), F.lit(True))  # not known of nodes that had no leader
        close = (F.col("x.node") == F.col("y.node")) & (F.col("x.row") < F.col("y.row")) & alike("x", "y", percent) & open_
        return settle(x.join(y, close).select(F.col("x.row").alias("x"), F.col("y.row").alias("y")))

    tokens = members.select("row", "tokens")
    unmarked = [F.lit(None).cast("long").alias(c) for c in ("shared", "total", *MARKS)]
    waiting = current.limit(0).select("node", "row", *FEATURES, *unmarked)  # nodes that the level before leaves to be compared whole
    while True:
        level += 1
        nodes = settle(current.groupBy("node").agg(F.count("*").alias("held")).filter("held > 1"))
        small = current.join(hinted(nodes.filter(F.col("held") <= node).select("node")), "node", "left_semi")
        few_pairs.append(all_pairs(small.select("node", "row", *FEATURES, *unmarked).unionByName(waiting)))
        large = nodes.filter(F.col("held") > node).select("node")
        if not large.limit(1).count():
            break
        many = current.join(hinted(large), "node", "left_semi")
        many = settle(many if "tokens" in many.columns else many.join(tokens, "row"))
        tried = many.join(hinted(settle(_leaders(many))), "node").filter("row <> leader.row")
        asked = tried.select(F.struct("row", *FEATURES).alias("x"), F.col("leader").alias("y")).filter(alike("x", "y", min(loose, MARKED)))
        asked = settle(asked.select(F.col("x.row").alias("x"), F.col("y.row").alias("y")).distinct())
        found = compared(asked, docs, heads, words, min(loose, MARKED), marked=True)
        found = settle(found.withColumn("linked", F.col("shared") * 100 >= F.col("total") * percent))
        led.append(found.filter(F.col("shared") * 100 >= F.col("total") * loose))
        with_leader = tried.select("node", "row", *FEATURES, "tokens", F.col("leader.row").alias("lead"))
        follows = F.when(F.col("linked"), 1).alias("follows")
        known = found.select(F.col("x").alias("row"), F.col("y").alias("lead"), follows, "shared", "total", *MARKS)
        judged = settle(with_leader.join(hinted(known), ["row", "lead"], "left").drop("lead"))
        left = settle(judged.groupBy("node").agg(F.count_if(F.col("follows").isNull()).alias("left"), F.count("follows").alias("gone")))
        rest = judged.filter("follows is null").drop("follows")
        whole = (F.col("left") <= node) | ((F.col("left") <= sparse) & (F.col("gone") * 8 <= F.col("left")))
        waiting = rest.join(hinted(left.filter(whole).select("node")), "node", "left_semi").select("node", "row", *FEATURES, "shared", "total", *MARKS)
        on = rest.join(hinted(left.filter(~whole).select("node")), "node", "left_semi")
        current = settle(on.select("row", *FEATURES, "tokens", _children(level)).drop("node").withColumnRenamed("child", "node"))
    return through_followers(few_pairs, led, members, docs, words, percent)


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, node: int = NODE, sparse: int = SPARSE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A set has the distinct shingles of `words` words (A-Z lower-cased, between ASCII white space); fewer words are one
    shingle; no words or no text are an empty set, linked with nothing. Documents are linked where 100 * intersection >=
    percent * union. component_id is the smallest doc_id reachable (null only if no row of the component has an id);
    kept rows are those that carry it. Repeated rows give repeated rows. Only doc_id and text are read.
    """
    rows = settle(sketch(docs, words, COORDINATES))
    members, copies = without_copies(rows)
    found = links(members, docs, words, percent, node, sparse)
    roots = settle(connected(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    named = (
        rows.select("doc_id", "n", "row").join(hinted(copies), "row", "left")
        .withColumn("node", F.coalesce("first", "row")).join(hinted(roots), "node", "left")
        .select("doc_id", "n", F.coalesce("root", "node").alias("component"))
    )
    named = settle(named)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
