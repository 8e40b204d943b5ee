"""Centroid clustering of integer vectors with JVM expressions only.

A vector is an array of integers. Its squared distance to a centroid is zip_with and aggregate against a literal array,
array_min over (distance, number) structs chooses the centroid, and one aggregation with a sum per component gives the
next centroids: k rows of exact integers, whatever the number of vectors. No row leaves the JVM and nothing is
shuffled but the k partial sums of every task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.llm.common import settle

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
LARGEST = 1 << 27  # integers are held within this, so that a squared distance of 64 components fits a long


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double."""
    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(float(-LARGEST))))

    return F.transform(vector, whole)


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has exactly `dims` components, none of them null or non-finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def _nearest(vector: Column, centroids: Sequence[Sequence[int]]) -> Column:
    def distance(centroid: Sequence[int]) -> Column:
        squares = F.zip_with(vector, F.lit(list(centroid)).cast("array<bigint>"), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def seeds(vectors: DataFrame, k: int = CENTROIDS, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, rows without an id last, equal ids by their vectors."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(name.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k)
    return [list(r.v) for r in first.collect()]


def update(vectors: DataFrame, centroids: list[list[int]], dims: int = DIMS) -> list[list[int]]:
    """One round: componentwise floor of the mean of each centroid's vectors; one without vectors stays."""
    chosen = vectors.select("v", _nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    sums = chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    found = list(centroids)
    for r in sums.collect():
        found[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return found


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of table (vec_id, embedding).

    Null vectors, vectors of another length and vectors with a null or non-finite component are left out; a null vec_id
    is kept and is a seed last. Repeated rows count as often as they stand there. Fewer vectors than k make as many
    centroids; no vectors make no rows. Equal distances go to the smaller number. Components whose integer lies beyond
    LARGEST are held there; an inertia that no long can hold is null. Other columns are not read.
    """
    kept = table.filter(usable(F.col("embedding"), dims))
    vectors = settle(kept.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v")))
    centroids = seeds(vectors, k, seed)
    if not centroids:
        nothing = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]).limit(0)
    for _ in range(rounds):
        centroids = update(vectors, centroids, dims)
    assigned = settle(vectors.select("vec_id", _nearest(F.col("v"), centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"))
    own = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}
    everything = None if None in own.values() or sum(own.values()) >= 1 << 63 else sum(own.values())

    def by_cluster(value: Callable[[int], Column]) -> Column:  # k literals
        return F.create_map(*[x for i in own for x in (F.lit(i), value(i))])[F.col("cluster")]

    return assigned.select(
        "vec_id", "cluster", "distance", by_cluster(lambda i: F.lit(own[i]).cast("bigint")).alias("cluster_inertia"), F.lit(everything).cast("bigint").alias("inertia"),
        by_cluster(lambda i: F.sha2(F.lit(",".join(map(str, centroids[i]))), 256)).alias("centroid_sha256"),
    )
