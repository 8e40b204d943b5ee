"""Sets of word shingles: their sketches, comparison by whole sets, and what is left behind leaders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignal.llm.common import hinted, parts_of, row_key, settle, text_of
from pairsignal.llm.simhash import SEED

HASHES = 256
WORDS = HASHES // 64  # longs that hold a bit of each hash
FEATURES = ["n", *[f"b{i}" for i in range(WORDS)]]
TAIL = 18.0  # the bound on differing bits is passed by a link with probability exp(-TAIL)
MARKS = ["extra", *[f"{kind}{i}" for kind in ("lacks", "adds") for i in range(WORDS)]]

_DRAW = np.random.default_rng(13)
_FACTORS, _SHIFTS, _MIXERS = (_DRAW.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(3))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles; a shorter text is one shingle, no words are none."""
    from xxhash import xxh64_intdigest

    found, carried = [], []
    for part in parts_of(text or ""):
        own = carried + part.encode().lower().split()
        if len(own) < words:
            carried = own
            continue
        carried = own[len(own) - words + 1:]
        joined = b" ".join(own)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(sizes + 1) - 1
        bounds = zip((ends - sizes)[: len(own) - words + 1].tolist(), ends[words - 1:].tolist())
        found.append(np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in bounds], np.uint64)))
    if not found and carried:
        found.append(np.array([xxh64_intdigest(b" ".join(carried), SEED)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def minwise(found: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each function."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    mixed = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(mixed), 1024):
        part = mixed[i:i + 1024] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(least, part.min(1), out=least)
    return least


def one_bits(least: np.ndarray) -> np.ndarray:
    """A bit of each smallest hash, 64 to a long."""
    return np.packbits((least * _MIXERS) >> np.uint32(31)).view("<i8")


def bit_bound(similarity: float) -> int:
    """The most differing bits that are looked at: more have probability exp(-TAIL) at this similarity (Chernoff)."""
    p = (1 - similarity) / 2
    for bits in range(int(np.ceil(HASHES * p)), HASHES // 2):
        q = bits / HASHES
        if HASHES * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))) >= TAIL:
            return bits
    return HASHES


def sketch(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, key, row, n, digest, the bits and the first tokens of every row of docs. Settle it: row counts rows."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
        + [T.StructField(f"b{i}", T.LongType()) for i in range(WORDS)] + [T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            least = np.empty((batch.num_rows, HASHES), np.uint32)
            for i in range(batch.num_rows):
                found = shingles(batch.column(2)[i].as_py(), words)
                sizes.append(len(found))
                digests.append(hashlib.sha256(found.tobytes()).digest())
                least[i] = minwise(found)
            bits = np.array([one_bits(x) for x in least], np.int64).reshape(-1, WORDS)
            tokens = pa.array(np.ascontiguousarray(least[:, :coordinates]).view(np.int32).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * coordinates, pa.int32()), tokens)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(bits[:, k]) for k in range(WORDS)], listed], names=schema.fieldNames())

    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), text_of().alias("text"))
    return rows.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id())


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """row and its whole set."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [shingles(t, words).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), held], names=["row", "found"])

    return rows.select("row", "text").mapInArrow(work, "row long, found array<long>")


def _marked(pairs: DataFrame) -> DataFrame:
    """Instead of the lists `lacks` and `adds` the number of added shingles, and of each list which of HASHES cells it hits.

    A shingle's cell is its first byte; only these bytes, and few rows at a time, take memory beside the table.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                marks, extra = [], None
                for listed in (part.column(4), part.column(5)):
                    size = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    hit = np.zeros((part.num_rows, HASHES), bool)
                    hit[np.repeat(np.arange(part.num_rows), size), listed.flatten().to_numpy().view(np.uint8)] = True
                    words = np.packbits(hit, axis=1).view("<i8")
                    marks += [pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)]
                    extra = size
                columns = [part.column(k) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(extra), *marks], names=["x", "y", "shared", "total", *MARKS])

    return pairs.select("x", "y", "shared", "total", "lacks", "adds").mapInArrow(work, ", ".join(f"{c} long" for c in ["x", "y", "shared", "total", *MARKS]))


def within(x: str, y: str, percent: int) -> Column:
    """Whether x and y, both compared with the same third set, can be similar by what they lack and add to it.

    Of the third set they share at most what neither lacks, and beside it what both add. The cells hit by either's lacking
    shingles are no more than these; a cell that one's added shingles hit and the other's do not holds one that is not shared.
    """
    def count(bits) -> Column:
        return sum((F.bit_count(bits(i)) for i in range(WORDS)), F.lit(0))

    def added(one: str, other: str) -> Column:
        return F.col(f"{one}.extra") - count(lambda i: F.col(f"{one}.adds{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}.adds{i}"))))

    lacked = count(lambda i: F.col(f"{x}.lacks{i}").bitwiseOR(F.col(f"{y}.lacks{i}")))
    shared = F.col(f"{x}.total") - F.col(f"{x}.extra") - lacked + F.least(added(x, y), added(y, x))
    sizes = F.col(f"{x}.shared") + F.col(f"{x}.extra") + F.col(f"{y}.shared") + F.col(f"{y}.extra")
    return shared * 100 >= (sizes - shared) * percent


def compared(pairs: DataFrame, docs: DataFrame, heads: DataFrame, words: int, percent: int, marked: bool = False) -> DataFrame:
    """x, y, shared, total (sizes of intersection and union) of the pairs of rows at or over the percentage, by whole sets.

    heads has the key of each row; only texts of rows in the pairs are read into sets. If asked for, MARKS tell what x
    lacks and adds to y.
    """
    rows = pairs.select(F.col("x").alias("row")).unionByName(pairs.select(F.col("y").alias("row"))).distinct()
    asked = settle(heads.select("row", "key").join(rows, "row", "left_semi"))
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), text_of().alias("text")).join(hinted(asked), "key")
    sets = settle(_sets(texts, words))
    left, right = sets.select(F.col("row").alias("x"), F.col("found").alias("fx")), sets.select(F.col("row").alias("y"), F.col("found").alias("fy"))
    cells = lambda one, other: F.transform(F.array_except(one, other), lambda h: F.shiftright(h, 56).cast("tinyint"))
    lists = [cells("fy", "fx").alias("lacks"), cells("fx", "fy").alias("adds")] if marked else []
    shared = pairs.select("x", "y").join(left, "x").join(right, "y").select(
        "x", "y", F.size(F.array_intersect("fx", "fy")).cast("long").alias("shared"), (F.size("fx") + F.size("fy")).cast("long").alias("both"), *lists
    )
    close = shared.withColumn("total", F.col("both") - F.col("shared")).filter(F.col("shared") * 100 >= F.col("total") * percent).drop("both")
    return (_marked(close) if marked else close.select("x", "y", "shared", "total")).distinct()


def alike(x: str, y: str, percent: int) -> Column:
    """Whether the sizes and bits of x and y leave the similarity open."""
    bits = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(WORDS)), F.lit(0))
    sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent
    return sizes & (bits <= bit_bound(percent / 100))


def without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a settled sketch one row of each set that is not empty, and `row, first` of all rows whose set stands repeatedly."""
    groups = settle(rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("held")).filter("held > 1").select("digest", "first"))
    copies = settle(rows.filter("n > 0").select("row", "digest").join(hinted(groups), "digest").select("row", "first"))
    return rows.filter("n > 0").join(hinted(copies.filter("row <> first").select("row")), "row", "left_anti"), copies


def through_followers(few: list[DataFrame], led: list[DataFrame], members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """x, y: links among pairs left open by `alike` (few) and compared with leaders (led: x, leader y, linked), and links
    between a member that just missed a leader and the leader's followers, where they are not connected otherwise.
    led has MARKS too, so that of these only pairs whose likeness they leave open are compared."""
    heads = members.select("row", "key")
    if not few:
        return members.select(F.col("row").alias("x"), F.col("row").alias("y")).limit(0)
    sure = settle(compared(settle(reduce(DataFrame.unionByName, few).distinct()), docs, heads, words, percent).select("x", "y"))
    if not led:
        return sure
    distance = (1 - F.col("shared") / F.col("total")).alias("distance")
    tried = settle(reduce(DataFrame.unionByName, led).select("x", "y", "linked", distance, F.struct("shared", "total", *MARKS).alias("marks")).distinct())
    follows = tried.filter("linked").select("x", "y")
    sure = settle(sure.unionByName(follows).distinct())
    missed = tried.filter("not linked").select(F.col("x").alias("miss"), F.col("y").alias("lead"), F.col("distance").alias("far"), F.col("marks").alias("mx"))
    if not missed.limit(1).count():
        return sure
    # What follows the same leader is connected already; a leader that follows another one counts with that one.
    stars = settle(follows.groupBy("x").agg(F.min("y").alias("star")))
    star = lambda row, name: hinted(stars).select(F.col("x").alias(row), F.col("star").alias(name))
    apart = missed.join(star("miss", "mine"), "miss", "left").join(star("lead", "theirs"), "lead", "left")
    apart = settle(apart.filter("coalesce(mine, miss) <> coalesce(theirs, lead) and not mine <=> lead").select("miss", "lead", "far", "mx"))
    features = lambda row, name: members.select(F.col("row").alias(row), F.struct("row", *FEATURES).alias(name))
    behind = tried.filter("linked").select(F.col("x").alias("follower"), F.col("y").alias("lead"), F.col("distance").alias("near"), F.col("marks").alias("my")).join(features("follower", "y"), "follower")
    reach = F.col("far") - F.col("near") <= 1 - percent / 100 + 1e-9  # the triangle inequality once more
    asked = apart.join(features("miss", "x"), "miss").join(behind, "lead").filter(reach & alike("x", "y", percent) & within("mx", "my", percent))
    asked = settle(asked.select(F.col("x.row").alias("x"), F.col("y.row").alias("y")).distinct())
    return sure.unionByName(compared(asked, docs, heads, words, percent).select("x", "y"))
