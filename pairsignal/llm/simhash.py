"""SimHash near duplicates, found by Golay codes.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded). Two fingerprints that differ in at
most two bits have, by the pigeonhole principle, a segment without error whose next segment has one error at most. Each
23-bit segment is decoded to the codewords of the perfect binary Golay code near it: a segment's own codeword is within
distance 4 of any segment one bit away, and a segment has one or six codewords within that distance. So the exact value
of one segment with the codeword index of the next is a key that such a pair shares; keys are joined and verified.

In a bucket of more than BUCKET different fingerprints pairs are not listed. Its members are linked through all words
one bit away from them instead: two fingerprints are at most two bits apart if and only if they have such a word (or
themselves) in common, and all members of a word are linked to each other. That is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignal.llm.common import hinted, parts_of, settle, text_of

SEED = 42
SHINGLE = 3
BUCKET = 64
WIDTHS = (23, 23, 18)
GENERATOR = 0b101011100011  # fixed value: a generator polynomial of the (23, 12) Golay code


def fingerprint(text: str, shingle_words: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the shingles; no words: 0."""
    from xxhash import xxh64_intdigest

    count, shingles, carried = np.zeros(64, np.int64), 0, []
    for part in parts_of(text):
        words = carried + part.encode().lower().split()
        if len(words) >= shingle_words:
            carried = words[len(words) - shingle_words + 1:]
        else:
            carried = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        bounds = zip((ends - sizes)[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1:].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in bounds], "<u8")
        shingles += len(hashes)
        for i in range(0, len(hashes), 1 << 14):
            count += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    if not shingles:
        return xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(2 * count > shingles).tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t or "", shingle_words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=schema.fieldNames())

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, schema)


class Golay:
    """For each of the 2048 syndromes the errors of weight up to 4 that lead to a codeword, the nearest first."""

    def __init__(self) -> None:
        rest = np.arange(1 << 12, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
        self.rest = rest
        found: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                found[int(rest[error >> 11] ^ (error & 0x7FF))].append(error)
        most = max(map(len, found))
        self.errors = np.array([e + [-1] * (most - len(e)) for e in found], np.int64)

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords near each 23-bit word (its own first), and which of them exist."""
        errors = self.errors[self.rest[words >> 11] ^ (words & 0x7FF)]
        return (words[:, None] ^ np.maximum(errors, 0)) >> 11, errors >= 0


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of keys: which value, the key, and whether it holds the value's own codeword."""
    code = golay()
    at = np.cumsum((0, *WIDTHS[:-1]))
    bits = values.view(np.uint64)
    segments = [((bits >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in zip(at, WIDTHS)]
    rows, keys, own = [], [], []
    for i in range(3):
        index, there = code.nearby(segments[(i + 1) % 3])
        row, which = np.nonzero(there)
        rows.append(row)
        keys.append((i << 35) | (segments[i][row] << 12) | index[row, which])
        own.append(which == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _keys(fps: DataFrame) -> DataFrame:
    schema = "fp long, key long, own boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 4096):
                part = np.ascontiguousarray(values[i:i + 4096])
                rows, keys, own = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys), pa.array(own)], names=["fp", "key", "own"])

    return fps.select("fp").mapInArrow(work, schema)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a < b: links between different fingerprints (fp, distinct) at most two bits apart, enough to connect all that are.

    All of them where no bucket is large; in large buckets each word's members are linked to the smallest one.
    """
    keys = settle(_keys(fps))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("owned")).filter("n > 1 and owned")
    sizes = settle(sizes)
    listed = keys.join(hinted(sizes.filter(F.col("n") <= bucket).select("key")), "key")
    left = listed.filter("own").select("key", F.col("fp").alias("x"))
    right = listed.select("key", F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("x") != F.col("y")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowded = settle(keys.join(hinted(sizes.filter(F.col("n") > bucket).select("key")), "key").select("fp").distinct())
    words = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])).alias("word"))
    first = Window.partitionBy("word")  # a word has 65 members at most
    stars = words.select("fp", F.min("fp").over(first).alias("a")).filter("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over the edges (a < b), by large-star and small-star steps."""
    state = settle(edges.select("a", "b"))
    while True:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = settle(large)
        # Every node now looks at its smaller neighbours: they, and the node itself, hang on the smallest of them.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(down, "b")
        small = settle(
            joined.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(down.select(F.col("m").alias("a"), "b")).distinct()
        )
        if small.count() == state.count() and not small.exceptAll(state).limit(1).count():
            return small.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = small


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    component_id is the smallest doc_id reachable over links (null only if no row of the component has an id). A null
    text has no words; texts without words share fingerprint zero and are linked like others. Repeated rows give
    repeated rows. Only doc_id and text are read.
    """
    rows = settle(fingerprints(docs, shingle_words))
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(connected(links(fps, bucket)))
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    components = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = settle(labelled.join(components, "root").select("fp", "component_id"))
    return rows.join(hinted(by_fp), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
