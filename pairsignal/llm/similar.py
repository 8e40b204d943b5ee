"""Near duplicates at a given similarity of their word shingles, found by SimHash and Golay keys over parts of a text.

One fingerprint of a whole text differs in ten bits and more between texts of similarity 0.8, too many for any key of 64
bits. The set of a text's shingles is therefore dealt into bins by hash, and each bin has a fingerprint of its own: a
change touches few bins, and the fingerprints of the others are equal. A bin's key is the exact first segment of its
fingerprint with the Golay codeword of the second. Texts that share a key are candidates.

The fingerprint of a whole set has its keys too, whatever the size of the set: all three segments in turn exact, each with
the codewords near the next one, as `simhash` has them. They find sets that differ in two bits at most.

Longer texts are dealt from a sample of their shingles chosen by hash, so that a dealing has 32 bins at most; the sample
depends on the size of the set, and a text near a step is dealt both ways, so similar texts meet. Every text is dealt
more than once, by other bits and where it is sampled from other samples.

Bins can all be touched, so for sets below SMALL the shingles themselves are keys: of two sets at the given similarity
the first n - ceil(similarity * n) + 1 in any common order have one in common, whatever is changed. The order puts
frequent shingles last (`rarity`), so a line that many texts share makes no key where a text has anything else. Larger
sets have such keys too as long as they can be similar to a set below SMALL, so these pairs are found with certainty.

Equal sets are one member. Candidates are compared by size and by one bit of each of 256 minwise hashes first, which
travel with the keys; only what that leaves is compared by whole sets. In a bucket of up to PAIRS members all are
compared. In a larger one they are compared with a leader, the one that shares most buckets with others; those that are
not similar to it with two others, then with four, until every member is a leader or similar to one or the rest is
small. A member can still be similar to one that follows a leader. By the triangle inequality of the Jaccard distance
its similarity with the leader is then at least 2 * similarity - 1; where such a member has not joined the leader's
group in another way, it is compared with the leader's followers too, as far as what both lack and add to the leader
leaves their likeness open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignal.llm.common import hinted, row_key, settle, text_of
from pairsignal.llm.simhash import connected, golay, keys_of
from pairsignal.llm.word_sets import FEATURES, alike, compared, shingles, sketch, through_followers, without_copies

SHINGLE = 5
PERCENT = 80
PAIRS = 32
SPARSE = 128  # larger buckets of up to this size are compared whole too, if no leader has anybody similar there
LEAST_IN_BIN = 3
SMALL = 128  # sets of fewer shingles are found by their first shingles alone
DEALINGS = 2
CELLS = 1 << 22  # cells in which shingles are counted; the order they give has a byte for each
GRADED = 1 << 20  # cells that can come behind the others, the fullest ones


def _level(n: float) -> int:
    """The sample of a set of n is one in 2**level."""
    return max(0, int(np.log2(n / SMALL)))


def _cell(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def first_shingles(found: np.ndarray, similarity: float, grades: np.ndarray | None = None) -> np.ndarray:
    """So many of a set's shingles, those with the lowest grade first, that two similar sets have one in common."""
    if not len(found):
        return found
    ordered = found if grades is None else found[np.argsort(grades[_cell(found)], kind="stable")]
    return ordered[: len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1]


def bin_keys(found: np.ndarray, similarity: float, grades: np.ndarray | None = None) -> list[int]:
    """The keys of a set's first shingles, if it is small, and of its bins, if it is not."""
    keys: list[int] = []
    n = len(found)
    if n * similarity < SMALL:
        keys += ((first_shingles(found, similarity, grades) >> np.uint64(2)).astype(np.int64) | (1 << 62)).tolist()
    if n < SMALL:
        return keys
    code = golay()
    for level in {_level(n), _level(n * similarity)}:
        for dealing in range(DEALINGS):
            mask = np.uint64((1 << level) - 1)
            chosen = found[found & mask == np.uint64(dealing) * mask // np.uint64(max(1, DEALINGS - 1))]
            if not len(chosen):
                continue
            bins = (chosen >> np.uint64(59 - 5 * dealing)).astype(np.int64) & 31
            order = np.argsort(bins, kind="stable")
            chosen, bins = chosen[order], bins[order]
            start = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
            count = np.diff(np.append(start, len(bins)))
            ones = np.add.reduceat(np.unpackbits(chosen.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64), start, axis=0)
            prints = np.packbits(2 * ones > count[:, None], axis=1).view("<u8").ravel()
            first = (prints & np.uint64((1 << 23) - 1)).astype(np.int64)
            index, _ = code.nearby(((prints >> np.uint64(23)) & np.uint64((1 << 23) - 1)).astype(np.int64))
            tag = ((level * DEALINGS + dealing) << 5) | bins[start]
            keys += ((tag << 35) | (first << 12) | index[:, 0])[count >= LEAST_IN_BIN].tolist()
    return keys


def fingerprint(found: np.ndarray) -> int:
    """A bit is 1 if over half of a set's shingles have it."""
    return int(np.packbits(2 * np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) > len(found)).view("<u8")[0])


def whole_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Golay keys of whole sets' fingerprints: which set, and the key."""
    which, keys, _ = keys_of(prints)
    return which, keys | (1 << 61)


def rarity(docs: DataFrame, words: int, similarity: float) -> np.ndarray:
    """A byte per cell: the larger, the more frequent the shingles there. Any order is right; this one keeps buckets small.

    Every task counts the shingles of its sets that need an order, and tells the cells that stand out in its counts.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingles(batch.column(0)[i].as_py(), words)
                if len(found) * similarity < SMALL:
                    counts[_cell(found)] += 1
        mean = float(counts.mean())
        cells = np.flatnonzero(counts >= max(3.0, mean + 6 * mean ** 0.5))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], names=["cell", "held"])

    told = docs.select(text_of().alias("text")).mapInArrow(work, "cell long, held long")
    fullest = told.groupBy("cell").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "cell").limit(GRADED).toPandas()
    grades = np.zeros(CELLS, np.uint8)
    grades[fullest["cell"].to_numpy(np.int64)] = np.minimum(255, 8 * np.log2(fullest["held"].to_numpy(np.float64) + 1)).astype(np.uint8)
    return grades


def _keys(docs: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """bucket and row of every member."""
    grades = docs.sparkSession.sparkContext.broadcast(rarity(docs, words, similarity))  # CELLS bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                owner, keys = [], []
                prints = np.zeros(part.num_rows, np.uint64)
                for i in range(part.num_rows):
                    found = shingles(part.column(1)[i].as_py(), words)
                    prints[i] = fingerprint(found)
                    own = bin_keys(found, similarity, grades.value)
                    owner += [i] * len(own)
                    keys += own
                which, whole = whole_keys(prints)
                rows = part.column(0).take(pa.array(np.concatenate([np.array(owner, np.int64), which])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(keys, np.int64), whole])), rows], names=["bucket", "row"])

    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), text_of().alias("text")).join(members.select("row", "key"), "key")
    return texts.select("row", "text").mapInArrow(work, "bucket long, row long")


def links(members: DataFrame, docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, pairs: int = PAIRS, sparse: int = SPARSE) -> DataFrame:
    """x, y: pairs of members (rows with different sets) at or over the percentage, enough to connect all that are."""
    heads, loose = members.select("row", "key"), max(0, 2 * percent - 100)
    keys = settle(_keys(docs, members, words, percent / 100))
    sizes = settle(keys.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1"))
    shared = settle(keys.join(hinted(sizes), "bucket"))
    weights = settle(shared.groupBy("row").agg(F.sum("held").alias("weight")))
    described = members.select("row", *FEATURES).join(weights, "row")
    left = settle(shared.join(described, "row"))
    few_pairs: list[DataFrame] = []
    led: list[DataFrame] = []
    cells = 1

    def all_pairs(few: DataFrame) -> DataFrame:
        x, y = few.alias("x"), few.alias("y")
        close = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.row") < F.col("y.row")) & alike("x", "y", percent)
        return settle(x.join(y, close).select(F.col("x.row").alias("x"), F.col("y.row").alias("y")).distinct())

    while left.limit(1).count():
        few_pairs.append(all_pairs(left.filter(F.col("held") <= pairs)))
        many = left.filter(F.col("held") > pairs)
        if not many.limit(1).count():
            break
        # The leader is the same in as many buckets as possible, so that most comparisons are one and the same.
        cell = F.pmod(F.xxhash64("row"), F.lit(cells)).alias("cell")
        first = F.max(F.struct("weight", F.xxhash64("row").alias("h"), "row", *FEATURES)).alias("leader")
        leaders = settle(many.groupBy("bucket", cell).agg(first).select("bucket", "leader"))
        tried = many.join(hinted(leaders), "bucket").filter("row <> leader.row")
        asked = tried.select(F.struct("row", *FEATURES).alias("x"), F.col("leader").alias("y")).filter(alike("x", "y", loose))
        asked = settle(asked.select(F.col("x.row").alias("x"), F.col("y.row").alias("y")).distinct())
        found = settle(compared(asked, docs, heads, words, loose, marked=True).withColumn("linked", F.col("shared") * 100 >= F.col("total") * percent))
        led.append(found)
        follows = found.filter("linked").select(F.col("x").alias("row"), F.col("y").alias("lead"))
        followers = tried.select("bucket", "row", F.col("leader.row").alias("lead")).join(hinted(follows), ["row", "lead"], "left_semi").select("bucket", "row")
        done = settle(followers.unionByName(leaders.select("bucket", F.col("leader.row").alias("row"))).distinct())
        rest = settle(many.drop("held").join(done, ["bucket", "row"], "left_anti"))
        alone = leaders.groupBy("bucket").agg(F.lit(0).alias("gone")).join(followers.select("bucket").distinct(), "bucket", "left_anti")
        counted = settle(rest.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1").join(hinted(settle(alone)), "bucket", "left"))
        whole = (F.col("held") <= sparse) & F.col("gone").isNotNull()
        few_pairs.append(all_pairs(rest.join(hinted(counted.filter(whole).select("bucket")), "bucket", "left_semi")))
        left = settle(rest.join(hinted(counted.filter(~whole).select("bucket", "held")), "bucket"))
        cells *= 2
    return through_followers(few_pairs, led, members, docs, words, percent)


def near_groups(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key (row_key of doc_id and text), doc_id, group (a number) and kept for every different row of docs.

    The row with the smallest doc_id of a group stays (a null id last; of equal ids the smallest key). Rows equal in
    doc_id and text are one row here; null and empty texts are in no group. Only doc_id and text are read.
    """
    rows = settle(sketch(docs, words, 0))
    members, copies = without_copies(rows)
    found = links(members, docs, words, percent)
    roots = settle(connected(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    grouped = settle(
        rows.select("key", "doc_id", "row").join(hinted(copies), "row", "left").withColumn("node", F.coalesce("first", "row"))
        .join(hinted(roots), "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("group")).distinct()
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    firsts = grouped.groupBy("group").agg(best.alias("first"))
    return grouped.join(firsts, "group").select("key", "doc_id", "group", (F.col("key") == F.col("first.key")).alias("kept"))
