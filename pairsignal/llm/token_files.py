"""Token ids in files, compressed by Re-Pair.

Documents are sorted by doc_id over all partitions and put into shards of about SHARD_TOKENS ids. A shard replaces its
frequent pairs of neighbouring ids by new symbols: in each round the pairs with the highest counts whose places cannot
overlap, counted over the whole shard, until no pair occurs LEAST times. It stores the rules, the number of ids each
symbol expands to, the remaining symbols and where each document ends among them, so that one document, or a stretch of
one, is decoded alone.

The files are Parquet with one row per shard: Spark commits them to shared storage, and a lost task writes its own again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignal.llm import tokens
from pairsignal.llm.common import hinted, settle, text_of
from pairsignal.session import ensure_checkpoint_dir

END = 2
SHARD_TOKENS = 1 << 19
PART_BYTES = 4 << 20  # texts that are encoded together: the more, the fewer pieces are looked up twice
LEAST = 16  # occurrences a rule must replace


def _chosen(kinds: np.ndarray, counts: np.ndarray, shift: int) -> np.ndarray:
    """The pairs to replace in one round, sorted: by falling count, each whose left symbol is nobody's right one and the
    other way round, so that no two places of them overlap; a symbol that stands twice is taken by no other pair."""
    left, right, taken = set(), set(), []
    for value in kinds[np.lexsort((kinds, -counts))].tolist():
        a, b = value >> shift, value & ((1 << shift) - 1)
        if a not in right and b not in left and (a != b or a not in left and a not in right):
            left.add(a)
            right.add(b)
            taken.append(value)
    return np.sort(np.array(taken, kinds.dtype))


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, where documents end among them, the rules (two symbols each), the length of every rule's expansion, and
    the first symbol that is a rule. No pair inside a document occurs `least` times among the symbols that remain.

    A pair that once occurs too seldom never occurs more often, for replacing others only takes places from it. A round
    therefore counts the places of the pairs that were frequent before and of those with a new symbol, and no others.
    """
    first = int(ids.max()) + 1 if len(ids) else 1
    symbols, ends = ids.astype(np.uint16 if first < 1 << 16 else np.uint32), ends.astype(np.int64)
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32)
    open_ = _common(symbols, least)
    while True:
        made = first + len(lengths)
        if made + len(symbols) // least >= 1 << 16:  # more rules than two bytes may be left to make
            symbols = symbols.astype(np.uint32)
        two, shift = (np.uint32, 16) if symbols.itemsize == 2 else (np.uint64, 32)
        open_[ends[ends > 0] - 1] = False  # pairs that reach into the next document
        place = np.flatnonzero(open_)
        pairs = symbols[place].astype(two)
        pairs <<= two(shift)
        pairs |= symbols[place + 1]
        counted = np.sort(pairs)
        often = counted[least - 1:][counted[least - 1:] == counted[:max(len(counted) - least + 1, 0)]]  # count - least + 1 times each
        edge = np.flatnonzero(np.concatenate((often[:1] == often[:1], often[1:] != often[:-1])))
        kinds, counts = often[edge], np.diff(np.append(edge, len(often))) + least - 1
        kinds, counts = _apart(symbols, place, kinds, counts, shift, least)
        if not len(kinds):
            break
        kind = _which(kinds, pairs)
        still = kind >= 0
        open_[place[~still]] = False
        place, kind = place[still], kind[still]
        chosen = _chosen(kinds, counts, shift)
        new = np.stack((chosen >> two(shift), chosen & two((1 << shift) - 1)), 1).astype(np.int64)
        number = np.full(len(kinds), -1, np.int64)
        number[np.searchsorted(kinds, chosen)] = np.arange(len(chosen))
        rule = number[kind]
        place, rule = place[rule >= 0], rule[rule >= 0]
        if (new[:, 0] == new[:, 1]).any():
            stays = _every_second(symbols, place)
            place, rule = place[stays], rule[stays]
        size = np.ones(made, np.uint32)
        size[first:] = lengths
        rules.append(new.astype(np.uint32))
        lengths = np.concatenate((lengths, size[new[:, 0]] + size[new[:, 1]]))
        symbols[place] = made + rule
        open_[place] = True
        open_[np.maximum(place - 1, 0)] = True
        stays = np.ones(len(symbols), bool)
        stays[place + 1] = False
        symbols, open_ = symbols[stays], open_[stays]
        open_[-1] = False
        ends -= np.searchsorted(place, ends - 1)
    return symbols, ends, np.concatenate(rules), lengths, first


def _which(kinds: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The number of each pair in the sorted kinds, -1 where it is none of them. Kinds that share a slot are searched for."""
    bits = max(len(kinds).bit_length() + 5, 12)
    slot = lambda values: (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    own = slot(kinds)
    table = np.full(1 << bits, -1, np.int32)
    table[own] = np.arange(len(kinds), dtype=np.int32)
    table[own[table[own] != np.arange(len(kinds))]] = -2
    found = table[slot(pairs)]
    shared = np.flatnonzero(found == -2)
    found[shared] = np.minimum(np.searchsorted(kinds, pairs[shared]), len(kinds) - 1)
    found[(found >= 0) & (kinds[found] != pairs)] = -1
    return found


def _common(symbols: np.ndarray, least: int) -> np.ndarray:
    """At which places a pair may occur `least` times: where both of its symbols do."""
    common = (np.bincount(symbols) >= least)[symbols] if len(symbols) else np.zeros(0, bool)
    common[:-1] &= common[1:]
    common[-1:] = False
    return common


def _every_second(symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places of pairs to take: in a run of one symbol every second pair of it, elsewhere all."""
    same = symbols[place] == symbols[place + 1]
    start = np.concatenate(([True], np.diff(place) != 1))
    run = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
    return ~same | ((np.arange(len(place)) - run) % 2 == 0)


def _apart(symbols: np.ndarray, place: np.ndarray, kinds: np.ndarray, counts: np.ndarray, shift: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and their counts, a pair of one symbol counted without overlaps; those below `least` are left out."""
    first, second = kinds >> kinds.dtype.type(shift), kinds & kinds.dtype.type((1 << shift) - 1)
    doubled = np.flatnonzero(first == second)
    if len(doubled):
        place = place[symbols[place] == symbols[place + 1]]
        apart = np.bincount(symbols[place[_every_second(symbols, place)]], minlength=int(first[doubled].max()) + 1)
        counts = counts.copy()
        counts[doubled] = apart[first[doubled]]
    return kinds[counts >= least], counts[counts >= least]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids behind symbols; symbols from `first` on are rules."""
    symbols = symbols.astype(np.int64)
    used = np.unique(symbols[symbols >= first])
    if not len(used):
        return symbols.astype(np.uint32)
    texts, owner = used, np.arange(len(used))  # the expansions of all rules that occur, one behind the other
    while (made := texts >= first).any():
        twice = np.where(made, 2, 1)
        out, owner = np.repeat(texts, twice), np.repeat(owner, twice)
        at = np.flatnonzero(made) + np.arange(np.count_nonzero(made))
        rule = rules[texts[made] - first]
        out[at], out[at + 1] = rule[:, 0], rule[:, 1]
        texts = out
    size = np.bincount(owner)
    begin = np.cumsum(size) - size
    made = symbols >= first
    kind = np.searchsorted(used, symbols[made])
    count = np.ones(len(symbols), np.int64)
    count[made] = size[kind]
    ids = np.repeat(symbols, count).astype(np.uint32)
    until = np.cumsum(size[kind])
    at = np.repeat(begin[kind] - until + size[kind], size[kind])
    at += np.arange(len(at))
    ids[np.repeat(made, count)] = texts[at]
    return ids


def stretch(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a document's symbols: only the symbols that cover them are expanded."""
    size = np.ones(len(symbols), np.int64)
    made = symbols >= first
    size[made] = lengths[symbols[made].astype(np.int64) - first]
    upto = np.cumsum(size)
    low, high = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left") + 1
    before = int(upto[low - 1]) if low else 0
    return expand(symbols[low:high], rules, first)[start - before:stop - before]


def _shard_type(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("counts", T.BinaryType()), T.StructField("ends", T.BinaryType()),
        T.StructField("rules", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("symbols", T.BinaryType()),
        T.StructField("first_rule", T.LongType()),
    ])


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text and write the shards, in ascending order of doc_id (null first; equal ids by their text)."""
    vocabulary = vocabulary or tokens.vocabulary()
    columns = docs.select("doc_id", text_of().alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = columns.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    schema = _shard_type(docs.schema["doc_id"].dataType)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        held: list[bytes] = []
        total = 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            counts = np.array([len(x) // 4 for x in held], "<i8")
            symbols, ends, rules, lengths, first_rule = compress(ids, np.cumsum(counts))
            listed = pa.concat_arrays(names)
            values = [
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((counts, "<i8"), (ends, "<i8"), (rules, "<u4"), (lengths, "<u4"), (symbols, f"<u{symbols.itemsize}"))),
                pa.array([first_rule], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(values, names=schema.fieldNames())

        for batch, encoded in tokens.encoded(vocabulary, batches, end, PART_BYTES):
            ids, first = batch.column(0), 0
            for i, one in enumerate(encoded):
                held.append(one)
                total += len(one) // 4
                if total >= shard_tokens:
                    names.append(ids.slice(first, i + 1 - first))
                    yield row()
                    names, held, total, first, block = [], [], 0, i + 1, block + 1
            if first < len(ids):
                names.append(ids.slice(first))
        if held:
            yield row()

    ordered.mapInArrow(shards, schema).write.parquet(path)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    counts, ends = np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["ends"], "<i8")
    width = len(row["symbols"]) // int(ends[-1])  # 2 bytes a symbol where all fit, else 4
    return counts, ends, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["symbols"], f"<u{width}")


def read_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document in the files under path."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    heads = settle(files.select("part", "block", "n_ids"))
    sums = heads.groupBy("part").agg(F.sum("n_ids").alias("all"))  # one row per task of the writing job
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("first", F.coalesce(F.sum("all").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        heads.join(F.broadcast(parts), "part")
        .select("part", "block", (F.col("first") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first"))
    )
    extra = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), *extra])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {k: one.column(k)[0].as_buffer() for k in ("counts", "ends", "rules", "symbols")}
                counts, _, rules, symbols = _unpacked({k: memoryview(v) for k, v in row.items()})
                ids = memoryview(expand(symbols, rules, one.column("first_rule")[0].as_py()).astype("<u4").tobytes())
                stop = np.cumsum(counts)
                start = stop - counts
                texts = [ids[4 * a:4 * b] for a, b in zip(start.tolist(), stop.tolist())]
                values = [
                    one.column("doc_ids").flatten(), pa.array(start + one.column("first")[0].as_py()), pa.array(counts),
                    pa.array([zlib.crc32(x) for x in texts], pa.int64()), *([pa.array([x.tobytes() for x in texts], pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(values, names=schema.fieldNames())

    placed = files.join(hinted(starts), ["part", "block"])
    return placed.select("first", "doc_ids", "counts", "ends", "rules", "symbols", "first_rule").mapInArrow(decode, schema)


def fetch(row: dict, doc_id: object, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of one document of a shard row (as a dict), without expanding the others."""
    counts, ends, rules, symbols = _unpacked(row)
    i = row["doc_ids"].index(doc_id)
    own = symbols[ends[i - 1] if i else 0:ends[i]]
    return stretch(own, rules, np.frombuffer(row["lengths"], "<u4"), row["first_rule"], start, int(counts[i]) if stop is None else stop)


def round_trip(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write the shards (into the shared folder if no path is given) and read every document back.

    One row per row of docs. A null text is the end id alone; null and repeated ids are kept; an empty table writes
    files without shards and gives no rows. Only doc_id and text are read.
    """
    import uuid

    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, vocabulary)
    return read_shards(spark, path)
