"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so the whole table is described by one count per length: a plan is made
from at most `capacity` counts, whatever the number of documents. Large lengths are sorted and cut into groups of equal
cardinality, each rounded up to its largest; for these few sizes the best mix of configurations (what fits into one
sequence) is found by linear programming with columns generated on demand and rounded down. Then actual documents take
the places, which leaves the room that rounding up reserved; what is left and the small lengths go where they fit best.
The plan says where the k-th document of a length goes; Spark ranks documents within their length and looks that up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignal.llm import tokens
from pairsignal.llm.common import ranked, settle, text_of

CAPACITY = 2048
END = 0
GROUPS = 96  # sizes that large lengths are rounded up to
LARGE = 1 / 10  # of the capacity


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable content of one sequence, each size as often as it fits."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        value = np.where(fits, worth + best[room - np.minimum(sizes, room)], -1.0)
        i = int(value.argmax())
        best[room], pick[room] = best[room - 1], -1
        if value[i] > best[room] + 1e-12:
            best[room], pick[room] = value[i], i
    content = np.zeros(len(sizes), np.int64)
    room = capacity
    while room >= sizes.min():
        if pick[room] < 0:
            room -= 1
        else:
            content[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), content


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often to use each, rounded down, from the linear programme over all that fit."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    use = inverse @ demand
    for step in range(40 * n):
        value, content = _knapsack(sizes, inverse.sum(0), capacity)
        if value <= 1 + 1e-7:
            break
        way = inverse @ content
        able = way > 1e-9
        if not able.any():
            break
        ratio = np.where(able, use / np.where(able, way, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = content
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / way[out]
            inverse = inverse - np.outer(way, row)
            inverse[out] = row
        use = np.maximum(inverse @ demand, 0)
    return [(basis[:, j].astype(np.int64), int(use[j] + 1e-7)) for j in range(n) if use[j] >= 1]


class _Supply:
    """Lengths with how many documents of each are left, handed out in runs of equal length."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.left = [[length, 0, n] for length, n in counts]  # length, next rank, how many

    def take(self, most: int) -> tuple[int, int, int] | None:
        while self.left and not self.left[0][2]:
            self.left.pop(0)
        if not self.left:
            return None
        length, rank, n = self.left[0]
        n = min(n, most)
        self.left[0][1] += n
        self.left[0][2] -= n
        return length, rank, n


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): document rank + i of a length is in sequence first + i."""
    plan: list[tuple[int, int, int, int]] = []
    sequences = 0
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            runs = open_[room]
            if runs and sum(runs[-1]) == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    full = counts.get(capacity, 0)
    if full:
        plan.append((capacity, 0, 0, 0))
        sequences = full
    least = max(1, int(capacity * large))
    big = sorted(((x, n) for x, n in counts.items() if least < x < capacity and n), reverse=True)
    total = sum(n for _, n in big)
    classes: list[_Supply] = []
    if total:
        quota = -(-total // groups)
        sizes, demand, one, held = [], [], [], 0
        pieces = [(x, n) for x, n in big]
        for length, n in pieces:  # a group ends where its quota is full, between two lengths
            if one and held + n > quota:
                classes.append(_Supply(one))
                sizes.append(one[0][0])
                demand.append(held)
                one, held = [], 0
            one.append((length, n))
            held += n
        classes.append(_Supply(one))
        sizes.append(one[0][0])
        demand.append(held)
        for content, times in configurations(np.array(sizes), np.array(demand, float), capacity):
            runs = [(sequences, times, 0)]
            sequences += times
            for i in np.repeat(np.arange(len(sizes)), content).tolist():
                filled = []
                for first, n, used in runs:
                    while n:
                        got = classes[i].take(n)
                        if got is None:
                            filled.append((first, n, used))
                            break
                        length, rank, m = got
                        plan.append((length, rank, first, used))
                        filled.append((first, m, used + length))
                        first, n = first + m, n - m
                runs = filled
            for first, n, used in runs:
                leave(capacity - used, first, n)
    rest = [(x, r, n) for c in classes for x, r, n in c.left if n] + [(x, 0, n) for x, n in counts.items() if 0 < x <= least and n]
    for length, rank, n in sorted(rest, reverse=True):
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                m = -(-n // max(1, capacity // length))  # as many new sequences as the rest of this length needs
                runs, room = [(sequences, m)], capacity
                sequences += m
            else:
                room = rooms.pop(at)
                runs = open_.pop(room)
            for k, (first, m) in enumerate(runs):
                some = min(n, m)
                if some:
                    plan.append((length, rank, first, capacity - room))
                    leave(room - length, first, some)
                    rank, n = rank + some, n - some
                leave(room, first + some, m - some)
    return np.array(sorted(plan), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids): texts as ids with the end id, only longer ones cut.

    All pieces of a cut text are full but its first.
    """
    vocabulary = vocabulary or tokens.vocabulary()
    extra = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *extra,
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, encoded in tokens.encoded(vocabulary, batches, end):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, one in enumerate(encoded):
                n = len(one) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = one[4 * a:4 * b]
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; sequences are filled from 0 without gaps, up to the capacity.

    One piece or more per row of docs: a null text is the end id alone, null and repeated ids are packed like all
    others, an empty table gives no rows. Only doc_id and text are read. with_ids keeps every piece's ids (little-endian
    unsigned 32-bit), which assemble() joins to sequences.
    """
    cut = settle(pieces(docs, vocabulary, capacity, end, with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one per length
    plan = make_plan(counts, capacity)
    keys = (plan[:, 0] << 48) | plan[:, 1]  # sorted: length, then rank
    schema = T.StructType([*[f for f in cut.schema.fields if f.name != "rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            own = [batch.column(names.index(f.name)) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])], names=schema.fieldNames())

    order = ["doc_id", "piece", "ids_crc32"]
    return ranked(cut, "length", *order).select(*cut.columns, "rank").mapInArrow(place, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids, ids, doc_ids: the sequences themselves (a sequence holds no more than its capacity)."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_p"),
    ).select("sequence_id", "n_ids", F.expr("aggregate(_p, X'', (a, p) -> concat(a, p.ids))").alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
