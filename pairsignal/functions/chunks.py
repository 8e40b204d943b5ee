"""Sample rows packed into bounded chunks, and numpy work on them inside Arrow map tasks.

One chunk holds at most a block of consecutive samples of one key as a flat matrix.  Per-recording metadata is
joined to chunks, not to samples, so it travels once per block; Spark shuffles and schedules the chunks.

Short pairings and their embeddings are kept as whole chunks: one row per key with all its samples and the lengths of its
pairing (``n_samples, n_train``).  The times ``ts`` and the flat values are the bytes of numpy arrays, so Spark moves them as
they are.  Operators that take such rows answer each in one task, without a shuffle of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 4096  # samples in one chunk
WHOLE = 2048  # samples up to which a pairing is kept as one whole chunk

_ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
}


def _arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return _ARROW[name]


def pack(rows: DataFrame, keys: Sequence[str], block: str = "block", order: str = "t", value: str = "x",
         extra: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, block): ``ts`` (the ``order`` values, sorted), ``xs`` (flat values), one array per extra column."""
    fields = [order, value, *extra]
    packed = rows.groupBy(*keys, block).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_p"))

    def column(name: str):
        return F.col(f"_p.{name}")

    values = column(value)
    flat = F.flatten(values) if isinstance(rows.schema[value].dataType, T.ArrayType) else values
    return packed.select(*keys, block, column(order).alias("ts"), flat.alias("xs"), *[column(e).alias(e) for e in extra])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    columns = []
    for column in batch.columns:
        if pa.types.is_list(column.type):
            offsets = column.offsets.to_numpy()
            columns.append((offsets, column.values.to_numpy(zero_copy_only=False)))
        else:
            columns.append((None, column.to_pylist()))
    for i in range(batch.num_rows):
        yield {
            n: (c[1][i] if c[0] is None else c[1][c[0][i] : c[0][i + 1]]) for n, c in zip(names, columns)
        }


def _array(values, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        if isinstance(values, np.ndarray):
            flat = np.ascontiguousarray(values, dtype=kind.value_type.to_pandas_dtype()).reshape(-1)
            width = values.shape[1] if len(values) else 0
            offsets = np.arange(len(values) + 1, dtype=np.int32) * width
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind.value_type))
        return pa.array([None if v is None else np.asarray(v).tolist() for v in values], type=kind)
    return pa.array(values, type=kind)


def record(columns: dict, ddl: str) -> pa.RecordBatch:
    """A record batch in the layout of ``ddl``; scalars repeat to the length of the arrays."""
    fields = [(name, _arrow_type(kind)) for name, kind in (part.split() for part in ddl.split(","))]
    size = next((len(v) for v in columns.values() if isinstance(v, (np.ndarray, list))), 1)
    arrays = []
    for name, kind in fields:
        v = columns[name]
        arrays.append(_array(v if isinstance(v, (np.ndarray, list)) else [v] * size, kind))
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def map_chunks(df: DataFrame, fn: Callable[[dict], dict | None], ddl: str) -> DataFrame:
    """Apply ``fn`` to each row (array columns as numpy arrays); it returns output columns or None."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                out = fn(row)
                if out is not None:
                    yield record(out, ddl)

    return df.mapInArrow(run, ddl)


def is_whole(df: DataFrame) -> bool:
    """Whether the rows are whole chunks."""
    return "ts" in df.columns


def layout(df: DataFrame, *columns: str) -> str:
    """Columns of ``df`` with their types, as ``map_spaces`` takes them."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _numbers(name: str) -> type:
    return np.int64 if name == "ts" else np.float64


def map_spaces(df: DataFrame, fn: Callable[[dict], dict | None], ddl: str) -> DataFrame:
    """As ``map_chunks`` for whole chunks: bytes are arrays in ``fn``, and the small outputs of several rows leave together.

    Arrays it returns for a column of bytes come in a list, one for each row.
    """
    kinds = dict(part.split() for part in ddl.split(","))

    def run(batches):
        held: dict[str, list] = {n: [] for n in kinds}
        size = 0
        for batch in batches:
            for row in rows_of(batch):
                out = fn({n: np.frombuffer(v, _numbers(n)) if isinstance(v, bytes) else v for n, v in row.items()})
                if out is None:
                    continue
                many = next((len(v) for v in out.values() if isinstance(v, (np.ndarray, list))), 1)
                for n, kind in kinds.items():
                    values = out[n] if isinstance(out[n], (np.ndarray, list)) else [out[n]] * many
                    held[n].extend([np.ascontiguousarray(v, _numbers(n)).tobytes() for v in values] if kind == "binary" else values)
                size += many
                if size >= FLUSH:
                    yield record(held, ddl)
                    held, size = {n: [] for n in kinds}, 0
        if size:
            yield record(held, ddl)

    return df.mapInArrow(run, ddl)


def of_split(rows: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """The rows of a split; of whole chunks, the first ``n_fit`` samples of which are training ones, that part of ``columns``."""
    if not is_whole(rows):
        return rows.filter(F.col("split") == split)
    edge = F.col("n_fit") * 8
    part = lambda c: F.substring(c, F.lit(1), edge) if split == "train" else F.substring(c, edge + 1, F.octet_length(c))
    return rows.withColumns({c: part(c) for c in columns})


def unpacked(whole: DataFrame, keys: Sequence[str], values: str, out: str) -> DataFrame:
    """Whole chunks as rows again: ``keys, t`` and the vector of each sample as ``out``."""

    def run(row: dict) -> dict:
        t = np.frombuffer(row["ts"], np.int64)
        return {**{k: row[k] for k in keys}, "t": t, out: np.frombuffer(row[values]).reshape(len(t), -1)}

    columns = whole.select(*keys, "ts", values)
    return map_chunks(columns, run, f"{layout(columns, *keys)}, t bigint, {out} array<double>")


def matrix(row: dict, width: int | None = None, values: str = "xs", order: str = "ts") -> np.ndarray:
    """The chunk's values as (samples, channels)."""
    n = len(row[order])
    return row[values].reshape(n, -1 if n else (width or 0))


FLUSH = 64  # keys whose partial sums a task holds before it emits them


def summed(df: DataFrame, keys: Sequence[str], fn: Callable[[dict], Iterator[tuple[tuple, np.ndarray]]], key_ddl: str) -> DataFrame:
    """Sum vectors over all chunks: ``fn`` yields (key, vector) per chunk; result is ``keys, v array<double>``.

    Vectors add up inside the task first; the shuffle moves one partial vector per task and key.
    """
    ddl = f"{key_ddl}, v array<double>"
    names = list(keys)

    def emit(held: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
        columns = {n: [key[i] for key, _ in held] for i, n in enumerate(names)}
        columns["v"] = [v for _, v in held]
        return record(columns, ddl)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in rows_of(batch):
                for key, vector in fn(row):
                    held[key] = held[key] + vector if key in held else vector
                if len(held) >= FLUSH:
                    yield emit(list(held.items()))
                    held = {}
        if held:
            yield emit(list(held.items()))

    def merge(batches):
        """Partial vectors come sorted by key: one key's sum at a time."""
        done, at, total = [], None, None
        for batch in batches:
            for row in rows_of(batch):
                key = tuple(row[n] for n in names)
                if key == at:
                    total = total + row["v"]
                    continue
                if at is not None:
                    done.append((at, total))
                if len(done) >= FLUSH:
                    yield emit(done)
                    done = []
                at, total = key, row["v"]
        if at is not None:
            done.append((at, total))
        if done:
            yield emit(done)

    return df.mapInArrow(run, ddl).repartition(*names).sortWithinPartitions(*names).mapInArrow(merge, ddl)
