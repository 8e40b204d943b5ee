"""Vector expressions on ``array<double>`` columns and numeric casts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    # The length goes through a one-element array, or it would be computed again for every element.
    return F.get(
        F.transform(F.array(norm(a)), lambda n: F.when(n == 0, a).otherwise(F.transform(a, lambda v: v / n))), F.lit(0)
    )


def unit_rows(e: np.ndarray) -> np.ndarray:
    """As ``unit`` for the rows of a matrix, to the last bit."""
    square = np.zeros(len(e))
    for i in range(e.shape[1]):
        square = square + e[:, i] * e[:, i]
    length = np.sqrt(square)[:, None]
    return np.divide(e, length, out=np.array(e, dtype=float), where=length != 0)


def same_rows(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every different vector, and which of them each row is."""
    e = e + 0.0
    order = np.lexsort(e.T[::-1]) if e.shape[1] else np.arange(len(e))
    new = np.ones(len(e), bool)
    new[1:] = (e[order[1:]] != e[order[:-1]]).any(axis=1)
    which = np.empty(len(e), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def as_array(x: Column, kind: str) -> Column:
    """Cast each element: float, double, tinyint, int or bigint."""
    return x.cast(f"array<{kind}>")


@F.arrow_udf(T.ArrayType(T.FloatType()))
def half(x: pa.Array) -> pa.Array:
    """Round each element to half precision, kept as float; all rows of a batch in one conversion."""
    values = x.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
    lengths = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=x.is_null())


def seconds_to_sample(seconds: Column, sfreq: Column) -> Column:
    """Sample index of a time, cut toward zero."""
    return (seconds * sfreq).cast("bigint")


def sample_to_seconds(t: Column, sfreq: Column) -> Column:
    return t / sfreq
