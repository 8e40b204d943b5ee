"""Saved (channels, time) arrays as wide samples, read in bounded stretches of time."""

from __future__ import annotations

import numpy as np
from numpy.lib import format as npy_format
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignal.functions.chunks import map_chunks
from pairsignal.functions.text import stem
from pairsignal.session import settle
from pairsignal.sources.files import list_files, open_file

RANGE_BYTES = 4 << 20
HEADER = "path string, rec_id string, dtype string, fortran boolean, n_channels bigint, n_samples bigint, data_start bigint, lead array<bigint>"


def _describe(path: str, rec_id: str) -> dict:
    """The last axis is time, all axes before it are channels; a plain list of values is one channel."""
    with open_file(path) as f:
        version = npy_format.read_magic(f)
        read = npy_format.read_array_header_1_0 if version == (1, 0) else npy_format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        lead, n = [int(k) for k in shape[:-1]], int(shape[-1]) if shape else 1
        return {
            "path": [path], "rec_id": rec_id, "dtype": dtype.str, "fortran": bool(fortran), "n_channels": int(np.prod(lead, dtype=np.int64)),
            "n_samples": n, "data_start": int(f.tell()), "lead": [lead],
        }


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    files = list_files(spark, path).withColumn("rec_id", stem(F.col("path"))).select("path", "rec_id")
    return settle(map_chunks(files.repartition("path"), lambda row: _describe(row["path"], row["rec_id"]), HEADER))


def _ranges(headers: DataFrame, range_bytes: int) -> DataFrame:
    """One row per stretch of time of at most about ``range_bytes``."""
    width = F.greatest(F.regexp_extract("dtype", r"(\d+)$", 1).cast("bigint"), F.lit(1)) * F.when(F.col("dtype").contains("U"), 4).otherwise(1)
    size = F.greatest(F.floor(F.lit(range_bytes) / (F.col("n_channels") * width)), F.lit(1)).cast("bigint")
    return headers.filter("n_samples > 0 and n_channels > 0").withColumn("span", size).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_samples") - 1, F.col("span")))
    ).repartition("path", "first")


def _stretch(row: dict) -> np.ndarray:
    """The stretch's values as (time, channels)."""
    dtype, lead = np.dtype(row["dtype"]), [int(k) for k in row["lead"]]
    n = int(min(row["span"], row["n_samples"] - row["first"]))
    with open_file(row["path"]) as f:

        def read(start: int, count: int) -> np.ndarray:
            f.seek(row["data_start"] + start * dtype.itemsize)
            return np.frombuffer(f.read(count * dtype.itemsize), dtype=dtype)

        if row["fortran"]:  # the first axis runs fastest, so a time's channels lie together, their axes in reverse
            x = read(row["first"] * row["n_channels"], n * row["n_channels"]).reshape([n, *reversed(lead)])
            return x.transpose([0, *range(len(lead), 0, -1)]).reshape(n, -1)
        return np.stack([read(c * row["n_samples"] + row["first"], n) for c in range(row["n_channels"])], axis=1)


def samples(headers: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rec_id, t, x`` of numeric arrays of any rank: row = time, features = channels, whatever the array's proportions."""
    def run(row: dict) -> dict:
        x = _stretch(row)
        return {"rec_id": row["rec_id"], "t": row["first"] + np.arange(len(x)), "x": x.astype(float)}

    return map_chunks(_ranges(headers, range_bytes), run, "rec_id string, t bigint, x array<double>")


def values(headers: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rec_id, t, label, y`` of saved lists (labels, targets): the value as text, and as a number where it is one."""
    def run(row: dict) -> dict:
        found = _stretch(row)[:, 0]
        if found.dtype.kind == "S":
            found = np.char.decode(found, "utf-8")
        number = found.astype(float) if found.dtype.kind in "biuf" else np.full(len(found), np.nan)
        return {"rec_id": row["rec_id"], "t": row["first"] + np.arange(len(found)), "label": [str(v) for v in found.tolist()], "y": number}

    made = map_chunks(_ranges(headers.filter(F.size("lead") == 0), range_bytes), run, "rec_id string, t bigint, label string, y double")
    return made.withColumn("y", F.nullif(F.col("y"), F.lit(float("nan"))))


def with_values(rows: DataFrame, found: DataFrame, suffix: str = "") -> DataFrame:
    """Rows (``pairing, t``) with the value saved for their time as ``y``; NULL without a file or a value for the time.

    A file belongs to the pairing it is named after, with ``suffix`` behind it ('_continuous').  The value column joins by
    (pairing, t), so a long recording is split by time.
    """
    named = found.filter(F.col("rec_id").endswith(suffix)) if suffix else found
    keyed = named.select(F.expr(f"left(rec_id, length(rec_id) - {len(suffix)})").alias("pairing"), "t", "y")
    return rows.join(keyed, ["pairing", "t"], "left")
