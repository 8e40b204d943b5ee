"""EDF files as a Spark data source: ``spark.read.format("edf").load(path)``.

A partition is a stretch of a file's bytes; its task reads the header and then the data records that begin in the stretch,
hold an asked time and, with the option ``channels``, decodes only the named ones. Conditions on ``t`` and ``rec_id`` are
pushed down: files of other recordings make no partition, records outside the asked times are not read. The driver lists
files and never opens one.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from pairsignal.sources.edf import RANGE_BYTES, describe
from pairsignal.sources.files import open_file

SCHEMA = "rec_id string, t bigint, x array<double>"
NO_END = 1 << 62


@dataclass
class Stretch(InputPartition):
    """Bytes ``begin`` to before ``end`` of a file of ``length`` bytes."""

    path: str
    rec_id: str
    length: int
    begin: int
    end: int


def list_edf(path: str) -> list[tuple[str, int]]:
    """Paths and lengths of a file, or of all files below a folder."""
    if "://" in path or path.startswith("file:"):
        local = path.startswith("file:")
        system, inner = (fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")) if local else fs.FileSystem.from_uri(path)
        prefix = "file:" if local else path[: len(path) - len(inner.lstrip("/"))]
    else:
        system, inner, prefix = fs.LocalFileSystem(), os.path.abspath(path), "file:"
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    whole = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((prefix + (f.path if prefix == "file:" else f.path.lstrip("/")), f.size) for f in whole)


def wanted_records(header: dict, begin: int, end: int, first: int, last: int) -> tuple[int, int]:
    """The records (from, to) that begin in the byte stretch and hold a time from ``first`` to ``last``."""
    at, size, width = header["header_bytes"], header["record_bytes"], int(header["widths"][0][0])
    start, stop = -(-(begin - at) // size), -(-(end - at) // size)
    start, stop = max(start, 0, first // width), min(stop, header["n_records"], last // width + 1)
    return start, max(start, stop)


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.channels = [c.strip() for c in options["channels"].split(",")] if options.get("channels") else None
        self.first, self.last = 0, NO_END
        self.recordings: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("t",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, value - isinstance(f, LessThan))
            elif column == ("rec_id",) and isinstance(f, (EqualTo, In)):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.recordings = named if self.recordings is None else self.recordings & named
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        found = []
        for path, length in list_edf(self.path):
            rec_id = os.path.splitext(os.path.basename(path))[0]
            if self.first > self.last or (self.recordings is not None and rec_id not in self.recordings):
                continue
            found += [Stretch(path, rec_id, length, b, b + self.range_bytes) for b in range(0, length, self.range_bytes)]
        return found or [Stretch("", "", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        header = describe(partition.path, partition.rec_id, partition.length)
        labels = header["labels"][0]
        if not labels or not header["record_bytes"]:
            return
        chosen = range(len(labels)) if self.channels is None else [labels.index(c) for c in self.channels]
        start, stop = wanted_records(header, partition.begin, partition.end, self.first, self.last)
        if start >= stop:
            return
        with open_file(partition.path) as f:
            f.seek(header["header_bytes"] + start * header["record_bytes"])
            data = np.frombuffer(f.read((stop - start) * header["record_bytes"]), dtype="<i2").reshape(stop - start, -1)
        width, starts, gains, offsets = int(header["widths"][0][0]), header["starts"][0], header["gains"][0], header["offsets"][0]
        x = np.stack([data[:, starts[i]: starts[i] + width].reshape(-1) * gains[i] + offsets[i] for i in chosen], axis=1)
        t = start * width + np.arange(len(x))
        kept = (t >= self.first) & (t <= self.last)
        x, t = x[kept], t[kept]
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([partition.rec_id] * len(x), pa.string()), pa.array(t, pa.int64()), held], names=["rec_id", "t", "x"])


class EdfSource(DataSource):
    """``rec_id, t, x`` in volts. Options: path, channels (names, comma-separated, in the order wanted), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)
