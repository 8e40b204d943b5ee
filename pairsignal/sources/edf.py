"""European Data Format files as tables.

Headers are read first, one small read per file.  The data records of every file are then cut into ranges of
bounded size, and each range is decoded by its own task, so one long recording spreads over many tasks.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignal.functions.chunks import map_chunks
from pairsignal.functions.text import stem
from pairsignal.session import settle
from pairsignal.sources.files import list_files, open_file

# Fixed values of the format: field widths in the fixed and the per-signal header, units, reserved labels.
FIXED_FIELDS = [("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("header_bytes", 8),
                ("reserved", 44), ("n_records", 8), ("record_seconds", 8), ("n_signals", 4)]
SIGNAL_FIELDS = [("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8),
                 ("dig_max", 8), ("prefilter", 80), ("n_samples", 8), ("reserved", 32)]
VOLTS = {"uV": 1e-6, "µV": 1e-6, "mV": 1e-3, "V": 1.0}
ANNOTATION_LABEL = "EDF Annotations"
STIM_LABELS = ("STATUS", "TRIGGER")
RANGE_BYTES = 4 << 20

HEADER = (
    "path string, rec_id string, subject string, sfreq double, n_samples bigint, n_records bigint, record_bytes bigint, "
    "header_bytes bigint, labels array<string>, types array<string>, starts array<bigint>, widths array<bigint>, "
    "gains array<double>, offsets array<double>, note_starts array<bigint>, note_widths array<bigint>"
)


def parse_header(raw: bytes) -> dict:
    """Fields of a file header, text trimmed; per-signal fields as lists."""
    at, out = 0, {}
    for name, width in FIXED_FIELDS:
        out[name] = raw[at : at + width].decode("latin-1").strip()
        at += width
    n = int(out["n_signals"])
    for name, width in SIGNAL_FIELDS:
        out[name if name != "reserved" else "signal_reserved"] = [
            raw[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)
        ]
        at += n * width
    return out


def describe(path: str, rec_id: str, length: int) -> dict:
    """The columns of HEADER for one file."""
    with open_file(path) as f:
        first = f.read(256)
        raw = first + f.read(int(first[252:256]) * 256)
    h = parse_header(raw)
    if h["reserved"].startswith("EDF+D"):
        raise ValueError(f"{path}: the recording is not continuous")
    counts = np.array([int(v) for v in h["n_samples"]], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    signal = [i for i, label in enumerate(h["label"]) if label != ANNOTATION_LABEL]
    notes = [i for i, label in enumerate(h["label"]) if label == ANNOTATION_LABEL]
    rates = {int(counts[i]) for i in signal}
    if len(rates) > 1:
        raise ValueError(f"{path}: channels have different sampling rates")
    gains, offsets = [], []
    for i in signal:
        low, high, dlow, dhigh = (float(h[k][i]) for k in ("phys_min", "phys_max", "dig_min", "dig_max"))
        unit = VOLTS.get(h["unit"][i], 1.0)
        gain = (high - low) / (dhigh - dlow)
        gains.append(gain * unit)
        offsets.append((low - dlow * gain) * unit)
    rate = rates.pop() if rates else 0
    records = int(h["n_records"])
    if records < 0:  # not filled in while recording: as many as the file holds
        records = (length - int(h["header_bytes"])) // max(1, int(counts.sum()) * 2)
    return {
        "path": [path], "rec_id": rec_id, "subject": h["patient"], "sfreq": rate / float(h["record_seconds"] or 1),
        "n_samples": records * rate, "n_records": records, "record_bytes": int(counts.sum()) * 2,
        "header_bytes": int(h["header_bytes"]), "labels": [[h["label"][i] for i in signal]],
        "types": [["stim" if h["label"][i].upper() in STIM_LABELS else "eeg" for i in signal]],
        "starts": [[int(begins[i]) for i in signal]], "widths": [[int(counts[i]) for i in signal]],
        "gains": [gains], "offsets": [offsets],
        "note_starts": [[int(begins[i]) for i in notes]], "note_widths": [[int(counts[i]) for i in notes]],
    }


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; the headers are read once."""
    files = list_files(spark, path).withColumn("rec_id", stem(F.col("path"))).select("path", "rec_id", "length")
    return settle(map_chunks(files.repartition("path"), lambda row: describe(row["path"], row["rec_id"], row["length"]), HEADER))


def recordings(headers: DataFrame) -> DataFrame:
    return headers.select(
        "rec_id", "subject", F.lit(None).cast("string").alias("role"), "sfreq", "n_samples", F.col("path").alias("file")
    )


def channels(headers: DataFrame) -> DataFrame:
    return headers.select("rec_id", F.posexplode(F.arrays_zip("labels", "types")).alias("ch_idx", "_c")).select(
        "rec_id", "ch_idx", F.col("_c.labels").alias("ch"), F.col("_c.types").alias("type"), F.lit(False).alias("bad")
    )


def _ranges(headers: DataFrame, range_bytes: int) -> DataFrame:
    """Each file once per run of ``span`` data records."""
    span: Column = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.col("record_bytes"))).cast("bigint")
    cut = headers.filter("n_records > 0").withColumn("span", span).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_records") - 1, F.col("span")))
    )
    return cut.repartition("path", "first")


def _records(row: dict) -> np.ndarray:
    """The digital values of a range as (records, values per record)."""
    count = min(row["span"], row["n_records"] - row["first"])
    with open_file(row["path"]) as f:
        f.seek(row["header_bytes"] + row["first"] * row["record_bytes"])
        raw = f.read(count * row["record_bytes"])
    return np.frombuffer(raw, dtype="<i2").reshape(count, -1)


def samples(headers: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Wide samples in volts, channels in file order: ``rec_id, t, x``."""

    def run(row: dict) -> dict | None:
        if not len(row["starts"]):
            return None
        data, width = _records(row), int(row["widths"][0])
        parts = [data[:, s : s + width].reshape(-1) * g + o for s, g, o in zip(row["starts"], row["gains"], row["offsets"])]
        t = row["first"] * width + np.arange(len(parts[0]))
        return {"rec_id": row["rec_id"], "t": t, "x": np.stack(parts, axis=1)}

    return map_chunks(_ranges(headers, range_bytes), run, "rec_id string, t bigint, x array<double>")


def parse_notes(raw: bytes) -> list[tuple[float, float, str]]:
    """Onset, duration and text of the annotations in one record; time-keeping entries carry no text."""
    found = []
    for entry in raw.split(b"\x00"):
        match = re.match(rb"^([+-]\d+\.?\d*)(?:\x15(\d+\.?\d*))?\x14(.*)\x14$", entry, re.S)
        if match:
            onset, duration = float(match[1]), float(match[2] or 0.0)
            found += [(onset, duration, t.decode("utf-8", "replace")) for t in match[3].split(b"\x14") if t]
    return found


def annotations(headers: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rec_id, onset_s, duration_s, description`` of files with annotation channels, of which there may be several."""

    def run(row: dict) -> dict | None:
        data = _records(row)
        parts = [data[:, s : s + w] for s, w in zip(row["note_starts"], row["note_widths"])]
        notes = [n for part in parts for record in part for n in parse_notes(np.ascontiguousarray(record).tobytes())]
        if not notes:
            return None
        onset, duration, description = map(list, zip(*notes))
        return {"rec_id": row["rec_id"], "onset_s": onset, "duration_s": duration, "description": description}

    noted = headers.filter(F.size("note_starts") > 0)
    return map_chunks(_ranges(noted, range_bytes), run, "rec_id string, onset_s double, duration_s double, description string")
