"""Fixed table layouts. ``t`` is the sample index, ``x`` one value per channel in ``ch_idx`` order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RECORDINGS = "rec_id string, subject string, role string, sfreq double, n_samples bigint, file string"
CHANNELS = "rec_id string, ch_idx int, ch string, type string, bad boolean"
SAMPLES_LONG = "rec_id string, ch string, ch_idx int, t bigint, x double"
SAMPLES_WIDE = "rec_id string, t bigint, x array<double>"
ANNOTATIONS = "rec_id string, onset_s double, duration_s double, description string"
SEGMENTS = "dyad_id string, kind string, start_t bigint, end_t bigint, onset_src double, onset_dst double, duration_s double"
MONTAGE = "ch string, px double, py double, pz double"
DYADS = "dyad_id string, pairing string, rec_a string, role_a string, rec_b string, role_b string"
GRID = "clean string, pairing string, scaling string, rec_a string, rec_b string"
EMBEDDINGS = "pairing string, run_id int, t bigint, e array<double>"
LABELS = "pairing string, t bigint, gch_idx int, role string, y tinyint"
TRAITS = "dyad_id string, t bigint, y double"
FIT_HISTORY = "pairing string, run_id int, iter int, loss double, bits double"
METRICS = (
    "pairing string, scaling string, run_id int, n_train bigint, n_val bigint, "
    "gof_bits double, acc_train double, acc_val double, r2 double, cont_r2 double"
)
PROCESSING_LOG = (
    "original_file string, ts string, "
    "steps array<struct<step: string, description: string, params: map<string, string>>>"
)
BAD_CHANNELS = "rec_id string, ch string, criterion string"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select the columns of ``ddl`` in order; a missing column or another type is an error."""
    wanted = T.StructType.fromDDL(ddl)
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in wanted.fields:
        if field.name not in have:
            raise ValueError(f"column {field.name} is missing")
        if have[field.name].simpleString() != field.dataType.simpleString():
            raise ValueError(
                f"column {field.name} is {have[field.name].simpleString()}, expected {field.dataType.simpleString()}"
            )
    return df.select(*[f.name for f in wanted.fields])
