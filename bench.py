"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pairsignal.queries import QUERIES
from pairsignal.session import build_session

HEADLINE = [
    "rename_channels", "align_lengths", "stack_channels", "minmax_per_channel", "prepare_grid", "stack_in_time", "role_labels",
    "blank_mask", "cut_segments", "mutual_align", "aligned_inputs", "fir_highpass", "bad_deviation", "bad_hf_noise",
    "window_correlation", "remix_matrix", "receptive_field", "embed_linear", "knn_topk", "infonce_bits", "run_consistency",
    "class_distance", "metrics_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # Partitions of a few KB would be merged into one task here; on a cluster merging stays on.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seconds = {}
    for timed in (False, True):  # the first pass compiles the plans
        for name in HEADLINE:
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
