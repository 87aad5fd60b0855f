"""Time the registered queries: one JSON line.

BENCH_SF_DIR (data), BENCH_CPUS (cores), BENCH_QUERIES (comma-separated names),
BENCH_RUNS (timed runs per query, after one untimed run).
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from framelark.plans import catalog  # noqa: E402
from framelark.session import local_session  # noqa: E402

HEADLINE = [
    "normalized_dynamics", "dynamic_features", "context_window_zero", "lowpass_fir",
    "moments_all_scopes", "normalize_stds_corpus", "voicing", "trim_edges", "abx_items",
    "triphone_df", "triphone_index", "transcript_phonetic", "load_dataset", "rmse_corpus",
    "dense_forward", "mixture_predict", "mfcc", "lpc", "spline_fill", "butter_filtfilt",
    "resample_fft", "abx_counts", "abx_scores", "split_corpus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else (
        list(catalog.QUERIES) if chosen == "all" else chosen.split(",")
    )
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names[:2]:  # the first plans of a session pay for its start
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        times = []
        for turn in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if turn:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over the queries, warm",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cpus, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
