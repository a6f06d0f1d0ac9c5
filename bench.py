"""Headline benchmark: word count, sorting, k-means (+ a few core operators).

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Every query result is forced through the ``noop`` sink (a sort followed by
count() would be optimised away); one warm-up run, then the median of
$BENCH_REPS runs. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import kmeans  # noqa: E402
from tessera.plans.registry import queries  # noqa: E402
from tessera.session import build_session  # noqa: E402
from tessera.sources.tables import load  # noqa: E402

HEADLINE = [
    "wc_split_tokens", "wc_space_runs", "wc_frequencies",
    "sort_by_key_plain", "sort_pairs_app", "sort_float32_by_key", "sort_range_partitioned",
    "kmeans_fit",
    "join_inner", "join_cogroup", "key_reduce_sum", "key_group", "agg_histogram_even", "zip_with_index",
]


class _Round:
    """One k-means round on persisted points (the per-round metric)."""

    def __init__(self):
        self.pts, self.centers = None, None

    def __call__(self, spark, sf_dir):
        if self.pts is None:
            raw = kmeans.as_points(load(spark, sf_dir, "embeddings"), "embedding", "vec_id")
            self.pts = raw.persist()
            self.pts.count()
            self.centers = kmeans.initial_centers(self.pts, 10, "vec_id", 1)
        kmeans.kmeans_step(self.pts, self.centers)
        return None


def run_once(fn, spark, sf_dir) -> float:
    t0 = time.perf_counter()
    df = fn(spark, sf_dir)
    if df is not None:
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    reps = int(os.environ.get("BENCH_REPS", "5"))
    extra = {}
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    if log_dir:  # stage/task times without any UI: read with tools/stage_times.py
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                 "spark.eventLog.compress": "false"}
    spark = build_session(app_name="tessera-bench", extra=extra)
    qs = queries()
    todo = {k: qs[k] for k in HEADLINE}
    todo["kmeans_round"] = _Round()
    only = os.environ.get("BENCH_ONLY")
    if only:
        todo = {k: v for k, v in todo.items() if re.search(only, k)}
    out, failed = {}, {}
    for name, fn in todo.items():
        try:
            run_once(fn, spark, sf_dir)  # warm-up
            times = [run_once(fn, spark, sf_dir) for _ in range(reps)]
        except Exception as e:  # noqa: BLE001 — report it, keep measuring the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr)
            continue
        out[name] = round(statistics.median(times), 4)
        print(f"# {name}: median {out[name]:.3f}s of {reps}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    rounds = {k for k in out if k.startswith("kmeans_round")}
    total = sum(v for k, v in out.items() if k not in rounds)
    print(json.dumps({"metric": "headline_total_median", "value": round(total, 4), "unit": "sec",
                      "queries": out, "failed": failed, "sf": sf, "reps": reps,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8"))}))
    spark.stop()


if __name__ == "__main__":
    main()
