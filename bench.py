"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1).  Each query runs once unmeasured (warm-up), then
``$BENCH_REPEATS`` (default 3) measured times; the reported time is the
median.  Every run forces the full result through the ``noop`` sink; the
fact is never cached.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inspectkit.session import get_session  # noqa: E402


def _force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def headline():
    """Name -> callable(spark, sf_dir) that does all the work of one query."""
    from inspectkit.operators import classify as CL
    from inspectkit.plans.catalog import all_queries, fact
    from inspectkit.plans.q_ml import CLASSIFIER_FEATURES, CLASSIFIER_TARGET

    qs = all_queries()

    def plain(name):
        return lambda spark, sf: _force(qs[name].fn(spark, sf))

    def train(spark, sf):
        r = CL.train_defect_classifier(fact(spark, sf), CLASSIFIER_FEATURES, CLASSIFIER_TARGET)
        _force(r.metrics)

    return {
        "defect_pareto": plain("defect_pareto"),
        "supplier_ranking": plain("supplier_ranking"),
        "quality_index_stats": plain("quality_index_stats"),
        "trend_daily": plain("trend_daily"),
        "kpi_cube": plain("kpi_cube"),
        "root_cause_drilldown": plain("root_cause_drilldown"),
        "seasonal_decompose": plain("seasonal_decompose"),
        "forecast_ar1": plain("forecast_ar1"),
        "quality_report": plain("quality_report"),
        "numeric_correlation": plain("numeric_correlation"),
        "detect_anomalies": plain("detect_anomalies"),
        "train_defect_classifier": train,
        "stream_daily_trend": plain("stream_daily_trend"),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [s for s in os.environ.get("BENCH_QUERIES", "").split(",") if s]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, int(cpus))))
    times: dict[str, float] = {}
    for name, run in headline().items():
        if only and name not in only:
            continue
        run(spark, sf_dir)  # warm-up, unmeasured
        samples = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            run(spark, sf_dir)
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "repeats": repeats,
    }))


if __name__ == "__main__":
    main()
