"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.  Every query
runs to completion into a no-op sink; the first, untimed query warms the session.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sharewise.suite import QUERIES

HEADLINE = (
    "clean_documents",
    "count_records",
    "strat_split",
    "bootstrap_resample",
    "term_counts",
    "fit_idf",
    "tfidf",
    "mean_embedding",
    "score_linear",
    "density_sliding",
    "density_radius",
    "prevalence_ml",
    "calibrated_threshold",
    "posterior_calibrated",
    "compare_distributions",
    "confusion_soft",
    "auroc",
    "optimal_threshold",
    "four_variant_report",
    "overlap_weights",
    "fit_logistic",
    "bootstrap_benchmark",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sharewise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["count_records"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
