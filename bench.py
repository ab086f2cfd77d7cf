"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, to time these only
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    # load, clean, profile
    "csv_round_trip",
    "normalized_documents",
    "order_cardinality",
    "null_profile_of_documents",
    # correlation and chart tables
    "target_correlation",
    "correlation_matrix",
    "correlation_by_blocks",
    "distribution_by_priority",
    "line_price_quartiles",
    "box_stats_by_priority",
    "price_histogram",
    "yearly_average",
    "scatter_sample",
    "hash_split",
    # models
    "linear_full",
    "ridge_full",
    "field_rollup",
    "full_residuals",
    "linear_leaderboard",
    "feature_importance",
    "forest_overfit",
    # tuning
    "ridge_cv_numeric",
    "ridge_cv_full",
    "ridge_cv_priority",
    "cv_by_refitting",
    "forest_cv",
]


def materialise(df: DataFrame) -> None:
    """Compute every row and column, and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("keydrivers-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    materialise(QUERIES["yearly_average"](spark, sf_dir))

    seconds = {}
    for name in names:
        start = time.perf_counter()
        materialise(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
