"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), and optionally
BENCH_QUERIES, a comma-separated choice of registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "coerce_text",
    "token_counts",
    "tokenize_digest",
    "mix_budget_report",
    "mix_union",
    "shuffle_order",
    "prefix_sum",
    "stream_positions",
    "next_fit_shards",
    "raw_shard_rescan",
    "fixed_token_shards",
    "token_shard_rescan",
    "prepared_shards",
    "sequential_windows",
    "batch_assembly",
    "random_train_windows",
    "eval_mean",
    "iter_time",
    "best_so_far",
    "latest_artifact",
    "topk_draw",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tokenloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small run starts the Python workers and loads classes, so that no query pays for it.
    QUERIES["tokenize_digest"](spark, sf_dir).limit(1).collect()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
