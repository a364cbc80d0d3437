"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated list (or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from veilgrain.operators import central
from veilgrain.queries import common, load
from veilgrain.session import local_session

HEADLINE = [
    "release_shipments",
    "release_provenance",
    "preaggregate_staging",
    "downgrade_cell",
    "feature_stats",
    "support_by_granularity",
    "mutual_information",
    "probe_auc",
    "value_persistence",
    "join_degree_self_join",
    "ledger_range_join",
    "asof_contract_join",
    "scorecard",
    "decide",
    "counterfactuals",
    "select_min_effvar",
    "lps_six_component",
    "hr_k_estimate",
    "ue_k_estimate",
    "sketch_wxd_estimate",
    "shuffle_release",
    "materialize_active",
    "inv_no_escalation",
    "lps_drift",
]
MORE = ["lifecycle_release", "heavy_hitters_sketch"]  # timed, but not in the total, which stays comparable between rounds


def skewed_release(spark, sf_dir):
    """Release of twenty times the events, a third of them of one contributor and one item."""
    events = common.weekly_events(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    hot = F.col("copy") % 3 == 0
    events = events.withColumns(
        {
            "event_id": F.col("event_id") * 20 + F.col("copy"),
            "contributor": F.when(hot, -1).otherwise(F.col("contributor") * 20 + F.col("copy")),
            "k": F.when(hot, 0).otherwise(F.col("k")),
        }
    )
    staged = central.bounded_staging(events, common.item_cell(), common.cluster_cell(), common.CONTRACT)
    return central.release(staged, common.CONTRACT, 1706745600000)


OWN = {"skewed_release": skewed_release}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    all_queries = load()[0] | OWN
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(all_queries) if wanted == "all" else wanted.split(",") if wanted else [*HEADLINE, *MORE, *OWN]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before the clock runs
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            start = time.perf_counter()
            all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name:32s} {seconds[name]:8.3f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(s for n, s in seconds.items() if wanted or n in HEADLINE), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
