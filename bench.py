"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphlens.plans import catalog  # noqa: E402
from graphlens.plans.derived import stored_shop_graph  # noqa: E402

HEADLINE = [
    "agg1_class_fan_metrics", "agg2_class_depends_on", "agg3_module_imports", "agg27_neighbourhood_hash", "g1_impact_downstream",
    "g2_impact_upstream", "g7_class_cycles", "g9_transaction_members", "jn7_topic_edges", "jn8_shared_table_members",
    "jn11_changed_nodes", "jn37_dead_functions", "agg22_billable_loc", "snk2_stored_edges", "src4_language_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("graphlens-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    # The graph is loaded once and then asked, so loading has a figure of its own, which counts in the total.
    begin = time.perf_counter()
    stored_shop_graph(spark, folder)
    seconds = {"load_stored_graph": round(time.perf_counter() - begin, 3)}
    for name in HEADLINE:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
