"""Seconds of headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from tessera import catalog
from tessera.session import session

HEADLINE = [
    "pricing_summary", "filter_project", "aggregates", "quantiles", "group_lists", "join_inner", "join_semi", "asof_backward", "asof_nearest", "over_partition", "shift_diff", "rolling_rows", "rolling_time",
    "dynamic_tumbling", "dynamic_sliding", "top_orders", "pivot", "explode_words", "strings", "times", "lists", "udfs", "sql_text", "describe",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in ["pricing_summary", *HEADLINE]:  # the first run warms the session up
        begun = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begun, 3)
    # 100 million generated rows: filter, sum and count
    begun = time.time()
    n, total = spark.range(100_000_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS k", "1.0D AS v").filter("k = 'A'").selectExpr("count(*)", "sum(v * 2)").first()
    assert (n, total) == (50_000_000, 100_000_000.0)
    seconds["stress_100m"] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
