"""Wall seconds of the headline queries, warm, the least of three runs, as one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from tidewheel.plans import catalog
from tidewheel.session import session

HEADLINE = (
    "filter_eq json_extract count_by_key minmax_by_year latest_per_key tumble_6h hop_10m_5m cumulate session_gap sliding_range top_n_per_group "
    "windowed_top_n dedup_windowed lag_rising over_rows_5 trailing_median pattern_abc pattern_up3 pattern_same_direction interval_join theta_join "
    "star_broadcast fk_join multi_left_join asof_join unnest_tokens knn_top3 forecast_ar1 anomaly_ar1 dlq_split ttl_join punctuate stream_tumble stream_median"
).split()


#: The least of so many runs counts, as one run cannot tell the code from the machine.
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("filter_eq")
    run("tumble_6h")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run(name)
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, wall seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
