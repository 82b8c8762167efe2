"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. The join queries q3 and q5 also
run under every transfer mode and join order (the optimizer's, left-deep, random left-deep, random
bushy), once to warm up and once for the time; the spread (slowest over fastest) tells how much the order matters.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HEADLINE = ["q1_pricing_summary", "q3_shipping_priority", "q5_local_suppliers", "q6_forecast", "q10_returns", "q12_priorities", "q13_order_counts", "q18_large_orders", "transfer_bloom_join_q5", "transfer_pt_q5", "transfer_rpt_q5", "transfer_rpt_q3", "join_asof", "join_range", "grouping_sets", "window_ranks", "window_frames", "distinct_on", "fn_aggregates", "recursive_graph"]
SEEDS = 2


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from quarry.operators.transfer import JoinOrder, TransferMode
    from quarry.plans import registry, tpch
    from quarry.session import session

    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(of, runs: int = 3) -> float:
        took = []
        for _ in range(runs + 1):
            began = time.time()
            of().write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return round(median(took[1:]), 4)

    found = {name: timed(lambda name=name: registry.QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    orders = {JoinOrder.CATALYST: 1, JoinOrder.LEFT_DEEP: 1, JoinOrder.RANDOM_LEFT_DEEP: SEEDS, JoinOrder.RANDOM_BUSHY: SEEDS}
    robust: dict[str, dict] = {}
    for name, of in (("q3", tpch._q3), ("q5", tpch._q5)):
        for mode in (TransferMode.NONE, TransferMode.BLOOM_JOIN, TransferMode.PT, TransferMode.RPT):
            by = {order.value: [timed(lambda order=order, seed=seed: of(spark, sf_dir, mode, order, seed), 1) for seed in range(n)] for order, n in orders.items()}
            every = [x for times in by.values() for x in times]
            robust[f"{name}_{mode.value}"] = {"median": round(median(every), 4), "spread": round(max(every) / min(every), 2), "orders": by}
    print(json.dumps({"metric": "total median seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "robustness": robust, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
