"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dataweft.plans import relational  # noqa: E402
from dataweft.plans.registry import load  # noqa: E402
from dataweft.session import get_spark, work_path  # noqa: E402
from dataweft.sources import io  # noqa: E402

QUERIES = ["q_brand_year_damage", "q_brand_fuel_damage", "q_pagerank_lang", "q_pagerank_duplicates", "q_rank_by_lang",
           "q_components", "q_customer_features", "q_reco_prepared", "q_interactions", "q_chat_encoded", "q_row_id",
           "q_price_by_type", "q_describe_num", "q_stratified_sample", "q_user_auc", "q_changes", "q_version_compare", "q_fitted_grid", "q_als_auc"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8,
                      **{"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    base = relational.repaired(spark, d).select(*relational.REPORT_COLS)
    stored = {}
    for name, cols in (("plain", None), ("brand", ["brand"]), ("year", ["yearOfRegistration"])):
        path = work_path(spark, f"bench-{name}")
        stored[name] = io.write_partitioned(base, path, cols) if cols else io.write_table(base, path)
    cases = {n: (lambda n=n: queries[n](spark, d)) for n in QUERIES}
    cases |= {
        "report1_stored_plain": lambda: relational.brand_year_damage_report(stored["plain"]),
        "report1_stored_by_brand": lambda: relational.brand_year_damage_report(stored["brand"]),
        "report2_stored_plain": lambda: relational.brand_fuel_damage_report(stored["plain"]),
        "report2_stored_by_year": lambda: relational.brand_fuel_damage_report(stored["year"]),
    }
    only = sys.argv[1:]
    times = {}
    for name, make in cases.items():
        if only and name not in only:
            continue
        laps = []
        for _ in range(2):  # the first lap compiles
            start = time.perf_counter()
            run(make())
            laps.append(time.perf_counter() - start)
        times[name] = round(min(laps), 3)
        print(name, [round(x, 2) for x in laps], file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
