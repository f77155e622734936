"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores.
Every query is executed in full into a sink that discards its rows. The gold
and predictions tables are written once, timed as ``gold_table_write``, and
then read by the serving queries, as a deployment would do.
"""

from __future__ import annotations

import json
import os
import sys
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))

HEADLINE = [
    "a1_passer_box", "j1_null_safe_outer", "a10_team_week_sums", "a7_latest_team",
    "j15_asof_orders", "j15_asof_events", "w1_blend_5", "w1_blend_sparse",
    "w5_weeks_seen_mean", "w7_top_two_receivers", "gold_features",
]
SERVING = [
    "w10_latest_appearance", "w14_slate_rank", "a21_mae_by_week", "q1_list_players",
    "q4_latest_predictions", "q9_week_stats", "q10_team_roster", "v1_rankings",
    "v7_gold_report", "g10_slate_features",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from checks.registry import QUERIES
    from checks.suite import domain
    from weekcast.session import build_session

    spark = build_session("bench", master=f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.log.level": "ERROR"})
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    def run(name: str):
        return lambda: QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()          # start the executors
    for name in HEADLINE:
        timed(name, run(name))
    timed("gold_table_write", lambda: domain(spark, FOLDER).predictions_path)
    for name in SERVING:
        timed(name, run(name))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
