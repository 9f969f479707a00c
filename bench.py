"""Headline queries, timed one after the other; prints one JSON line.

Each query is run once to warm up and then timed: its rows are counted in full
by a ``noop`` write, so no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fadeline.plans.registry import QUERIES  # noqa: E402
from fadeline.session import build_session  # noqa: E402

HEADLINES = [
    "hourly_rollup",
    "rollup_refresh",
    "lifetime_stats",
    "lifetime_stats_from_partials",
    "windowed_stats",
    "windowed_stats_from_stored_last",
    "last_value",
    "minute_completeness",
    "overview",
    "link_bands",
    "first_wins",
    "fill_nulls",
    "append_new_rows",
    "missing_references",
    "file_verdict",
    "log_hourly_archived",
    "log_user_7d",
    "log_page",
    "raw_newest",
    "delimited_rows",
    "json_rows",
    "series_range",
    "store_first_wins",
    "archive_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {"metric": "headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
