"""Bulk load of one day at the published size: 728 sublinks every 10 s.

Makes about 6.3 million rows as CSV with Spark, loads them as an archive and
times the steps.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from fadeline.plans import ingest  # noqa: E402
from fadeline.plans.store import Store  # noqa: E402
from fadeline.session import build_session, new_path  # noqa: E402
from fadeline.sources import archive  # noqa: E402

LINKS, SUBLINKS, STEPS = 364, 2, 8641


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench_archive", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = new_path(spark, "bench")
    i = F.col("id")
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.range(LINKS * SUBLINKS * STEPS).select(
        F.date_format(start + F.make_dt_interval(secs=F.floor(i / (LINKS * SUBLINKS)) * 10), "yyyy-MM-dd HH:mm:ss").alias("time"),
        (10001 + F.floor(i / SUBLINKS) % LINKS).alias("cml_id"),
        F.concat(F.lit("sublink_"), i % SUBLINKS + 1).alias("sublink_id"),
        F.round(F.rand(1) * 30, 1).alias("tsl"),
        F.when(F.rand(2) > 0.02, F.round(-40 - F.rand(3) * 20, 1)).alias("rsl"),
    )
    rows.write.option("header", True).csv(f"{root}/data")
    links = spark.range(LINKS * SUBLINKS).select(
        (10001 + F.floor(i / SUBLINKS)).alias("cml_id"), F.concat(F.lit("sublink_"), i % SUBLINKS + 1).alias("sublink_id"),
        *[F.lit(x).alias(n) for n, x in (("site_0_lon", 11.9), ("site_0_lat", 57.7), ("site_1_lon", 12.0), ("site_1_lat", 57.8), ("frequency", 28206.5), ("length", 691.4))],
        F.lit("v").alias("polarization"),
    )
    links.write.option("header", True).csv(f"{root}/metadata")

    seconds = {}

    def timed(name, action):
        begin = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - begin, 2)

    store = Store(spark, f"{root}/store")
    timed("load_metadata", lambda: store.insert_links(archive.read_metadata(spark, f"{root}/metadata", "bench")))
    timed("load_rows", lambda: store.load_unique(archive.read_raw(spark, f"{root}/data", "bench")))
    timed("lifetime_stats", lambda: store.refresh_all_stats("2026-01-02 00:00:00"))
    timed("windowed_stats", lambda: store.refresh_windowed_stats("2026-01-02 00:00:00"))
    timed("windowed_stats_again", lambda: store.refresh_windowed_stats("2026-01-02 00:00:00"))
    timed("full_rollup", store.refresh_full_rollup)
    timed("rollup_refresh", lambda: store.refresh_rollup("2026-01-02 00:00:00"))
    timed("whole_load_again", lambda: ingest.load_archive(spark, store, f"{root}/data", f"{root}/metadata", "bench", "2026-01-02", replace_all=True))
    rows_loaded = store.observations().count()
    print(json.dumps({"metric": "archive_load", "value": seconds["load_rows"], "unit": "sec", "queries": seconds, "rows": rows_loaded}))
    spark.stop()


if __name__ == "__main__":
    main()
