"""What the physical plans must and must not contain."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from fadeline.operators import layout, stats, versions
from fadeline.plans.registry import QUERIES
from fadeline.plans.views import OBSERVATIONS_AS_OF, links, observations
from fadeline.session import new_path

WRITING = ("store_", "stream_", "archive_", "dedup_rewrite", "compacted_table", "pruned_range")
PLAIN = sorted(n for n in QUERIES if not n.startswith(WRITING))


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert node not in text


def test_links_of_one_small_file_are_dealt_out(spark, tmp_path):
    spark.range(300_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 7 - 1).cast("double").alias("c_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = links(spark, str(tmp_path))
    tasks, keys = found.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task"), F.count_distinct("cml_id", "sublink_id")).first()
    assert tasks > 1 and keys == 1_500_000
    assert found.count() == 1_500_000


# Single-partition nodes are allowed where one row per hour is left, and after a top-n.
ONE_TASK = {"raw_newest", "last_steps"}


@pytest.mark.parametrize("name", PLAIN)
def test_no_unpartitioned_window(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert name in ONE_TASK or "Window" not in text.replace("WindowExpression", "")


def test_filters_reach_the_scan(spark):
    obs = observations(spark, SF_DIR)
    last = stats.last_values(obs)
    text = plan(stats.windowed_stats(obs, links(spark, SF_DIR), OBSERVATIONS_AS_OF, last))
    assert "GreaterThanOrEqual(ts,2024-01-30T18:00)" in text


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["freshness"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text
    assert "props" not in plan(QUERIES["split_periods"](spark, SF_DIR)).split("ReadSchema")[1]


def test_time_range_prunes_days(spark):
    path = new_path(spark, "table")
    layout.write_observations(observations(spark, SF_DIR).drop("seq"), path, bulk=True)
    pruned = layout.read_range(spark, path, "2024-01-20", "2024-01-21 12:00:00").where("user_id = 'tenant_a'")
    text = plan(pruned)
    filters = next(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "date" in filters and "user_id" in filters
    read = {f.split("date=")[1].split("/")[0] for f in pruned.select("*", F.input_file_name().alias("f")).select("f").distinct().toPandas().f}
    assert read == {"2024-01-20", "2024-01-21"}


def test_raw_rows_are_hash_aggregated(spark):
    """No sort of the raw rows before the first shuffle."""
    for name in ("lifetime_stats", "windowed_stats", "first_wins", "fill_nulls", "hourly_rollup", "last_value"):
        tree = plan(QUERIES[name](spark, SF_DIR)).split("\n\n")[0]
        below_first_shuffle = tree[tree.rindex("Exchange") :]
        assert "SortAggregate" not in below_first_shuffle and "HashAggregate" in below_first_shuffle, name


def test_rows_inside_files_are_sorted(spark):
    path = new_path(spark, "table")
    layout.write_observations(observations(spark, SF_DIR).drop("seq"), path)
    sample = versions.read(spark, path).inputFiles()[0]
    pdf = spark.read.parquet(sample).toPandas()
    ordered = pdf.sort_values(["cml_id", "time"], ascending=[True, False], kind="stable").reset_index(drop=True)
    assert pdf[["cml_id", "time"]].equals(ordered[["cml_id", "time"]])
