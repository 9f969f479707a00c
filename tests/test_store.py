"""Stored tables, ingestion of files, streams."""

import json
import time
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fadeline.operators import layout, rollup, stats, upsert, versions
from fadeline.plans import ingest
from fadeline.plans.store import Store
from fadeline.plans.views import arrivals, links, observations
from fadeline.session import new_path
from fadeline.sources.formats import load_format
from fadeline.streaming import ingest as watch
from fadeline.streaming import rollup as stream_rollups
from fadeline.operators.series import write_periods

AS_OF = "2026-02-01 00:00:00"
HEADER = "time,cml_id,sublink_id,tsl,rsl\n"
LINK_HEADER = "cml_id,sublink_id,site_0_lon,site_0_lat,site_1_lon,site_1_lat,frequency,polarization,length\n"


@pytest.fixture
def store(spark):
    return Store(spark, new_path(spark, "store"))


def stamped(df):
    return df.withColumn("time", F.col("time").cast("timestamp"))


def keep(df, *columns):
    picked = df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "time" else c for c in columns])
    return rows(picked)


def test_first_wins_is_idempotent(spark, store, sf_dir):
    batch = stamped(arrivals(spark, sf_dir))
    store.append_first_wins(batch)
    once = rows(store.observations())
    store.append_first_wins(batch)
    assert rows(store.observations()) == once
    assert len(once) == observations(spark, sf_dir).count()
    for name in ("observations",):
        assert store.key_problems()[name].isEmpty()


def test_first_wins_over_arrivals_gives_observations(spark, sf_dir):
    kept = upsert.first_wins(arrivals(spark, sf_dir))
    assert rows(kept, "time", "cml_id", "sublink_id", "user_id", "rsl", "tsl") == rows(
        observations(spark, sf_dir), "time", "cml_id", "sublink_id", "user_id", "rsl", "tsl"
    )


def test_partials_equal_one_pass(spark, sf_dir):
    obs = observations(spark, sf_dir)
    whole = stats.lifetime_stats(obs)
    merged = stats.merge_partials(stats.daily_partials(obs)).drop("last_time")
    assert rows(whole) == rows(merged.select(whole.columns))


def test_hot_key_and_ties(spark):
    """One link with most rows, a repeated time, and a null as the last value."""
    data = spark.range(3000).select(
        (F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") / 2).cast("int"))).alias("time"),
        F.when(F.col("id") < 2900, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("cml_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sublink_id"),
        F.when(F.col("id") != 2899, -F.col("id").cast("double")).alias("rsl"),
        F.lit("t").alias("user_id"),
    )
    got = stats.lifetime_stats(data).where("cml_id = 'hot'").first()
    pdf = data.where("cml_id = 'hot'").toPandas()
    assert (got["total_records"], got["valid_records"], got["null_records"]) == (2900, 2899, 1)
    assert got["mean_rsl"] == pytest.approx(round(pdf.rsl.mean(), 2))
    assert got["stddev_rsl"] == pytest.approx(round(pdf.rsl.std(), 2))
    assert got["last_rsl"] is None


def test_stddev_of_one_value_is_null(spark):
    data = spark.sql("SELECT timestamp_ntz'2026-01-01' AS time, 'c' AS cml_id, 's' AS sublink_id, -1.0D AS rsl, 't' AS user_id")
    got = stats.lifetime_stats(data).first()
    assert (got["mean_rsl"], got["stddev_rsl"]) == (-1.0, None)


def test_full_rollup_equals_refreshes(spark, store, sf_dir):
    """Refreshing hour by hour over all days gives the rollup of all rows."""
    store.load_unique(stamped(observations(spark, sf_dir).where("time < timestamp_ntz'2024-01-06'")), mode="overwrite")
    for day in range(2, 9):
        store.refresh_rollup(f"2024-01-{day:02d} 01:00:00")
    stepwise = rows(store.rollup())
    store.refresh_full_rollup()
    assert stepwise == rows(store.rollup())
    assert store.key_problems()["rollup_1h"].isEmpty()


def test_refresh_leaves_old_buckets_alone(spark, store, sf_dir):
    obs = stamped(observations(spark, sf_dir).where("time < timestamp_ntz'2024-01-06'"))
    store.load_unique(obs.where("tsl < 50"), mode="overwrite")
    store.refresh_full_rollup()
    before = store.rollup().where("bucket < timestamp'2024-01-04'")
    old = rows(before)
    store.append_first_wins(obs.withColumn("seq", F.lit(0)))
    store.refresh_rollup("2024-01-06 00:00:00")
    assert rows(store.rollup().where("bucket < timestamp'2024-01-04'")) == old
    start, end = rollup.refresh_window("2024-01-06 00:00:00")
    inside = rollup.hourly_rollup(store.observations().where(F.col("time").between(F.lit(start), F.lit(end))))
    assert store.rollup().where("bucket >= timestamp'2024-01-04'").count() >= inside.where(F.col("bucket") < F.lit(end)).count()


def test_duplicate_key_in_bulk_load(spark, store, sf_dir):
    with pytest.raises(ValueError, match="duplicate key"):
        store.load_unique(stamped(arrivals(spark, sf_dir)))
    assert store.observations().isEmpty()
    store.load_unique(stamped(observations(spark, sf_dir)))
    with pytest.raises(ValueError, match="duplicate key"):
        store.load_unique(stamped(observations(spark, sf_dir)))


def test_links_upsert_and_insert(spark, store, sf_dir):
    base = links(spark, sf_dir).withColumn("length", F.lit(1.0))
    store.insert_links(base)
    changed = base.where("user_id = 'tenant_a'").withColumns({"frequency": F.lit(99.0), "seq": F.lit(1)})
    store.upsert_links(changed)
    store.insert_links(base.withColumn("frequency", F.lit(1.0)))
    got = {(r[0], r[1]) for r in store.links().select("user_id", "frequency").distinct().collect()}
    assert {f for u, f in got if u == "tenant_a"} == {99.0}
    assert 1.0 not in {f for _, f in got}
    assert store.links().count() == base.count()


def test_windowed_stats_leave_lifetime_columns(spark, store, sf_dir):
    store.load_unique(stamped(observations(spark, sf_dir)))
    store.insert_links(links(spark, sf_dir).withColumn("length", F.lit(1.0)))
    store.refresh_all_stats(AS_OF)
    lifetime = rows(store.link_stats(), "user_id", "cml_id", "total_records", "mean_rsl")
    store.refresh_windowed_stats("2024-01-31 00:00:00")
    after = store.link_stats()
    assert rows(after.where("total_records IS NOT NULL"), "user_id", "cml_id", "total_records", "mean_rsl") == lifetime
    direct = stats.windowed_stats(store.observations(), store.links(), "2024-01-31 00:00:00")
    known = after.join(store.links().select("user_id", "cml_id").distinct(), ["user_id", "cml_id"], "left_semi")
    columns = ["user_id", "cml_id", "total_records_6h", "valid_records_6h", "mean_rsl_6h", "stddev_rsl_1h", "last_rsl"]
    assert rows(known, *columns) == rows(direct.withColumn("last_rsl", F.col("last_rsl").cast("double")), *columns)


def put(folder, **files):
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def verdicts(store):
    return {r["filename"]: (r["status"], r["rows_written"], r["error_message"]) for r in store.file_log().collect()}


FIELD_MAP = {
    f"op_{level}": {"time": "timestamp", "cml_id": "link_id", "sublink_id": "sublink_id", level: "value"} for level in ("rsl", "tsl")
}


def test_folder_from_files_to_tables(spark, store, tmp_path):
    put(
        tmp_path,
        cml_metadata__csv=LINK_HEADER + "0010,a,13.4,52.5,13.5,52.6,18.0,H,2.1\n0010,a,13.4,52.5,13.5,52.6,19.0,H,2.1\n",
        meta_bad__csv=LINK_HEADER + "9,a,190,52.5,13.5,52.6,18.0,H,2.1\n",
        a_data__csv=HEADER + "2026-01-20 09:00:00,0010,a,1,-40\n2026-01-20 09:00:00,0010,a,1,-99\n2026-01-20 10:00:00,0010,a,1,\n",
        b_data__csv="rsl,tsl,sublink_id,cml_id,time\n-77,7,a,0010,2026-01-20 09:00:00\n-42,2,a,0010,2026-01-21 09:00:00\n",
        bad_time_data__csv=HEADER + "2026-01-20 09:00:00,0011,a,1,-40\nyesterday,0011,a,1,-40\n",
        no_sublink_data__csv=HEADER + "2026-01-20 09:00:00,0012,nan,1,-40\n",
        no_time_data__csv="cml_id,sublink_id,tsl,rsl\n1,a,1,-1\n",
        empty_data__csv=b"",
        header_only_data__csv=HEADER,
        notes__csv="hello\n",
        ignored__txt="x",
        op_rsl_20260101__json=json.dumps([{"timestamp": "2026-01-22T00:00:00Z", "link_id": "0010", "sublink_id": "a", "value": -45.0}]),
        op_tsl_20260101__json=json.dumps([{"timestamp": "2026-01-22T00:00:00Z", "link_id": "0010", "sublink_id": "a", "value": 3.0}]),
        other__json="[]",
        op_rsl_zero__json=b"",
    )
    job = ingest.Job(store, load_format("demo_csv_data"), "me", FIELD_MAP)
    ingest.ingest_folder(spark, job, str(tmp_path), AS_OF)
    log = verdicts(store)
    assert log["cml_metadata.csv"] == ("archived", 2, None)
    assert log["meta_bad.csv"][0] == "quarantined" and "site_0_lon" in log["meta_bad.csv"][2]
    assert log["a_data.csv"] == ("archived", 3, None)
    assert log["b_data.csv"] == ("archived", 2, None)
    assert log["bad_time_data.csv"] == ("quarantined", None, "time is null")
    assert log["no_sublink_data.csv"] == ("quarantined", None, "sublink_id is null")
    assert log["no_time_data.csv"] == ("quarantined", None, "column 'time' not found")
    assert log["empty_data.csv"] == log["header_only_data.csv"] == ("quarantined", None, "Empty file")
    assert log["notes.csv"] == ("quarantined", None, "Unsupported file type: notes.csv")
    assert log["op_rsl_20260101.json"] == log["op_tsl_20260101.json"] == ("archived", 1, None)
    assert log["other.json"][0] == "quarantined"
    assert log["op_rsl_zero.json"][0] == "quarantined"
    assert "ignored.txt" not in log and len(log) == 14
    assert keep(store.observations(), "time", "cml_id", "sublink_id", "rsl", "tsl", "user_id") == sorted(
        [
            (datetime(2026, 1, 20, 9), "0010", "a", -40.0, 1.0, "me"),
            (datetime(2026, 1, 20, 10), "0010", "a", None, 1.0, "me"),
            (datetime(2026, 1, 21, 9), "0010", "a", -42.0, 2.0, "me"),
            (datetime(2026, 1, 22), "0010", "a", -45.0, 3.0, "me"),
        ],
        key=repr,
    )
    assert rows(store.links(), "cml_id", "frequency") == [("0010", 19.0)]
    assert rows(store.link_stats(), "cml_id", "total_records", "valid_records", "last_rsl") == [("0010", 4, 3, -45.0)]
    quarantined = spark.read.parquet(store.path("quarantine"))
    assert rows(quarantined.where("filename = 'bad_time_data.csv'"), "line") == sorted(
        [(x,) for x in (HEADER.strip(), "2026-01-20 09:00:00,0011,a,1,-40", "yesterday,0011,a,1,-40")], key=repr
    )
    archived = spark.read.text(store.path("archive")).where("filename = 'b_data.csv'")
    assert rows(archived, "value") == sorted([("rsl,tsl,sublink_id,cml_id,time",), ("-77,7,a,0010,2026-01-20 09:00:00",), ("-42,2,a,0010,2026-01-21 09:00:00",)], key=repr)
    # nothing is new: a second run changes nothing
    state = rows(store.observations()), rows(store.file_log()), quarantined.count()
    ingest.ingest_folder(spark, job, str(tmp_path), AS_OF)
    assert (rows(store.observations()), rows(store.file_log()), spark.read.parquet(store.path("quarantine")).count()) == state


def test_row_policy_drop(spark, store, tmp_path):
    put(tmp_path, a_data__csv=HEADER + "2026-01-20 09:00:00,1,a,1,-40\nbad,1,a,1,-40\n", b_data__csv=HEADER + "bad,1,a,1,-40\n")
    ingest.ingest_folder(spark, ingest.Job(store, load_format("demo_csv_data"), "me", row_policy="drop"), str(tmp_path), AS_OF)
    assert verdicts(store) == {"a_data.csv": ("archived", 1, None), "b_data.csv": ("quarantined", None, "time is null")}
    assert store.observations().count() == 1
    with pytest.raises(ValueError):
        ingest.Job(store, load_format("demo_csv_data"), "me", row_policy="maybe")


def test_changed_file_is_new(spark, store, tmp_path):
    put(tmp_path, a_data__csv=HEADER + "2026-01-20 09:00:00,1,a,1,-40\n")
    job = ingest.Job(store, load_format("demo_csv_data"), "me")
    ingest.ingest_folder(spark, job, str(tmp_path), AS_OF)
    time.sleep(1.1)
    put(tmp_path, a_data__csv=HEADER + "2026-01-20 09:00:00,1,a,1,-41\n2026-01-20 10:00:00,1,a,1,-42\n")
    ingest.ingest_folder(spark, job, str(tmp_path), AS_OF)
    assert rows(store.observations(), "rsl") == [(-40.0,), (-42.0,)]
    assert store.file_log().count() == 2


def test_file_name_with_odd_characters(spark, store, tmp_path):
    put(tmp_path, **{"a data + b #1%__csv": HEADER + "2026-01-20 09:00:00,1,a,1,-40\n"})
    job = ingest.Job(store, load_format("demo_csv_data"), "me")
    for _ in range(2):
        ingest.ingest_folder(spark, job, str(tmp_path), AS_OF)
    assert verdicts(store) == {"a data + b #1%.csv": ("archived", 1, None)}


def test_stream_equals_batch(spark, store, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    for i in range(5):
        put(incoming, **{f"f{i}_data__csv": HEADER + "".join(f"2026-01-{20 + i} 0{h}:00:00,{h},a,{i},-{i}\n" for h in range(3))})
    put(incoming, meta__csv=LINK_HEADER + "1,a,13.4,52.5,13.5,52.6,18.0,H,2.1\n", bad_data__csv=HEADER + "x,1,a,1,1\n", zero_data__csv=b"")
    put(incoming, op_rsl_1__json=json.dumps([{"timestamp": "2026-01-22T00:00:00Z", "link_id": "1", "sublink_id": "a", "value": -45.0}]))
    batch_store = Store(spark, new_path(spark, "store"))
    ingest.ingest_folder(spark, ingest.Job(batch_store, load_format("demo_csv_data"), "me", FIELD_MAP), str(incoming), AS_OF)
    job = ingest.Job(store, load_format("demo_csv_data"), "me", FIELD_MAP)
    checkpoint = new_path(spark, "checkpoint")
    watch.watch_delimited(spark, job, str(incoming), checkpoint, as_of=AS_OF, files_per_batch=3).awaitTermination()
    watch.watch_json(spark, job, str(incoming), new_path(spark, "checkpoint"), as_of=AS_OF).awaitTermination()
    watch.log_empty_files(spark, job, str(incoming), AS_OF)
    assert rows(store.observations()) == rows(batch_store.observations())
    assert rows(store.links()) == rows(batch_store.links())
    assert verdicts(store) == verdicts(batch_store)
    assert rows(store.link_stats()) == rows(batch_store.link_stats())
    # new files only: the checkpoint knows the others
    put(incoming, g_data__csv=HEADER + "2026-01-30 00:00:00,1,a,1,-1\n")
    watch.watch_delimited(spark, job, str(incoming), checkpoint, as_of=AS_OF).awaitTermination()
    assert store.observations().where("date = date'2026-01-30'").count() == 1
    watch.refresh_statistics(job, "2026-01-30 01:00:00")
    assert rows(store.link_stats().where("cml_id = '1'"), "total_records_6h", "last_rsl") == [(1, -1.0)]


def test_lost_stream_batch_is_run_again(spark, store, tmp_path, monkeypatch, caplog):
    put(tmp_path, a_data__csv=HEADER + "2026-01-20 09:00:00,1,a,1,-40\n", bad_data__csv=HEADER + "x,1,a,1,-40\n")
    job = ingest.Job(store, load_format("demo_csv_data"), "me", warn_missing=True)
    checkpoint = new_path(spark, "checkpoint")
    real = ingest._quarantine

    def fail(*_args):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "_quarantine", fail)
    with pytest.raises(Exception, match="lost"):
        watch.watch_delimited(spark, job, str(tmp_path), checkpoint, as_of=AS_OF).awaitTermination()
    assert store.file_log().isEmpty()
    monkeypatch.setattr(ingest, "_quarantine", real)
    watch.watch_delimited(spark, job, str(tmp_path), checkpoint, as_of=AS_OF).awaitTermination()
    assert verdicts(store) == {"a_data.csv": ("archived", 1, None), "bad_data.csv": ("quarantined", None, "time is null")}
    assert store.observations().count() == 1
    assert spark.read.parquet(store.path("quarantine")).count() == 2
    assert spark.read.text(store.path("archive")).count() == 2
    assert "Missing metadata for" in caplog.text


def test_stream_rollup_replays_batches_once(spark, sf_dir):
    root = new_path(spark, "stream")
    obs = stamped(observations(spark, sf_dir)).drop("seq")
    obs.where("tsl < 50").write.parquet(f"{root}/in/part=1")
    schema = obs.schema

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        stream_rollups.start_rollup(stream, f"{root}/rollup", f"{root}/checkpoint").awaitTermination()

    run()
    obs.where("tsl >= 50").write.parquet(f"{root}/in/part=2")
    run()
    run()
    got = stream_rollups.read_rollup(spark, f"{root}/rollup").withColumn("rsl_avg", F.round("rsl_avg", 6))
    want = rollup.hourly_rollup(obs).withColumn("rsl_avg", F.round("rsl_avg", 6))
    columns = ["bucket", "user_id", "cml_id", "sublink_id", "rsl_min", "rsl_max", "rsl_avg", "tsl_max"]
    assert rows(got, *columns) == rows(want, *columns)


@pytest.mark.parametrize("when", ["before", "after"])
def test_stream_rollup_batch_run_again(spark, sf_dir, monkeypatch, when):
    """A batch that fails before its rows count, or after, adds nothing twice."""
    root = new_path(spark, "stream")
    obs = stamped(observations(spark, sf_dir)).drop("seq")
    obs.write.parquet(f"{root}/in")
    real = versions.publish

    def lost(*args, **kwargs):
        if when == "after":
            real(*args, **kwargs)
        raise RuntimeError("lost")

    def start():
        stream = spark.readStream.schema(obs.schema).parquet(f"{root}/in")
        stream_rollups.start_rollup(stream, f"{root}/rollup", f"{root}/checkpoint").awaitTermination()

    monkeypatch.setattr(versions, "publish", lost)
    with pytest.raises(Exception, match="lost"):
        start()
    assert stream_rollups.read_rollup(spark, f"{root}/rollup").isEmpty() == (when == "before")
    monkeypatch.setattr(versions, "publish", real)
    start()
    got = stream_rollups.read_rollup(spark, f"{root}/rollup").withColumn("rsl_avg", F.round("rsl_avg", 6))
    want = rollup.hourly_rollup(obs).withColumn("rsl_avg", F.round("rsl_avg", 6))
    columns = ["bucket", "user_id", "cml_id", "sublink_id", "rsl_min", "rsl_avg", "tsl_max"]
    assert rows(got, *columns) == rows(want, *columns)


def test_stream_batch_opens_the_days_it_touches(spark, monkeypatch):
    root = new_path(spark, "stream")
    make = lambda *days: spark.createDataFrame([(f"2026-01-{d:02d} 10:00:00", "a", "s", "t", -1.0, 2.0) for d in days], "time string, cml_id string, sublink_id string, user_id string, rsl double, tsl double").withColumn("time", F.col("time").cast("timestamp"))
    opened, real = [], versions.read_folders
    monkeypatch.setattr(versions, "read_folders", lambda spark, path, folders, schema=None: opened.append([f.partition for f in folders]) or real(spark, path, folders, schema))
    make(*range(1, 21)).write.parquet(f"{root}/in/part=1")
    schema = spark.read.parquet(f"{root}/in/part=1").schema

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        stream_rollups.start_rollup(stream, f"{root}/rollup", f"{root}/checkpoint").awaitTermination()

    run()
    make(3).write.parquet(f"{root}/in/part=2")
    run()
    assert opened == [[], ["date=2026-01-03"]]


def test_series_from_rollup_or_raw(spark, store, sf_dir):
    """The published hours end at as_of - 1 h; the rest is computed on the way."""
    store.load_unique(stamped(observations(spark, sf_dir)), mode="overwrite")
    store.refresh_full_rollup()
    for day in range(3, 21):
        store.refresh_rollup(f"2024-01-{day:02d} 12:30:00")
    long = store.series("2024-01-10", "2024-01-20 12:30:00")
    direct = rollup.hourly_rollup(store.observations().where("time < timestamp'2024-01-20 13:00:00'")).where("bucket >= timestamp'2024-01-10'")
    assert rows(long, *direct.columns) == rows(direct)
    short = store.series("2024-01-19", "2024-01-20")
    assert "rsl" in short.columns and short.count() == store.observations().where("time BETWEEN timestamp'2024-01-19' AND timestamp'2024-01-20'").count()


def test_windowed_stream_rollup(spark, sf_dir):
    root = new_path(spark, "stream")
    obs = stamped(observations(spark, sf_dir)).drop("seq")
    obs.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(obs.schema).parquet(f"{root}/in")
    query = stream_rollups.windowed_rollup(stream, "40 days").writeStream.outputMode("update").format("memory").queryName("rolled")
    query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("rolled").count() == rollup.hourly_rollup(obs).count()


def test_split_into_period_files(spark, sf_dir, tmp_path):
    obs = observations(spark, sf_dir).select("time", "cml_id", "sublink_id", "tsl", "rsl")
    write_periods(obs, str(tmp_path / "out"), "1 day")
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders[0] == "period_file=cml_data_20240101_000000.csv" and len(folders) == 30
    back = spark.read.option("header", True).schema("time timestamp_ntz, cml_id string, sublink_id string, tsl double, rsl double").csv(str(tmp_path / "out"))
    assert rows(back, "time", "cml_id", "rsl") == rows(obs, "time", "cml_id", "rsl")
    write_periods(obs.where("time >= timestamp_ntz'2024-01-20 00:00:00'"), str(tmp_path / "out"), "1 day")  # a rerun
    again = spark.read.option("header", True).schema(back.schema).csv(str(tmp_path / "out"))
    assert rows(again, "time", "cml_id", "rsl") == rows(obs, "time", "cml_id", "rsl")


def test_compaction_keeps_rows(spark, sf_dir):
    path = new_path(spark, "table")
    obs = observations(spark, sf_dir).drop("seq")
    for part in range(3):
        layout.write_observations(obs.where(F.col("tsl") % 3 == part), path)
    before = rows(versions.read(spark, path))
    files = len(versions.read(spark, path).inputFiles())
    layout.compact(spark, path, "2024-01-31")
    assert rows(versions.read(spark, path)) == before
    assert len(versions.read(spark, path).inputFiles()) < files

    def listing():
        return set(versions.read(spark, path).inputFiles())

    first = listing()
    layout.compact(spark, path, "2024-01-31")
    assert listing() == first
    late = obs.limit(1).withColumns({"time": F.lit("2024-01-03 12:00:00").cast("timestamp_ntz"), "user_id": F.lit("tenant_a")})
    layout.write_observations(late, path)
    layout.compact(spark, path, "2024-01-31")
    changed = {f for f in first ^ listing()}
    assert changed and all("user_id=tenant_a/date=2024-01-03/" in f for f in changed)


def test_clean_source_archives_read_files(spark, store, tmp_path):
    incoming, done = tmp_path / "in", tmp_path / "done"
    incoming.mkdir()
    job = ingest.Job(store, load_format("demo_csv_data"), "me")
    checkpoint = new_path(spark, "checkpoint")
    for i in range(2):
        put(incoming, **{f"f{i}_data__csv": HEADER + f"2026-01-20 0{i}:00:00,1,a,1,-40\n"})
        watch.watch_delimited(spark, job, str(incoming), checkpoint, as_of=AS_OF, clean="archive", archive_dir=str(done)).awaitTermination()
    assert store.observations().count() == 2


def test_archive_load(spark, store, tmp_path):
    put(
        tmp_path,
        data__csv=HEADER + "2026-01-20 09:00:00.5,1,a,2.0,-40\n2026-01-20 09:00:10,1,a,,\n",
        metadata__csv="cml_id,sublink_id,site_0_lon,site_0_lat,site_1_lon,site_1_lat,frequency,length,polarization\n1,a,1,2,3,4,18.0,500.0,H\n",
    )
    summary = ingest.load_archive(spark, store, f"{tmp_path}/data.csv", f"{tmp_path}/metadata.csv", "me", AS_OF)
    assert rows(summary, "total_rows") == [(2,)]
    assert rows(store.links(), "length", "polarization", "user_id") == [(500.0, "H", "me")]
    assert rows(store.link_stats(), "total_records", "valid_records") == [(2, 1)]
    assert rows(store.rollup(), "rsl_avg", "tsl_max") == [(-40.0, 2.0)]


def test_files_of_one_name_from_two_tenants(spark, store, tmp_path):
    for tenant in ("east", "west"):
        folder = tmp_path / tenant
        folder.mkdir()
        (folder / "cml_data_1.csv").write_text(HEADER + f"2026-01-31 10:00:00,{tenant},s,1,-1\n")
        (folder / "bad_data.csv").write_text(HEADER + f"never,{tenant},s,1,-1\n")
        job = ingest.Job(store, load_format("demo_csv_data"), tenant)
        for _ in range(2):
            ingest.ingest_folder(spark, job, str(folder), AS_OF)
    archived = spark.read.text(store.path("archive")).where("value NOT LIKE 'time%'")
    assert rows(archived, "user_id", "value") == [(t, f"2026-01-31 10:00:00,{t},s,1,-1") for t in ("east", "west")]
    quarantined = spark.read.parquet(store.path("quarantine")).where("line NOT LIKE 'time%'")
    assert rows(quarantined, "user_id", "line") == [(t, f"never,{t},s,1,-1") for t in ("east", "west")]
    assert store.file_log().count() == 4


def test_a_log_that_fails_stops_nothing(spark, store, tmp_path, monkeypatch, caplog):
    (tmp_path / "cml_data_1.csv").write_text(HEADER + "2026-01-31 10:00:00,a,s,1,-1\n")
    job = ingest.Job(store, load_format("demo_csv_data"), "east")

    def fails(rows):
        raise RuntimeError("no log")

    monkeypatch.setattr(store, "append_log", fails)
    ingest.ingest_folder(spark, job, str(tmp_path), AS_OF)
    assert store.observations().count() == 1 and "file log could not be written" in caplog.text
    monkeypatch.undo()
    ingest.ingest_folder(spark, job, str(tmp_path), AS_OF)
    assert store.observations().count() == 1 and store.file_log().count() == 1


def test_refreshes_of_an_empty_store(spark, store):
    store.refresh_windowed_stats(AS_OF)
    store.refresh_rollup(AS_OF)
    assert store.rollup().count() == 0 == store.link_stats().count()
    assert store.series("2026-01-01", "2026-02-01").count() == 0 == store.series("2026-01-31", "2026-02-01").count()


def test_series_over_a_stale_rollup(spark, store, sf_dir):
    store.load_unique(stamped(observations(spark, sf_dir)).where("time < timestamp'2024-01-06'"), mode="overwrite")
    store.refresh_full_rollup()
    store.load_unique(stamped(observations(spark, sf_dir)).where("time >= timestamp'2024-01-06'"))
    got = store.series("2024-01-02", "2024-01-11")
    direct = rollup.hourly_rollup(store.observations().where("time < timestamp'2024-01-11 01:00:00'")).where("bucket >= timestamp'2024-01-02'")
    assert rows(got, *direct.columns) == rows(direct)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in plan


def test_stream_with_another_checkpoint_stops(spark, sf_dir):
    root = new_path(spark, "stream")
    obs = stamped(observations(spark, sf_dir)).drop("seq")
    obs.write.parquet(f"{root}/in")

    def start(checkpoint):
        stream = spark.readStream.schema(obs.schema).parquet(f"{root}/in")
        stream_rollups.start_rollup(stream, f"{root}/rollup", f"{root}/{checkpoint}").awaitTermination()

    start("one")
    once = rows(stream_rollups.read_rollup(spark, f"{root}/rollup"))
    with pytest.raises(Exception, match="another query"):
        start("two")
    start("one")
    assert rows(stream_rollups.read_rollup(spark, f"{root}/rollup")) == once


def test_stream_keeps_rows_however_late(spark):
    root = new_path(spark, "stream")
    make = lambda *r: spark.createDataFrame(r, "time string, cml_id string, sublink_id string, user_id string, rsl double, place long").withColumn("time", F.col("time").cast("timestamp"))
    make(("2026-01-31 10:00:00", "a", "s", "t", -1.0, 2), ("2026-01-31 10:00:00", "a", "s", "t", -2.0, 1)).write.parquet(f"{root}/in/part=1")
    schema = spark.read.parquet(f"{root}/in/part=1").schema

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        stream_rollups.start_first_wins(stream, f"{root}/table", f"{root}/checkpoint", "place").awaitTermination()

    run()
    make(("2020-01-01 00:00:00", "a", "s", "t", -3.0, 1), ("2026-01-31 10:00:00", "a", "s", "t", -4.0, 0)).write.parquet(f"{root}/in/part=2")
    run()
    run()
    assert rows(versions.read(spark, f"{root}/table"), "rsl") == [(-2.0,), (-3.0,)]


def test_statistics_after_replace_all_are_of_present_tenants(spark, store, sf_dir):
    store.load_unique(stamped(observations(spark, sf_dir)).withColumn("user_id", F.lit("older")), mode="overwrite")
    store.replace_links(links(spark, sf_dir).withColumns({"length": F.lit(1.0), "user_id": F.lit("older")}))
    store.refresh_all_stats(AS_OF)
    store.refresh_windowed_stats(AS_OF)
    store.load_unique(stamped(observations(spark, sf_dir)).withColumn("user_id", F.lit("newer")), mode="overwrite")
    store.replace_links(links(spark, sf_dir).withColumns({"length": F.lit(1.0), "user_id": F.lit("newer")}))
    store.refresh_all_stats(AS_OF)
    store.refresh_windowed_stats(AS_OF)
    assert rows(store.link_stats().select("user_id").distinct()) == [("newer",)]
