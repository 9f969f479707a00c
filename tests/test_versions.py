"""Writes that take effect as a whole, and what is folded from them."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fadeline.operators import layout, stats, versions
from fadeline.plans.store import Store
from fadeline.plans.views import arrivals, links, observations
from fadeline.session import new_path

AS_OF = "2024-01-31 00:00:00"
SCHEMA = "k int, v string, p string"


@pytest.fixture
def path(spark):
    return new_path(spark, "table")


@pytest.fixture
def store(spark):
    return Store(spark, new_path(spark, "store"))


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def stamped(df):
    return df.withColumn("time", F.col("time").cast("timestamp"))


def test_modes(spark, path):
    assert versions.read(spark, path, SCHEMA).count() == 0 and versions.current(spark, path).number == 0
    versions.write(frame(spark, (1, "a", "x"), (2, "b", "y")), path, ["p"], notes={"seen": "1"})
    versions.write(frame(spark, (3, "c", "x")), path, ["p"])
    assert rows(versions.read(spark, path, SCHEMA)) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "x")]
    versions.write(versions.read(spark, path, SCHEMA).where("p = 'x'").withColumn("v", F.lit("new")), path, ["p"], "replace")
    assert rows(versions.read(spark, path)) == [(1, "new", "x"), (2, "b", "y"), (3, "new", "x")]
    assert rows(versions.read(spark, path, SCHEMA, lambda values: values["p"] == "y")) == [(2, "b", "y")]
    versions.write(frame(spark, (9, "z", "w")), path, ["p"], "overwrite", notes={"more": "2"})
    found = versions.current(spark, path)
    assert (found.number, found.whole_since, found.notes) == (4, 4, {"seen": "1", "more": "2"})
    assert rows(versions.read(spark, path, SCHEMA)) == [(9, "z", "w")]
    versions.write(frame(spark), path, ["p"], "overwrite")
    assert versions.read(spark, path, SCHEMA).count() == 0


def test_odd_partition_values(spark, path):
    odd = [None, "", "a b", "a/b=c", "é%41", "*[x]{y}", "007", "2024-01-01"]
    data = [(i, "v", p) for i, p in enumerate(odd)]
    versions.write(frame(spark, *data), path, ["p"])
    stored = [(i, "v", p or None) for i, _, p in data]
    assert rows(versions.read(spark, path, SCHEMA)) == sorted(stored, key=repr)
    versions.write(frame(spark, *data[2:]), path, ["p"], "replace")
    assert rows(versions.read(spark, path, SCHEMA)) == sorted(stored, key=repr)


def test_without_partitions(spark, path):
    versions.write(frame(spark, (1, "a", "x")), path)
    versions.write(frame(spark, (2, "b", "y")), path)
    assert rows(versions.read(spark, path)) == [(1, "a", "x"), (2, "b", "y")]
    versions.write(versions.read(spark, path).where("k = 2"), path, mode="replace")
    assert rows(versions.read(spark, path)) == [(2, "b", "y")]


def test_a_write_that_dies_has_changed_nothing(spark, path, monkeypatch):
    versions.write(frame(spark, (1, "a", "x")), path, ["p"])
    real = versions.publish
    for mode in ("append", "replace", "overwrite"):
        monkeypatch.setattr(versions, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            versions.write(frame(spark, (2, mode, "x")), path, ["p"], mode)
        assert rows(versions.read(spark, path)) == [(1, "a", "x")]
    monkeypatch.setattr(versions, "publish", real)
    versions.write(frame(spark, (2, "again", "x")), path, ["p"], "replace")
    assert rows(versions.read(spark, path)) == [(2, "again", "x")]


def test_two_jobs_at_once(spark, path):
    versions.write(frame(spark, (1, "a", "x")), path, ["p"])
    base = versions.current(spark, path)
    mine = versions.prepare(frame(spark, (2, "mine", "x")), path, ["p"])
    versions.write(frame(spark, (3, "other", "x")), path, ["p"])
    with pytest.raises(versions.ConcurrentWrite):
        versions.publish(spark, path, mine, 1, "replace", base=base)
    assert rows(versions.read(spark, path)) == [(1, "a", "x"), (3, "other", "x")]
    versions.publish(spark, path, mine, 1, "append", base=base)  # an append goes on after the other
    assert [r[0] for r in rows(versions.read(spark, path))] == [1, 2, 3]


def test_readers_go_on_and_old_folders_go(spark, path):
    for i in range(5):
        versions.write(frame(spark, (i, "v", "x"), (i, "v", f"own{i}")), path, ["p"], "replace")
    begun = versions.read(spark, path)
    versions.write(frame(spark, (9, "v", "x")), path, ["p"], "replace")
    assert begun.where("p = 'x'").first()["k"] == 4
    before = rows(versions.read(spark, path))
    unpublished = versions.prepare(frame(spark, (7, "v", "x")), path, ["p"])
    versions.expire(spark, path, keep=1)  # all parts are young
    assert len(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/parts").select("path").collect()) >= 12
    versions.expire(spark, path, keep=1, hours=0)
    assert rows(versions.read(spark, path)) == before and versions.current(spark, path).number == 6
    left = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/parts").select("path").collect()
    assert len(left) == 6 and not any(unpublished in r.path for r in left)


def test_a_refused_bulk_load_leaves_no_rows(spark, store, sf_dir):
    obs = stamped(observations(spark, sf_dir))
    store.load_unique(obs.where("tsl < 50"))
    once = rows(store.observations())
    with pytest.raises(ValueError, match="duplicate"):
        store.load_unique(obs.where("tsl >= 40"))
    assert rows(store.observations()) == once


def _input_files(monkeypatch):
    opened, real = [], versions.read_folders
    monkeypatch.setattr(versions, "read_folders", lambda spark, path, folders, schema=None: opened.append((path, [f.path for f in folders])) or real(spark, path, folders, schema))
    return opened


def _partials(df):
    """As a single pass gives them, within rounding."""
    shown = df.withColumns({"sum_rsl": F.round("sum_rsl", 6), "m2": F.round(F.coalesce("m2", F.lit(0.0)), 3), "date": F.col("date").cast("string")})
    return rows(shown, "user_id", "cml_id", "sublink_id", "date", "n", "n_valid", "sum_rsl", "m2", "min_rsl", "max_rsl", "last_time", "last_rsl")


def test_batches_are_folded_into_partials(spark, store, sf_dir, monkeypatch):
    """Two batches give what one pass gives, and a refresh opens the new folders only."""
    obs = stamped(observations(spark, sf_dir))
    one_pass = lambda: _partials(stats.partials(store.observations(), ["date"]))
    store.append_first_wins(obs.where("tsl < 50"))
    store.refresh_daily_stats()
    assert _partials(store.daily_stats()) == one_pass()
    first = {f.path for f in versions.current(spark, store.path("observations")).folders}
    store.append_first_wins(obs.where("tsl >= 50"))
    opened = _input_files(monkeypatch)
    store.refresh_daily_stats()
    read = [set(folders) for path, folders in opened if path == store.path("observations")]
    assert any(read) and not any(folders & first for folders in read)
    opened.clear()
    assert _partials(store.daily_stats()) == one_pass()
    number = versions.current(spark, store.path("daily_stats")).number
    opened.clear()
    store.refresh_daily_stats()  # nothing came since
    assert not opened and versions.current(spark, store.path("daily_stats")).number == number


def test_a_refresh_that_died_counts_nothing_twice(spark, store, sf_dir, monkeypatch):
    obs, real = stamped(observations(spark, sf_dir)), versions.publish
    store.append_first_wins(obs.where("tsl < 50"))
    store.refresh_daily_stats()
    store.append_first_wins(obs.where("tsl >= 50"))
    for when in ("before", "after"):
        monkeypatch.setattr(versions, "publish", lambda *a, **k: ((real(*a, **k) if when == "after" else None), (_ for _ in ()).throw(RuntimeError("lost")))[1])
        with pytest.raises(RuntimeError, match="lost"):
            store.refresh_daily_stats()
    monkeypatch.setattr(versions, "publish", real)
    store.refresh_daily_stats()
    assert _partials(store.daily_stats()) == _partials(stats.partials(store.observations(), ["date"]))


def test_rewritten_days_are_counted_anew(spark, store, sf_dir):
    rows_ = stamped(arrivals(spark, sf_dir))
    later = F.col("seq") >= 1_000_000_000_000
    one_pass = lambda: _partials(stats.partials(store.observations(), ["date"]))
    store.append_first_wins(rows_.where(~later))
    store.refresh_daily_stats()
    store.fill_nulls(rows_.where(later))
    store.refresh_daily_stats()
    assert _partials(store.daily_stats()) == one_pass()
    # a compaction changes no rows: nothing is read again; appended rows that it took in are
    store.append_first_wins(rows_.limit(20).withColumns({"cml_id": F.lit("late"), "seq": F.monotonically_increasing_id()}))
    layout.compact(spark, store.path("observations"), "2024-02-20")
    store.refresh_daily_stats()
    assert _partials(store.daily_stats()) == one_pass()
    layout.compact(spark, store.path("observations"), "2024-03-20")
    number = versions.current(spark, store.path("daily_stats")).number
    store.refresh_daily_stats()
    assert versions.current(spark, store.path("daily_stats")).number == number


def test_replacing_all_rows_starts_anew(spark, store, sf_dir):
    obs = stamped(observations(spark, sf_dir))
    store.load_unique(obs.withColumn("user_id", F.lit("older")))
    store.refresh_daily_stats()
    store.refresh_panes()
    store.load_unique(obs.withColumn("user_id", F.lit("newer")), mode="overwrite")
    store.refresh_daily_stats()
    store.refresh_panes()
    assert rows(store.daily_stats().select("user_id").distinct()) == [("newer",)]
    assert _partials(store.daily_stats()) == _partials(stats.partials(store.observations(), ["date"]))


@pytest.mark.parametrize("as_of", ["2024-01-30 23:17:00", "2024-01-20 06:00:00", "2030-01-01 00:00:00"])
def test_windows_from_panes(spark, store, sf_dir, as_of, monkeypatch):
    obs, known = stamped(observations(spark, sf_dir)), links(spark, sf_dir)
    store.load_unique(obs)
    store.refresh_panes()
    store.refresh_daily_stats()
    store.replace_links(known.withColumn("length", F.lit(1.0)))
    opened = _input_files(monkeypatch)
    store.refresh_windowed_stats(as_of)
    assert not [folders for path, folders in opened if path == store.path("observations") and folders]
    stored = obs.withColumns({c: F.col(c).cast("float") for c in ("rsl", "tsl")})
    want = stats.windowed_stats(stored, known, as_of)
    columns = ["user_id", "cml_id", "total_records_6h", "valid_records_6h", "completeness_percent_6h", "mean_rsl_6h", "stddev_rsl_6h", "mean_rsl_1h", "stddev_rsl_1h", "last_rsl"]
    assert rows(store.link_stats(), *columns) == rows(want, *columns)


def test_panes_need_whole_minutes(spark, store, sf_dir):
    store.load_unique(stamped(observations(spark, sf_dir)))
    store.replace_links(links(spark, sf_dir).withColumn("length", F.lit(1.0)))
    store.refresh_daily_stats()
    store.refresh_windowed_stats("2024-01-30 23:17:31")  # from raw rows
    assert store.link_stats().count() == links(spark, sf_dir).select("user_id", "cml_id").distinct().count()
    with pytest.raises(ValueError, match="whole minutes"):
        stats.windowed_from_panes(stats.panes(store.observations()), store.links(), "2024-01-30 23:17:31")


def test_expire_of_a_store(spark, store, sf_dir):
    obs = stamped(observations(spark, sf_dir))
    for part in range(3):
        store.append_first_wins(obs.where(F.col("tsl") % 3 == part))
        store.refresh_daily_stats()
    once = rows(store.observations()), _partials(store.daily_stats())
    store.expire(keep=1, hours=0)
    assert (rows(store.observations()), _partials(store.daily_stats())) == once
