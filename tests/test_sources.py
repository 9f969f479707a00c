import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fadeline.operators import increments
from fadeline.sources import cube, delimited, json_records
from fadeline.sources.formats import Format, load_format, register_format, with_parsers
from fadeline.sources.inventory import file_listing, inventory
from fadeline.sources.names import file_kind, longest_prefix, stem, upload_refusal

RAW = ["time", "cml_id", "sublink_id", "tsl", "rsl"]


def write(folder, **files):
    for name, content in files.items():
        path = folder / name.replace("__", ".")
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def raw(spark, folder, fmt):
    found = delimited.read_raw(spark, str(folder), fmt)
    return rows(found.withColumn("time", F.col("time").cast("timestamp_ntz")), *RAW)


def generic(**config):
    return load_format("csv_generic", config)


def test_canonical_rows(spark, tmp_path):
    write(tmp_path, a__csv="time,cml_id,sublink_id,tsl,rsl\n2025-03-07 23:59:01.000250,hill-4,north,2.25,-61.5\nlate,,s,x,-0.30000000000000004\n")
    assert raw(spark, tmp_path, load_format("demo_csv_data")) == sorted(
        [
            (datetime(2025, 3, 7, 23, 59, 1, 250), "hill-4", "north", 2.25, -61.5),
            (None, "nan", "s", None, -0.30000000000000004),
        ],
        key=repr,
    )


def test_columns_are_bound_by_name_per_file(spark, tmp_path):
    write(
        tmp_path,
        a__csv="time,cml_id,sublink_id,tsl,rsl\n2026-01-01,1,a,1,-1\n",
        b__csv="rsl,tsl,sublink_id,cml_id,time,extra\n-2,2,b,2,2026-01-02,zzz\n",
        c__csv="sublink_id,rsl,cml_id,time,tsl\n\"x,y\",-3,3,2026-01-03,3\n",
    )
    assert raw(spark, tmp_path, load_format("demo_csv_data")) == sorted(
        [
            (datetime(2026, 1, 1), "1", "a", 1.0, -1.0),
            (datetime(2026, 1, 2), "2", "b", 2.0, -2.0),
            (datetime(2026, 1, 3), "3", "x,y", 3.0, -3.0),
        ],
        key=repr,
    )


def test_large_file_is_read_in_blocks(spark, tmp_path):
    lines = "\n".join(f"2026-01-01 00:00:00,{i},s,1,-{i}" for i in range(20000))
    write(tmp_path, big__csv="time,cml_id,sublink_id,tsl,rsl\n" + lines + "\n", small__csv="cml_id,time,sublink_id,tsl,rsl\nz,2026-01-01,s,1,-1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = delimited.read_raw(spark, str(tmp_path), load_format("demo_csv_data"))
        assert found.rdd.getNumPartitions() > 4
        assert found.count() == 20001
        assert found.where("time IS NULL OR rsl IS NULL").count() == 0
        assert found.select("cml_id").distinct().count() == 20001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rename_and_separator(spark, tmp_path):
    write(tmp_path, a__csv="when;which;part;out;in\n2025-06-30 07:15:00;mast 9;up;3.5;-72\n")
    names = {"when": "time", "which": "cml_id", "part": "sublink_id", "out": "tsl", "in": "rsl", "elsewhere": "x"}
    fmt = generic(read_csv_kwargs={"sep": ";"}, rawdata_columns=names)
    assert raw(spark, tmp_path, fmt) == [(datetime(2025, 6, 30, 7, 15), "mast 9", "up", 3.5, -72.0)]


def test_wrong_rename_gives_null_levels(spark, tmp_path):
    write(tmp_path, a__csv="time,cml_id,sublink_id,out,in\n2025-06-30,mast 9,up,3.5,-72\n")
    fmt = generic(rawdata_columns={"outwards": "tsl", "inwards": "rsl"})
    assert raw(spark, tmp_path, fmt) == [(datetime(2025, 6, 30), "mast 9", "up", None, None)]


def test_reader_options(spark, tmp_path):
    body = "made by a device\nsecond line\n# comment\ntime;cml_id;sublink_id;tsl;rsl\n2026-01-22;L\xe4;'a;b';1,5;missing # note\n\n"
    write(tmp_path, a__csv=body.encode("latin-1"))
    options = {"sep": ";", "decimal": ",", "skiprows": 2, "encoding": "ISO-8859-1", "quotechar": "'", "comment": "#", "na_values": ["missing"]}
    fmt = generic(read_csv_kwargs=options)
    assert raw(spark, tmp_path, fmt) == [(datetime(2026, 1, 22), "L\xe4", "a;b", 1.5, None)]


def test_unsupported_reader_option():
    with pytest.raises(ValueError, match="engine"):
        generic(read_csv_kwargs={"engine": "c"})


def test_second_operator(spark, tmp_path):
    write(tmp_path, raw__csv="timestamp;link_id;sublink;tx_power;rx_power\n2026-01-22 10:00:00+01:00;7;1;20;-50\n")
    assert raw(spark, tmp_path, load_format("other_mno_csv")) == [(datetime(2026, 1, 22, 9), "7", "1", 20.0, -50.0)]


def test_second_operator_without_levels(spark, tmp_path):
    write(tmp_path, raw__csv="timestamp;link_id;sublink\n2026-01-22 10:00:00+01:00;7;1\n")
    assert raw(spark, tmp_path, load_format("other_mno_csv")) == [(datetime(2026, 1, 22, 9), "7", "1", None, None)]


def test_missing_required_column_is_a_file_error(spark, tmp_path):
    write(tmp_path, a__csv="cml_id,sublink_id,tsl,rsl\n1,a,1,-1\n")
    found = delimited.read_raw(spark, str(tmp_path), load_format("demo_csv_data"))
    assert rows(found, "header_error") == [("column 'time' not found",)]


def test_metadata(spark, tmp_path):
    write(
        tmp_path,
        meta__csv="link_id;sublink;lon_a;lat_a;lon_b;lat_b;freq_mhz;pol;length_km\n10001;s1;13.4;52.5;x;52.6;18000;H;2.1\n",
    )
    found = delimited.read_metadata(spark, str(tmp_path), load_format("other_mno_csv"))
    columns = ["cml_id", "sublink_id", "site_0_lon", "site_0_lat", "site_1_lon", "site_1_lat", "frequency", "polarization", "length"]
    assert rows(found, *columns) == [("10001", "s1", 13.4, 52.5, None, 52.6, 18000.0, "H", 2.1)]


def test_unit_factors(spark, tmp_path):
    header = "cml_id,sublink_id,site_0_lon,site_0_lat,site_1_lon,site_1_lat,frequency,polarization,length\n"
    write(tmp_path, meta__csv=header + "1,a,1,2,3,4,18.0,V,2.5\n")
    fmt = generic(frequency_factor=1000.0, length_factor=1000.0)
    assert rows(delimited.read_metadata(spark, str(tmp_path), fmt), "frequency", "length") == [(18000.0, 2500.0)]


@pytest.mark.parametrize(
    "name, kind",
    [("cml_metadata_1.csv", "metadata"), ("RAW_1.CSV", "rawdata"), ("data_meta.csv", "metadata"), ("x_data.csv", "rawdata"), ("notes.csv", "unsupported"), ("meta.json", "rawdata")],
)
def test_file_kind(spark, name, kind):
    fmt = load_format("demo_csv_data")
    assert spark.range(1).select(file_kind(F.lit(name), fmt).alias("k")).first()["k"] == kind


def test_file_kind_configured(spark):
    fmt = generic(metadata_filename_keyword="LINKS")
    kinds = [spark.range(1).select(file_kind(F.lit(n), fmt).alias("k")).first()["k"] for n in ("my_links.csv", "meta.csv")]
    assert kinds == ["metadata", "rawdata"]
    fmt = generic(rawdata_filename_keyword="Level")
    kinds = [spark.range(1).select(file_kind(F.lit(n), fmt).alias("k")).first()["k"] for n in ("levels.csv", "data.csv", "meta.csv")]
    assert kinds == ["rawdata", "unsupported", "metadata"]


def test_registry():
    assert load_format("openmrg").name == load_format("orange_cameroun").name == "demo_csv_data"
    with pytest.raises(ValueError, match="Unknown parser_type"):
        load_format("nothing")
    register_format("mine", lambda config: Format("mine", sep=config["sep"]))
    assert load_format("mine", {"sep": "|"}).sep == "|"


def test_own_parser(spark, tmp_path):
    write(tmp_path, a__csv="time,cml_id,sublink_id,tsl,rsl\n1767225600,1,a,1,46\n")

    def parse(text_rows):
        return text_rows.withColumns({"time": F.timestamp_seconds(F.col("time").cast("bigint")), "rsl": -F.col("rsl").cast("double"), "tsl": F.col("tsl").cast("double")})

    fmt = with_parsers(load_format("demo_csv_data"), parse_raw=parse)
    assert raw(spark, tmp_path, fmt) == [(datetime(2026, 1, 1), "1", "a", 1.0, -46.0)]


FIELD_MAP = {
    "valley": {"time": "at", "cml_id": "pair", "sublink_id": "way", "rsl": "other"},
    "valley_rsl": {"time": "at", "cml_id": "pair", "sublink_id": "way", "rsl": "level"},
    "valley_tsl": {"time": "at", "cml_id": "pair", "sublink_id": "way", "tsl": "level"},
}


def record(**changes):
    return {"at": "2025-11-05T18:40:00Z", "pair": "ridge", "way": "b", "level": -58.75, **changes}


def json_rows(spark, folder):
    found = json_records.raw_rows(json_records.read_files(spark, str(folder)), FIELD_MAP)
    return found.withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_json_levels(spark, tmp_path):
    write(
        tmp_path,
        valley_rsl_evening__json=json.dumps([record(), record(at="2025-11-05T22:10:00+03:00", pair=31, level=None)]),
        valley_tsl_evening__json=json.dumps([record(level=4)]),
    )
    assert rows(json_rows(spark, tmp_path), *RAW) == sorted(
        [
            (datetime(2025, 11, 5, 18, 40), "ridge", "b", None, -58.75),
            (datetime(2025, 11, 5, 19, 10), "31", "b", None, None),
            (datetime(2025, 11, 5, 18, 40), "ridge", "b", 4.0, None),
        ],
        key=repr,
    )


def test_json_errors(spark, tmp_path):
    write(
        tmp_path,
        valley_rsl_empty__json="[]",
        valley_rsl_broken__json="{not json",
        valley_rsl_absent__json=json.dumps([{"at": "2025-11-05T18:40:00Z", "pair": "ridge", "way": "b"}]),
        valley_rsl_partly__json=json.dumps([record(), {"at": "2025-11-05T19:00:00Z", "pair": "ridge", "way": "b"}]),
        valley_rsl_each__json=json.dumps([{"at": "2025-11-05T18:40:00Z", "pair": "ridge", "level": 1}, {"at": "2025-11-05T19:00:00Z", "pair": "ridge", "way": "b"}]),
        valley_rsl_two__json=json.dumps([{"pair": "ridge", "way": "b"}, {"pair": "ridge", "way": "b", "other": 1}]),
        unknown__json=json.dumps([record()]),
    )
    found = json_rows(spark, tmp_path)
    assert found.where("filename LIKE '%empty%' AND line_no IS NOT NULL").count() == 0
    errors = dict(rows(found.where("header_error IS NOT NULL").distinct(), "filename", "header_error"))
    assert errors["valley_rsl_broken.json"] == "Invalid JSON"
    assert errors["unknown.json"].startswith("No field-map entry matches filename stem 'unknown'. Available prefixes: valley, ")
    absent = json_records.absent_fields(found)
    assert [(p.rsplit("/", 1)[1], e) for p, e in rows(absent)] == [
        ("valley_rsl_absent.json", "Field 'level' not found"), ("valley_rsl_two.json", "Field 'at' not found")
    ]


def test_longest_prefix(spark):
    keys = list(FIELD_MAP)
    names = ["valley_rsl_1.json", "valley_x.json", "else.json"]
    got = [spark.range(1).select(longest_prefix(stem(F.lit(n)), keys).alias("p")).first()["p"] for n in names]
    assert got == ["valley_rsl", "valley", None]
    assert spark.range(1).select(longest_prefix(F.lit("x"), []).alias("p")).first()["p"] is None


def test_pages(spark):
    bodies = [
        ("a", json.dumps({"count": 3, "next": None, "results": [{"n": 1}, {"n": 2}]})),
        ("a", json.dumps({"count": 3, "results": [{"n": 3}]})),
        ("b", json.dumps([{"n": 4}])),
        ("c", json.dumps({"data": [{"n": 5}]})),
        ("d", json.dumps({"count": 2, "results": [{"n": 6}]})),
        ("e", json.dumps({"count": 0, "results": []})),
    ]
    pages = spark.createDataFrame(bodies, "source string, body string")
    got = increments.page_records(pages).select("source", F.col("record")["n"].alias("n"))
    assert rows(got) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4"), ("c", "5"), ("d", "6")]
    complete = dict(rows(increments.page_completeness(pages, ["source"]), "source", "complete"))
    assert complete == {"a": True, "b": True, "c": True, "d": False, "e": True}
    keyed = spark.createDataFrame([(json.dumps({"items": [{"n": 1}], "results": [{"n": 2}]}),)], "body string")
    assert rows(increments.page_records(keyed, results_key="items").select(F.col("record")["n"])) == [("1",)]


def test_inventory(spark, tmp_path):
    write(tmp_path, a__csv=b"x" * 1572864, b__txt=b"")
    (tmp_path / "folder.csv").mkdir()
    assert rows(inventory(spark, str(tmp_path)), "filename", "size_bytes") == [("a.csv", 1572864), ("b.txt", 0)]
    listing = file_listing(spark, str(tmp_path), "*.csv")
    assert rows(listing, "folder", "filename", "size_mb") == [(tmp_path.name, "a.csv", 1.5)]


@pytest.mark.parametrize("name, size, ok", [("a.csv", 1, True), ("a.NC", 500 * 1024 * 1024, True), ("a.h5", 500 * 1024 * 1024 + 1, False), ("a.txt", 1, False), ("csv", 1, False)])
def test_upload_refusal(spark, name, size, ok):
    assert (spark.range(1).select(upload_refusal(F.lit(name), F.lit(size)).alias("r")).first()["r"] is None) is ok


def blocks(spark, dims):
    """Two links, three sublinks, four steps; the third sublink is padding."""
    level = {(c, s): [c * 100 + s * 10 + t for t in range(4)] if s < 2 else [float("nan")] * 4 for c in range(2) for s in range(3)}
    if dims == cube.SUBLINK_FIRST:
        nested = [[level[c, s] for c in range(2)] for s in range(3)]
    else:
        nested = [[level[c, s] for s in range(3)] for c in range(2)]
    nested = [[[float(x) for x in series] for series in plane] for plane in nested]
    times = [datetime(2026, 1, 1, 0, 0, 10 * t) for t in range(4)]
    kind = "cml_ids array<bigint>, sublink_ids array<bigint>, times array<timestamp_ntz>, rsl array<array<array<double>>>, tsl array<array<array<double>>>"
    return spark.createDataFrame([([101, 102], [0, 1, 2], times, nested, nested)], kind)


@pytest.mark.parametrize("dims", [cube.SUBLINK_FIRST, cube.LINK_FIRST])
def test_cube(spark, dims):
    expected = [
        (datetime(2026, 1, 1, 0, 0, 10 * t), str(101 + c), str(s), float(c * 100 + s * 10 + t), float(c * 100 + s * 10 + t))
        for c in range(2) for s in range(2) for t in range(4)
    ]
    assert rows(cube.valid_rows(blocks(spark, dims), dims)) == sorted(expected, key=repr)
    assert cube.to_rows(blocks(spark, dims), dims).count() == 24


def test_cube_unknown_dimensions(spark):
    with pytest.raises(ValueError):
        cube.to_rows(blocks(spark, cube.LINK_FIRST), ("time", "cml_id", "sublink_id"))


def test_cube_metadata(spark):
    base = "cml_ids array<bigint>, sublink_ids array<bigint>, site_0_lon array<double>, site_0_lat array<double>, site_1_lon array<double>, site_1_lat array<double>, frequency array<array<double>>"
    sites = ([10.0, 1.0], [50.0, 2.0], [10.0, 3.0], [50.01, 4.0])
    link_first = spark.createDataFrame([([1, 2], [0, 1], *sites, [[10.0, 11.0], [20.0, 21.0]])], base)
    sublink_first = spark.createDataFrame([([1, 2], [0, 1], *sites, [[10.0, 20.0], [11.0, 21.0]])], base)
    a = rows(cube.metadata_rows(link_first), "cml_id", "sublink_id", "frequency", "polarization")
    b = rows(cube.metadata_rows(sublink_first, frequency_dims=("sublink_id", "cml_id")), "cml_id", "sublink_id", "frequency", "polarization")
    assert a == b == [("1", "0", 10.0, None), ("1", "1", 11.0, None), ("2", "0", 20.0, None), ("2", "1", 21.0, None)]
    length = cube.metadata_rows(link_first).where("cml_id = '1'").first()["length"]
    assert length == pytest.approx(1111.95, abs=0.01)
    full = link_first.withColumns({"length": F.array(F.lit(5.0), F.lit(6.0)), "polarization": F.lit([["h", "v"], ["v", "h"]])})
    only = spark.createDataFrame([("1",)], "sublink_id string")
    assert rows(cube.metadata_rows(full, only), "cml_id", "polarization", "length") == [("1", "v", 5.0), ("2", "h", 6.0)]


def test_surplus_fields_are_a_file_error_whatever_lies_beside(spark, tmp_path):
    write(
        tmp_path,
        wide__csv="time,cml_id,sublink_id,tsl,rsl,note,more\n2025-05-01,w,s,1,-1,x,y\n",
        narrow__csv="time,cml_id,sublink_id,tsl,rsl\n2025-05-01,n,s,1,-1,SURPLUS\n2025-05-02,n,s,1,-1\n",
        short__csv="time,cml_id,sublink_id,tsl,rsl\n2025-05-01,h,s\n",
        empty__csv="time,cml_id,sublink_id,tsl,rsl\n2025-05-01,e,s,1,-1,\n",
    )
    found = delimited.read_raw(spark, str(tmp_path), load_format("demo_csv_data"))
    said = "Expected 5 fields, saw more"
    assert rows(found, "cml_id", "header_error") == [("e", None), ("h", None), ("n", said), ("n", None), ("w", None)]
    assert rows(found.where("cml_id = 'h'"), "tsl", "rsl") == [(None, None)]


@pytest.mark.parametrize("block", ["65536", "134217728"])
def test_a_repeated_header_is_a_row_in_every_block(spark, tmp_path, block):
    lines = [f"2025-05-01 00:00:00,{i},s,1,-{i}" for i in range(6000)]
    header = "time,cml_id,sublink_id,tsl,rsl"
    write(tmp_path, a__csv="\n".join([header, header, *lines[:5000], header, *lines[5000:]]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = delimited.read_raw(spark, str(tmp_path), load_format("demo_csv_data"))
        assert found.count() == 6002 and found.where("time IS NULL").count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_utf16(spark, tmp_path):
    write(tmp_path, a__csv="time,cml_id,sublink_id,tsl,rsl\n2026-01-22,Lä,a,1,-2\n".encode("utf-16"))
    fmt = generic(read_csv_kwargs={"encoding": "UTF-16"})
    assert raw(spark, tmp_path, fmt) == [(datetime(2026, 1, 22), "Lä", "a", 1.0, -2.0)]


def test_any_filled_surplus_field_counts(spark):
    from fadeline.sources.delimited import _filled_after

    fmt = load_format("csv_generic", {})
    lines = ["a,b", "a,b,,", "a,b,,EXTRA", "a,b,,,,,EXTRA", '"a,x",b', '"a,x",b,,"c,d"', "a,b,c"]
    rows = spark.createDataFrame([(i, v, 2) for i, v in enumerate(lines)], "i int, v string, n int")
    got = [r.s for r in rows.select("i", _filled_after(F.col("v"), F.col("n"), fmt).alias("s")).orderBy("i").collect()]
    assert got == [False, False, True, True, False, True, True]
