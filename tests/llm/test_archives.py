"""ARC and WARC files, round trips and odd records."""

import gzip
import hashlib
import random
import shutil
import time

import duckdb
import pytest

from compare import connect, difference
from fadeline.llm import archives
from fadeline.llm.queries import ORACLE, QUERIES

def arc(version, *records):
    about = f"{version} 0 me\n{archives.ARC_FIELDS[version]}\n".encode()
    head = f"filedesc://x.arc 0.0.0.0 19970901000000 text/plain {'200 - - 0 x.arc ' if version == 2 else ''}{len(about)}\n".encode()
    return head + about + b"".join(b"\n" + r for r in records)


@pytest.mark.parametrize("version", [1, 2])
def test_records_by_declared_length(version):
    tricky = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhttp://no.record/ 1.1.1.1 19990101000000 text/html 5\n\n\nbody"
    data = arc(
        version,
        archives.arc_line(version, "http://a/ b c", "19970901", "text/html", tricky, 5, "x"),
        archives.arc_line(version, "dns:a", "199709010203", "text/dns", b"", 6, "x"),
    )
    got = list(archives.parse_arc(data))
    assert [(r.version, r.uri, r.mime, r.block, r.whole) for r in got[1:]] == [(version, "http://a/ b c", "text/html", tricky, True), (version, "dns:a", "text/dns", b"", True)]
    cut = list(archives.parse_arc(data[: data.index(b"body")]))
    assert not cut[-1].whole


def test_lines_that_are_none():
    with pytest.raises(ValueError):
        list(archives.parse_arc(arc(1, b"nonsense\n")))
    with pytest.raises(ValueError):
        list(archives.parse_arc(b"filedesc://x 0.0.0.0 19970901000000 text/plain 4\n7 0 x"))


def test_dates_and_names():
    assert archives.iso_date("19970901") == "1997-09-01T00:00:00Z"
    assert archives.iso_date("199709010203") == "1997-09-01T02:03:00Z"
    assert archives.iso_date("1997") == "1997-01-01T00:00:00Z"
    assert archives.safe_uri("http://a/ é\nx") == "http://a/%20é%0Ax" and archives.safe_uri(None) == archives.safe_uri("") == "-"
    assert archives.record_id("a", "b") == archives.record_id("a", "b") != archives.record_id("ab")


def test_members_of_gzip():
    unpacked = lambda data: b"".join(archives.unpacked(data))
    assert unpacked(gzip.compress(b"one") + gzip.compress(b"two")) == b"onetwo"
    assert unpacked(b"plain") == b"plain" and unpacked(b"") == b""
    long = random.Random(1).randbytes(3_000_000)
    assert unpacked(gzip.compress(long) + gzip.compress(b"") + gzip.compress(b"end")) == long + b"end"


def test_members_take_time_in_proportion():
    """A hundred MB of members, each its own gzip file, as crawlers write them."""
    member = gzip.compress(random.Random(2).randbytes(1000))
    data = member * (100_000_000 // len(member))
    begin = time.perf_counter()
    assert sum(map(len, archives.unpacked(data))) == 1000 * (100_000_000 // len(member))
    assert time.perf_counter() - begin < 30


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10**6])
def test_records_over_chunks(size):
    blocks = [b"", b"\n\r\n", b"x" * 100, b"HTTP/1.0 200 OK\r\n\r\nhi"]
    data = arc(2, *(archives.arc_line(2, f"http://{i}", "1997", "text/html", b, 5, "x") for i, b in enumerate(blocks)))
    chunks = [data[i : i + size] for i in range(0, len(data), size)]
    assert list(archives.parse_arc(chunks)) == list(archives.parse_arc(data))
    assert [r.block for r in archives.parse_arc(chunks)][1:] == blocks
    warc = b"".join(archives.warc_record("resource", {"a": "b"}, b) + archives.WARC_END for b in blocks)
    assert [b for _, b in archives.parse_warc([warc[i : i + size] for i in range(0, len(warc), size)])] == blocks
    with pytest.raises(ValueError):
        list(archives.parse_warc([warc[:-1]]))


def test_foreign_and_equal_file_names(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n" + b"x" * 200
    record = archives.arc_line(1, "http://a/", "19970901", "text/html", page, 5, "x")
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/b").mkdir()
    (tmp_path / "in/a/IA-0001.arc").write_bytes(arc(1, record))
    (tmp_path / "in/b/IA-0001.arc").write_bytes(arc(1, record))
    (tmp_path / "in/crawl.arc.gz").write_bytes(b"".join(gzip.compress(part) for part in (arc(1), b"\n" + record)))
    (tmp_path / "in/empty.arc").write_bytes(b"")
    out = str(tmp_path / "out")
    archives.convert(spark, f"{tmp_path}/in/", out)
    rows = archives.warc_rows(spark, out).collect()
    assert sorted(r.record_type for r in rows) == ["response", "revisit", "revisit"] and len({r.record_id for r in rows}) == 3
    assert {r.refers_to_record for r in rows if r.record_type == "revisit"} == {r.record_id for r in rows if r.record_type == "response"}
    ids = lambda root: sorted(r.record_id for r in archives.arc_records(spark, root, False).select("record_id").collect())
    shutil.copytree(tmp_path / "in", tmp_path / "moved")
    assert ids(f"{tmp_path}/in") == ids(f"file://{tmp_path}/moved")  # wherever the folder lies
    assert archives.arc_records(spark, f"{tmp_path}/in", False, "*.gz").count() == 1


def test_odd_urls_like_the_sql(spark, tmp_path):
    urls = [None, "", "http://a b", "\thttp://é\u3000x\x7f", "http://%20", "http://\u00a0"]
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, uri FROM ({ORACLE['op1_archives']})").fetchall()
    got = QUERIES["op1_archives"](spark, str(tmp_path)).select("page_id", "uri").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op1_rows(spark, sf_dir):
    assert difference(spark, connect(sf_dir), "op1_archives", QUERIES["op1_archives"], ORACLE["op1_archives"], sf_dir) is None


def test_odd_pages(spark):
    same = "WARC/1.1\r\n\r\n\r\n\r\n" + "x" * 100
    rows = [
        (5, "http://a", same), (2, "http://b c\n", same), (2, "http://b", same), (9, None, same), (None, "http://n", same),
        (1, "http://e", None), (1, "http://e", None), (3, "", ""), (4, "http://s", "x" * 99), (6, "http://s", "x" * 99), (7, "http://l", "é\n\r" * 300_000),
    ]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, block string, value int").repartition(3)
    got = archives.report(df).collect()
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        data = (html or "").encode()
        of_page = [r for r in got if r.page_id == page_id]
        assert all((r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest()) for r in of_page)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    assert kinds == sorted([
        (5, "revisit", 2), (2, "response", None), (2, "revisit", 2), (9, "revisit", 2), (None, "revisit", 2), (1, "response", None), (1, "response", None),
        (3, "response", None), (4, "response", None), (6, "response", None), (7, "response", None),
    ], key=str)
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(rows)
    assert all(by_id[r.refers_to_record].record_type == "response" for r in got if r.record_type == "revisit")
    assert archives.report(df.limit(0)).count() == 0
