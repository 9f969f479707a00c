"""Run registered queries next to their SQL in DuckDB and compare all values."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def difference(spark, con, name, run, sql, sf_dir):
    """None if both sides agree, else a text that says how they differ."""
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    want = answer.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = normal(df.columns, got), normal(columns, want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        return f"{name}: {len(a)} rows against {len(b)}\n  spark {only_a}\n  duckdb {only_b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from fadeline.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():  # noqa: B007
        if names and name not in names:
            continue
        begin = time.time()
        try:
            if name in oracle:
                text = difference(spark, con, name, run, oracle[name], sf_dir)
            else:
                text = None
                print(f"{name}: {len(run(spark, sf_dir).collect())} rows, no SQL")
        except Exception as error:  # report and go on with the next query
            text = f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += text is not None
        print(text or f"{name}: ok {time.time() - begin:.2f} s", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
