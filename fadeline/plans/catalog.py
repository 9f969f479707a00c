"""Registered queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The views of ``fadeline.plans.views`` in SQL.
VIEWS = {
    "ev": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "observations": """SELECT event_id AS seq, ts AS time, CAST(user_id AS VARCHAR) AS cml_id, event_type AS sublink_id,
        CASE WHEN k % 10 <> 0 THEN 0 - value END AS rsl, CAST(k AS DOUBLE) AS tsl,
        CASE WHEN user_id % 3 = 0 THEN 'tenant_b' ELSE 'tenant_a' END AS user_id FROM ev""",
    "arrivals": """SELECT * FROM observations UNION ALL
        SELECT event_id + 1000000000000, ts, CAST(user_id AS VARCHAR), event_type, 0 - value - 1,
        CASE WHEN k < 97 THEN CAST(k AS DOUBLE) END,
        CASE WHEN user_id % 3 = 0 THEN 'tenant_b' ELSE 'tenant_a' END FROM ev WHERE k >= 90""",
    "links": """SELECT CASE WHEN c_acctbal < 0 THEN 'other-' ELSE '' END || CAST(c_custkey AS VARCHAR) AS cml_id, s.sublink_id,
        CAST(round(11.0 + (c_custkey % 50) * 0.01, 3) AS DOUBLE) AS site_0_lon,
        CAST(round(57.0 + (c_custkey % 40) * 0.01, 3) AS DOUBLE) AS site_0_lat,
        CAST(round(11.004 + (c_custkey % 50) * 0.01, 3) AS DOUBLE) AS site_1_lon,
        CAST(round(56.994 + (c_custkey % 40) * 0.01, 3) AS DOUBLE) AS site_1_lat,
        CAST(18 + length(s.sublink_id) AS DOUBLE) AS frequency,
        CASE WHEN c_custkey % 2 = 0 THEN 'H' ELSE 'V' END AS polarization,
        CASE WHEN c_custkey % 3 = 0 THEN 'tenant_b' ELSE 'tenant_a' END AS user_id
        FROM customer, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) s(sublink_id)""",
    "file_log": """SELECT o_orderkey AS id,
        CASE WHEN o_custkey % 3 = 0 THEN 'tenant_b' ELSE 'tenant_a' END AS user_id,
        'cml_' || CASE WHEN o_orderkey % 7 = 0 THEN 'meta' WHEN o_orderkey % 11 = 0 THEN 'notes' ELSE 'data' END || '_' ||
        CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 13 = 0 THEN '.json' ELSE '.csv' END AS filename,
        CASE WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'archived' END AS status,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS INT) END AS rows_written,
        CASE WHEN o_orderstatus = 'P' THEN 'Parse error: ' || o_orderpriority || CASE WHEN o_totalprice > 300000 THEN
        ' while reading a field that has no closing quote before the end of the file is reached' ELSE '' END END AS error_message,
        o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS processed_at FROM orders""",
}
_NEEDS = {"observations": ["ev"], "arrivals": ["ev", "observations"]}


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause for the named views and further definitions."""
    wanted: list[str] = []
    for name in names:
        for view in [*_NEEDS.get(name, []), name]:
            if view not in wanted:
                wanted.append(view)
    parts = [f"{v} AS ({VIEWS[v]})" for v in wanted]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


def half_up_sql(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register
