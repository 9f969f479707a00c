"""JSON records mapped to observations by a field map.

A field map gives, per file-name prefix, the source field of each canonical
column.  The longest matching prefix counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.functions.identity import id_text
from fadeline.functions.numbers import to_number
from fadeline.functions.times import parse_time
from fadeline.schemas import RAW_COLUMNS
from fadeline.sources.names import longest_prefix, plain_name, stem

FieldMap = dict[str, dict[str, str]]
RECORDS = "array<map<string,string>>"


def route(files: DataFrame, field_map: FieldMap, name: str = "filename") -> DataFrame:
    """Add to each file its field-map key ``prefix`` and the key's ``fields``
    (canonical column to source field).  Done once per file, before its records
    are opened."""
    routed = files.withColumn("prefix", longest_prefix(stem(F.col(name)), field_map))
    if not field_map:
        return routed.withColumn("fields", F.lit(None).cast("map<string,string>"))
    fields = F.lit(None).cast("map<string,string>")
    for key, mapping in field_map.items():
        pairs = [F.lit(v) for pair in mapping.items() for v in pair]
        fields = F.when(F.col("prefix") == key, F.create_map(*pairs)).otherwise(fields)
    return routed.withColumn("fields", fields)


def map_records(records: DataFrame) -> DataFrame:
    """Routed rows with a ``record`` map to canonical columns.  The column
    ``absent`` has, in the order of the field map, the name of each mapped field that
    the record lacks, and null for those it has."""
    got = {c: F.element_at("record", F.element_at("fields", c)) for c in RAW_COLUMNS}
    absent = F.transform(F.map_values("fields"), lambda f: F.when(~F.map_contains_key("record", f), f))
    keep = [c for c in records.columns if c not in ("record", "fields")]
    return records.select(
        *keep,
        absent.alias("absent"),
        parse_time(got["time"]).alias("time"),
        id_text(got["cml_id"]).alias("cml_id"),
        got["sublink_id"].alias("sublink_id"),
        to_number(got["tsl"]).alias("tsl"),
        to_number(got["rsl"]).alias("rsl"),
    )


def read_files(spark: SparkSession, path, glob: str = "*.json", since=None) -> DataFrame:
    """One row per file.  A landed file holds one request window as one JSON
    value, which no reader can split."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    if since is not None:
        files = files.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return with_file(files)


def with_file(files: DataFrame) -> DataFrame:
    return files.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        plain_name(F.col("_metadata.file_name")).alias("filename"),
        F.col("_metadata.file_modification_time").alias("file_modified"),
    )


def raw_rows(files: DataFrame, field_map: FieldMap) -> DataFrame:
    """Observations of all files, with the file-level error in ``header_error``."""
    parsed = route(files, field_map).withColumn("records", F.from_json("value", RECORDS))
    unreadable = F.when(F.col("records").isNull(), F.lit("Invalid JSON"))
    exploded = parsed.select(
        "file_path", "filename", "file_modified", "prefix", "fields", unreadable.alias("unreadable"),
        F.posexplode_outer("records").alias("line_no", "record"),
    )
    rows = map_records(exploded)
    available = ", ".join(sorted(field_map))
    # the texts of file errors are fixed values
    unrouted = F.when(
        F.col("prefix").isNull(),
        F.concat(F.lit("No field-map entry matches filename stem '"), stem(F.col("filename")), F.lit(f"'. Available prefixes: {available}")),
    )
    error = F.coalesce(unrouted, F.col("unreadable"))
    return rows.withColumn("header_error", error).withColumns(
        {"line_no": F.col("line_no").cast("bigint"), "block_start": F.lit(0).cast("bigint")}
    )


def absent_fields(rows: DataFrame) -> DataFrame:
    """Files in which a mapped field occurs in no record at all; the first one by the
    order of the field map.  A field that only some records lack is null in these."""
    lacking = [F.get("absent", F.lit(i)) for i in range(len(RAW_COLUMNS))]
    everywhere = [F.when(F.bool_and(f.isNotNull()), F.min(f)) for f in lacking]
    per_file = rows.where("line_no IS NOT NULL").groupBy("file_path").agg(F.coalesce(*everywhere).alias("field"))
    return per_file.where("field IS NOT NULL").select(
        "file_path", F.concat(F.lit("Field '"), "field", F.lit("' not found")).alias("header_error")
    )
