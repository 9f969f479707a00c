"""Delimited text, read by column name.

Files of one source may order their columns differently.  Spark's CSV reader
binds by position, so the lines are read as splittable text, each file's header
is taken from its first line, and the fields of a row are picked at the
positions the header gives.  A large file is thus read by many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.functions.identity import id_text
from fadeline.functions.numbers import to_number
from fadeline.functions.times import column_to_utc
from fadeline.schemas import COORDINATES, LINK_COLUMNS, RAW_COLUMNS
from fadeline.session import staged
from fadeline.sources.formats import MISSING_TEXTS, Format
from fadeline.sources.names import plain_name

FILE_COLUMNS = ["file_path", "filename", "file_modified"]


def text_lines(spark: SparkSession, path, fmt: Format, glob: str = "*", since=None) -> DataFrame:
    """Lines as they are, with their file and place: the start of the block a
    task read, and a number that rises inside the block.  The header is in the
    block at zero.  ``since`` leaves files unopened that were changed before."""
    source = spark.read.option("pathGlobFilter", glob).text(path, wholetext=fmt.whole_files)
    if since is not None:
        source = source.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return number_lines(with_file(source, fmt))


def with_file(source: DataFrame, fmt: Format) -> DataFrame:
    """File columns for a text source, batch or streaming.  The source gives whole
    files where the format asks for it, else lines."""
    if fmt.whole_files:
        cut = source.select("_metadata", F.posexplode(F.split(_decoded(fmt), "\r\n|\n|\r")).alias("n", "value"))
        source, place = cut, [F.lit(0).cast("bigint").alias("block_start"), F.col("n").cast("bigint").alias("line_no")]
    else:
        place = [F.col("_metadata.file_block_start").alias("block_start")]
    return source.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        plain_name(F.col("_metadata.file_name")).alias("filename"),
        F.col("_metadata.file_modification_time").alias("file_modified"),
        *place,
    )


def _decoded(fmt: Format) -> Column:
    text = F.col("value")
    return text if fmt.utf8 else F.decode(text.cast("binary"), fmt.encoding)


def number_lines(lines: DataFrame) -> DataFrame:
    if "line_no" in lines.columns:
        return lines
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def clean_lines(lines: DataFrame, fmt: Format) -> DataFrame:
    """Skip lines, decode, cut comments, drop blank lines."""
    if fmt.skiprows:
        lines = lines.where(F.col("line_no") >= fmt.skiprows)
    text = F.col("value") if fmt.whole_files else _decoded(fmt)
    text = F.regexp_replace(text, "^﻿|\r$", "")
    if fmt.comment:
        text = F.regexp_replace(text, re.escape(fmt.comment) + ".*$", "")
    return lines.withColumn("value", text).where(F.length(F.trim("value")) > 0)


def headers(lines: DataFrame) -> DataFrame:
    """First line of each file and its place."""
    first = [F.min_by("value", "line_no").alias("header"), F.min("line_no").alias("header_line")]
    return lines.where("block_start = 0").groupBy("file_path").agg(*first)


def _split(text: Column, width: int, fmt: Format) -> Column:
    return F.from_csv(
        text,
        ", ".join(f"c{i} string" for i in range(width)),
        {"sep": fmt.sep, "quote": fmt.quotechar, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    )


def _filled_after(text: Column, n: Column, fmt: Format) -> Column:
    """Whether any field after the first ``n`` is filled, however many there are."""
    sep = re.escape(fmt.sep)
    if fmt.quotechar:
        q = re.escape(fmt.quotechar)
        text = F.regexp_replace(text, rf"(^|{sep}){q}(?:[^{q}\\]|\\.|{q}{q})*+{q}", "$1q")
    fields = F.split(text, sep)
    return F.coalesce(F.exists(F.slice(fields, n + 1, F.size(fields)), lambda f: F.length(f) > 0), F.lit(False))


def _fields(parsed: str, width: int) -> Column:
    return F.array(*[F.col(f"{parsed}.c{i}") for i in range(width)])


def named_rows(lines: DataFrame, fmt: Format, columns: list[str], renames: dict[str, str], required: list[str]) -> DataFrame:
    """Rows with ``columns`` as text, ``header_error`` where a required column is
    missing or a row has more fields than its own file's header (empty ones at its end
    aside), and the file columns.  Absent optional columns are null.  The header is the first line; a
    later line that looks like it is a row, in whatever block it lies."""
    lines = clean_lines(lines, fmt)
    heads = staged(headers(lines))
    width = heads.agg(F.max(F.size(F.split("header", re.escape(fmt.sep))))).first()[0] or 1
    names = F.transform(_fields("parsed", width), lambda n: F.trim(n))
    if renames:
        pairs = [F.lit(v) for pair in renames.items() for v in pair]
        to_canonical = F.create_map(*pairs)
        names = F.transform(names, lambda n: F.coalesce(F.element_at(to_canonical, n), n))
    heads = heads.withColumn("parsed", _split(F.col("header"), width, fmt))
    heads = heads.withColumn("n_fields", F.array_max(F.transform(_fields("parsed", width), lambda f, i: F.when(f.isNotNull(), i + 1)))).withColumn("names", names)
    positions = heads.select(
        "file_path",
        "header_line",
        "n_fields",
        *[F.array_position("names", c).cast("int").alias(f"at_{c}") for c in columns],
        F.coalesce(*[F.when(F.array_position("names", c) == 0, F.lit(f"column '{c}' not found")) for c in required]).alias("header_error")
        if required
        else F.lit(None).cast("string").alias("header_error"),
    )
    joined = lines.join(positions, "file_path")
    rows = joined.where(~((F.col("block_start") == 0) & (F.col("line_no") == F.col("header_line"))))
    cut = rows.withColumn("parsed", _split(F.col("value"), width + 1, fmt))
    fields = _fields("parsed", width)
    surplus = F.try_element_at(_fields("parsed", width + 1), F.col("n_fields") + 1).isNotNull() | _filled_after(F.col("value"), F.col("n_fields"), fmt)
    said = F.concat(F.lit("Expected "), F.col("n_fields").cast("string"), F.lit(" fields, saw more"))
    cut = cut.withColumn("header_error", F.coalesce("header_error", F.when(surplus, said)))
    missing = [*MISSING_TEXTS, *fmt.na_values]
    picked = []
    for c in columns:
        field = F.when(F.col(f"at_{c}") > 0, F.try_element_at(fields, F.col(f"at_{c}")))
        picked.append(F.when(~F.trim(field).isin(missing), field).alias(c))
    return cut.select(*FILE_COLUMNS, "block_start", "line_no", "header_error", *picked)


def raw_rows(lines: DataFrame, fmt: Format) -> DataFrame:
    """Observations in canonical columns and types."""
    required = RAW_COLUMNS if fmt.levels_required else ["time", "cml_id", "sublink_id"]
    rows = named_rows(lines, fmt, RAW_COLUMNS, fmt.rawdata_columns, required)
    if fmt.parse_raw:
        return fmt.parse_raw(rows)
    return column_to_utc(rows, "time", fmt.timezone, fmt.ambiguous).withColumns(
        {
            "cml_id": id_text(F.col("cml_id")),
            "tsl": to_number(F.col("tsl"), fmt.decimal),
            "rsl": to_number(F.col("rsl"), fmt.decimal),
        }
    )


def metadata_rows(lines: DataFrame, fmt: Format) -> DataFrame:
    """Link metadata in canonical columns and types."""
    rows = named_rows(lines, fmt, LINK_COLUMNS, fmt.metadata_columns, LINK_COLUMNS)
    if fmt.parse_metadata:
        return fmt.parse_metadata(rows)
    numbers = {c: to_number(F.col(c), fmt.decimal) for c in COORDINATES}
    numbers["frequency"] = to_number(F.col("frequency"), fmt.decimal) * fmt.frequency_factor
    numbers["length"] = to_number(F.col("length"), fmt.decimal) * fmt.length_factor
    return rows.withColumns({**numbers, "cml_id": id_text(F.col("cml_id"))})


def read_raw(spark: SparkSession, path, fmt: Format, glob: str = "*") -> DataFrame:
    return raw_rows(text_lines(spark, path, fmt, glob), fmt)


def read_metadata(spark: SparkSession, path, fmt: Format, glob: str = "*") -> DataFrame:
    return metadata_rows(text_lines(spark, path, fmt, glob), fmt)
