"""Search, shortened errors, summaries and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fadeline.functions.numbers import number_text

ERROR_TEXT_LENGTH = 80


def contains_ci(x: Column, search: str | None) -> Column:
    """Case-insensitive contains; an empty search matches all.  ``%`` and ``_``
    in the search text act as wildcards."""
    if not search:
        return F.lit(True)
    return x.cast("string").ilike(f"%{search}%")


def short_error(message: Column, length: int = ERROR_TEXT_LENGTH) -> Column:
    return F.when(F.length(message) > length, F.concat(F.substring(message, 1, length), F.lit("…"))).otherwise(message)


def link_summary() -> Column:
    """Summary of a link left-joined with its statistics, one part per line.

    Needs ``cml_id``, ``has_stats`` and the windowed statistics columns.  The
    texts are fixed values.
    """
    null_word = F.lit("null")
    parts = [
        F.concat(
            F.lit("Completeness (6h): "),
            F.coalesce(number_text(F.col("completeness_percent_6h")), null_word),
            F.lit("%"),
        ),
        F.concat(
            F.lit("Valid records (6h): "),
            F.coalesce(F.col("valid_records_6h"), F.lit(0)).cast("string"),
            F.lit("/"),
            F.coalesce(F.col("total_records_6h"), F.lit(0)).cast("string"),
        ),
        F.concat(F.lit("Last RSL: "), number_text(F.col("last_rsl")), F.lit(" dBm")),
        F.concat(F.lit("Std Dev (1h): "), number_text(F.col("stddev_rsl_1h"))),
    ]
    shown = [F.when(F.col("has_stats"), part) for part in parts]
    return F.concat_ws("\n", F.concat(F.lit("CML "), F.col("cml_id")), *shown)


def window_text(time: Column, style: str = "datetime") -> Column:
    """A window edge as date or date-time text."""
    pattern = "yyyy-MM-dd" if style == "date" else "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return F.date_format(time, pattern)


def landed_name(source: Column, start: Column, end: Column, variant: Column, variant_first: bool = False) -> Column:
    """Name of the file that holds one source, window and variant.

    ``variant_first`` puts the variant directly after the source, which makes
    the name match field-map keys such as ``source_rsl``.
    """
    edge = [F.regexp_replace(x, "[:-]", "") for x in (start, end)]
    suffix = F.when(variant != "", variant)
    order = [source, suffix, *edge] if variant_first else [source, *edge, suffix]
    return F.concat(F.concat_ws("_", *order, F.lit("data")), F.lit(".json"))
