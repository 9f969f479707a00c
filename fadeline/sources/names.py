"""What a file name says: kind of file, field map, admission to the upload folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fadeline.sources.formats import Format

# What may be uploaded.
UPLOAD_EXTENSIONS = ["nc", "csv", "h5", "hdf5"]
UPLOAD_LIMIT_BYTES = 500 * 1024 * 1024


def file_kind(name: Column, fmt: Format) -> Column:
    """``rawdata``, ``metadata`` or ``unsupported``; JSON is always raw data and
    the metadata keyword is tried before the raw ones."""
    low = F.lower(name)
    kind = F.when(low.endswith(".json"), "rawdata")
    if fmt.metadata_keyword is not None:
        kind = kind.when(low.contains(fmt.metadata_keyword.lower()), "metadata")
    if fmt.rawdata_keywords is None:
        return kind.otherwise("rawdata")
    hits = reduce(Column.__or__, [low.contains(k.lower()) for k in fmt.rawdata_keywords])
    return kind.when(hits, "rawdata").otherwise("unsupported")


def plain_name(encoded: Column) -> Column:
    """File name as it is on disk; file metadata gives it URL-encoded."""
    return F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def longest_prefix(text: Column, prefixes) -> Column:
    """The longest of the given prefixes that ``text`` starts with, or null.
    The prefixes are configuration, so they become a chain of tests, longest
    first, and no join is needed."""
    ordered = sorted(prefixes, key=lambda p: (-len(p), p))
    if not ordered:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(text.startswith(p), F.lit(p)) for p in ordered])


def upload_refusal(name: Column, size_bytes: Column) -> Column:
    """Why a file may not be uploaded, or null.  The texts are fixed values."""
    extension = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))
    allowed = F.coalesce(extension.isin(UPLOAD_EXTENSIONS), F.lit(False))
    return F.coalesce(
        F.when(~allowed, F.lit("File type not allowed. Allowed: " + ", ".join(UPLOAD_EXTENSIONS))),
        F.when(size_bytes > UPLOAD_LIMIT_BYTES, F.lit("File size exceeds 500 MB limit")),
    )


def unique_name(name: Column, uploaded_at: Column, token: Column) -> Column:
    """Stem, time and eight characters of a token keep equal names apart."""
    return F.concat_ws(
        "_", stem(name), F.date_format(uploaded_at, "yyyyMMdd_HHmmss"), F.concat(F.substring(token, 1, 8), F.lit("."), F.substring_index(name, ".", -1))
    )


def size_mb(size_bytes: Column) -> Column:
    return F.round(size_bytes / (1024 * 1024), 2)
