"""Mixing sources to target weights by systematic sampling.

Each document of a source is to be taken as often as the source's target asks,
target / size of the source, at most twice.  These expected copies are summed up
over the source's documents, from one random offset on, and a document is given
out once for each whole number its own part of the sum crosses.  The documents are
in order of size, so those taken are of all sizes alike and their words come near
the target.

The sum needs no pass over a whole source in one task: with equal parts it is a
document's place times the rate, and places come from counts of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fadeline.llm.order import numbered
from fadeline.llm.text import unused, word_count

#: Fixed values of the mix: weights of the sources in their order, share of all words, most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def chance(*parts: Column | str) -> Column:
    """A number from 0 to 1 (1 excluded) that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame) -> DataFrame:
    """target of each source, from one row per source with ``source`` and ``source_size``.

    Sources by code point, null last, weigh WEIGHTS in turn and share SHARE of all
    words.  None gets more than MOST times its size; what is over goes to the others
    by weight.  In order of size per weight the sources that are full come first, so
    running sums tell which they are.
    """
    everything, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS))
    rows = sizes.select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).alias("most"))
    rows = rows.withColumns({"words": SHARE * F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full_words, full_weight = F.coalesce(F.sum("most").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = F.col("most") / F.col("weight") <= (F.col("words") - full_words) / (F.col("weights") - full_weight)
    rows = rows.withColumn("full", full)
    of_full = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0)).over(everything)
    rows = rows.withColumns({"full_words": of_full("most"), "full_weight": of_full("weight")})
    level = (F.col("words") - F.col("full_words")) / F.nullif(F.col("weights") - F.col("full_weight"), F.lit(0))
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def with_copies(documents: DataFrame, size: str, seed: str = "mix", ties: list[Column] | None = None) -> DataFrame:
    """``documents`` with ``source_size``, ``target`` and ``copies`` (0 to MOST).

    ``size`` is the column with each document's words; a null source is a source.
    The same rows give the same copies, however they are dealt out; rows that are
    equal in doc_id, source and size are told apart by ``ties``.  Columns of these
    names are replaced.
    """
    taken_names = ("source_size", "target", "copies")
    df = documents.drop(*taken_names)
    by_source = targets(df.groupBy("source").agg(F.sum(size).alias("source_size")))
    bits, dealt, place, same = (unused(df, name) for name in ("size_bits", "dealt", "place", "same_source"))
    in_binary = F.bin(F.col(size))
    chunked = df.withColumns({
        bits: F.concat(F.lpad(F.length(in_binary).cast("string"), 2, "0"), F.substring(in_binary, 1, 4)),
        dealt: F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2),
    })
    placed = numbered(chunked, ["source"], [bits, dealt], [F.col(size), F.col("doc_id").asc_nulls_last(), *(ties or [])], place)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    offset = chance(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    crossed = F.floor(offset + (F.col(place) + 1) * rate) - F.floor(offset + F.col(place) * rate)
    by_source = by_source.withColumnRenamed("source", same)
    joined = placed.join(by_source, F.col("source").eqNullSafe(F.col(same)))
    # the sums are rounded, so a rate just below MOST could cross once too often
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), "source_size", "target", F.least(crossed, F.ceil(rate)).cast("long").alias("copies"))


def report(documents: DataFrame) -> DataFrame:
    """Size, target and copies of every document.

    Null and empty texts have size 0 and are taken like others of their source; a null
    source is a source; equal rows are rows of their own; other columns are left out.
    """
    sized = documents.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"))
    return with_copies(sized, "size").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(documents: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    size = unused(documents, "mix_size")
    own = [c for c in documents.columns]
    renamed = {c: unused(documents, f"own_{c}") for c in ("source_size", "target", "copies") if c in own}
    sized = documents.withColumnsRenamed(renamed).withColumn(size, word_count(F.col("text").cast("string")))
    taken = with_copies(sized, size, ties=[F.xxhash64(F.col("text"))])
    again = unused(taken, "again")
    rows = taken.filter("copies > 0").withColumn(again, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*(F.col(f"`{renamed.get(c, c)}`").alias(c) for c in own))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         2 * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS words
  FROM sources
), filled AS (
  SELECT *, sum(weight) OVER () AS weights,
         most::DOUBLE / weight <= (words - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS is_full
  FROM weighted
  WINDOW before AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE
           (words - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) / nullif(weights - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER (), 0) * weight END AS target
  FROM filled
), placed AS (
  SELECT s.*, l.source_size, l.target, row_number() OVER (
           PARTITION BY s.source ORDER BY length(bin(size)), substr(bin(size), 1, 4), substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), size, doc_id NULLS LAST) - 1 AS place,
         ('0x' || substr(md5('mix/' || coalesce('=' || s.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
         coalesce(l.target / nullif(l.source_size, 0), 0) AS rate
  FROM sized s JOIN levels l ON s.source IS NOT DISTINCT FROM l.source
), taken AS (
  SELECT *, CAST(least(floor(start + (place + 1) * rate) - floor(start + place * rate), ceil(rate)) AS BIGINT) AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
