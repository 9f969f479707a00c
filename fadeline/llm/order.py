"""Places in a total order, without putting all rows into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from fadeline.llm.quality import let
from fadeline.llm.text import unused

#: The branching of the search among bounds.
BRANCHES = 16


def filled(column: str) -> Column:
    """A text for each value, null included, so that equality joins it."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def numbered(df: DataFrame, group: list[str], chunk: list[str], order: list[Column], into: str) -> DataFrame:
    """``df`` with ``into``: places 0, 1, 2, ... within ``group``, by ``chunk`` and then ``order``.

    Rows are numbered within (group, chunk), which also parts a group that holds
    many rows; the numbers before a chunk come from the counts of the chunks, of
    which a group has few.  Nulls are a group, and a chunk, of their own.  Numbering
    and the join use one partitioning, so each row is shuffled once.
    """
    keys = [*group, *chunk]
    names = [unused(df, f"number_key_{i}") for i in range(len(keys))]
    sizes, before = unused(df, "chunk_rows"), unused(df, "rows_before")
    own = df.withColumns({name: filled(k) for name, k in zip(names, keys)})
    counts = own.groupBy(*names).agg(F.count(F.lit(1)).alias(sizes), *(F.first(k).alias(f"first_{i}") for i, k in enumerate(keys)))
    n = len(group)
    earlier = Window.partitionBy(*names[:n]).orderBy(*(f"first_{i}" for i in range(n, len(keys)))).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*names, F.coalesce(F.sum(sizes).over(earlier), F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    placed = own.withColumn(into, local.cast("long")).join(starts, names)
    return placed.select(*(F.col(f"`{c}`") for c in df.columns if c != into), (F.col(into) + F.col(before)).alias(into))


def below(bounds: list[int], value: Column, or_equal: bool = False) -> Column:
    """How many of the sorted ``bounds`` (a power of BRANCHES, less one) are below ``value``.

    The bounds are one text that the planner folds into a constant: a list of
    literals would cost the driver time for each of them.
    """
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def narrowed(step: int):
        def part(start: Column) -> Column:
            bound = lambda k: F.get(array, start + k * step - 1)
            less = lambda k: bound(k) <= value if or_equal else bound(k) < value
            return start + step * F.size(F.filter(F.sequence(F.lit(1), F.lit(BRANCHES - 1)), less))

        return part

    at, step = F.lit(0), (len(bounds) + 1) // BRANCHES
    while step:
        at = let(at, narrowed(step))
        step //= BRANCHES
    return at


def chunked(df: DataFrame, key: str, tie: str, into: str, chunks: int) -> DataFrame:
    """``df`` with ``into``: a number that rises as whole numbers ``key`` fall (nulls
    last) and then as ``tie`` (hexadecimal digits, evenly spread) rises.

    The bounds are quantiles of the key, as many as ``chunks`` asks for and however
    many rows there are.  A key that takes several quantiles, and the rows without a
    key, are parted by their ties.
    """
    n = BRANCHES ** max(1, math.ceil(math.log(max(2, chunks), BRANCHES)))
    at = [k / n for k in range(1, n)]
    rows, nulls, found = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull()), F.percentile_approx(F.col(key).cast("long"), at, F.lit(10 * n))).first()
    spread = F.conv(F.substring(tie, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    last, for_nulls = (1 << 20) - 1, max(1, n * nulls // max(1, rows))
    of_null = F.lit((n + 1) << 20).cast("long") + F.floor(spread * for_nulls)
    if not found:
        return df.withColumn(into, of_null)
    less, same = below(sorted(found), F.col(key)), below(sorted(found), F.col(key), or_equal=True)
    times = same - less
    within = F.when(times > 1, F.floor(spread * times)).otherwise(last)
    return df.withColumn(into, F.when(F.col(key).isNull(), of_null).otherwise(F.shiftleft((n - less).cast("long"), 20) + within))


def with_next(df: DataFrame, key: str, text: str, into: str, chunks: int | None = None) -> DataFrame:
    """``df`` with ``into``: the text of the row that follows by falling ``key``; after
    the last row comes the first again.

    Rows of equal keys follow one another by the digest of ``text``; rows without a
    key come last.  Each row goes to a chunk of neighbours (``chunks`` of them, by
    default as many as there are shuffle partitions), and the first row of each chunk
    also to the chunk before.  Which rows these are is worked out from keys and
    digests beforehand, one for each chunk.  Rows that are equal in key and text stay
    together.
    """
    spark = df.sparkSession
    tie, chunk, ghost = (unused(df, name) for name in ("tie", "chunk", "ghost"))
    placed = chunked(df.withColumn(tie, F.md5(text)), key, tie, chunk, chunks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.struct((-F.col(key).cast("decimal(38,0)")).alias("order"), F.col(tie).alias("tie"))
    firsts = placed.groupBy(chunk).agg(F.min(order).alias("first")).select(chunk, "first.order", "first.tie").orderBy(chunk).collect()  # a row for each chunk
    if not firsts:
        return df.withColumn(into, F.lit(None).cast("string"))
    before = [(c, order, own, firsts[i - 1][0]) for i, (c, order, own) in enumerate(firsts)]
    known = spark.createDataFrame(before, "of long, first_order decimal(38,0), first_tie string, before long")
    is_first = (F.col(chunk) == F.col("of")) & (F.col(tie) == F.col("first_tie")) & (-F.col(key).cast("decimal(38,0)")).eqNullSafe(F.col("first_order"))
    copies = F.array(F.struct(F.col(chunk).alias("chunk"), F.lit(0).alias("ghost")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("chunk"), F.lit(1).alias("ghost"))))
    place = unused(df, "place")
    dealt = placed.join(F.broadcast(known), is_first, "left").withColumn(place, F.explode(F.array_compact(copies)))
    dealt = dealt.select(*(F.col(f"`{c}`") for c in df.columns), tie, F.col(place)["chunk"].alias(chunk), F.col(place)["ghost"].alias(ghost))
    along = Window.partitionBy(chunk).orderBy(F.col(ghost), F.col(key).desc_nulls_last(), F.col(tie))
    return dealt.withColumn(into, F.lead(text).over(along)).filter(F.col(ghost) == 0).select(*(F.col(f"`{c}`") for c in df.columns if c != into), into)
