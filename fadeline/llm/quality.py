"""Line-first cleaning: rules judge each line, lines that fail go, and a document
that loses too much of its text is rejected.

Boilerplate is what a corpus says again and again: short lines that stand in many
documents which have nothing else in common.  ``frequent_lines`` counts them over all
documents.  A document is known by two of its lines, those with the smallest values
of two hash functions: copies and near copies have them in common more often than not,
other documents seldom, so a line that copies of one text share is no boilerplate.

All else is column expressions, a row at a time: no shuffle, no Python.  A value
that an expression needs more than once is bound by ``let``, so it is worked out
once per row however the plan is put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fadeline.llm.text import SPACES, WORD, text_of, unused

#: Share of its words that a document may lose.
MOST_LOST = 0.3

#: Boilerplate has so many words at most, and stands in so many different documents:
#: LEAST at least, and this share of all.  Documents that are known by the same two
#: lines are no more than MOST_ALIKE of those in which it stands.
BOILERPLATE_WORDS, LEAST, SHARE, MOST_ALIKE = 20, 50, 0.005, 0.2
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a set a text has."""
    return F.regexp_count(text, F.lit("[" + re.escape(characters) + "]"))


def words_of(text: Column) -> Column:
    """The words of a text that is not null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Number of words that lie in a window of words which the text holds again,
    the first one included.  Windows are told apart by 64-bit hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(own: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(own) - window + 1)
        return F.when(F.size(own) < window, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.xxhash64(F.slice(own, i, window))))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def of_equal(sorted_windows: Column) -> Column:
        same = lambda w, k: (F.get(sorted_windows, k)["hash"] == w["hash"])
        again = F.filter(sorted_windows, lambda w, k: F.coalesce(same(w, k - 1), F.lit(False)) | F.coalesce(same(w, k + 1), F.lit(False)))
        return covered(F.array_sort(F.transform(again, lambda w: w["place"])))

    def counted(own: Column) -> Column:
        placed = F.array_sort(F.transform(own, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0)).otherwise(let(placed, of_equal))

    return let(hashes, lambda own: let(windows(own), counted))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def frequent_lines(df: DataFrame, column: str = "text") -> list[int]:
    """Hashes of the lines that are boilerplate, rising.

    Each document gives each of its lines of BOILERPLATE_WORDS at most once.  There
    are no more such lines than an average document has, divided by SHARE.  Null and
    empty texts have no lines; below LEAST documents nothing is boilerplate.
    """
    lines = F.filter(F.split(text_of(column), "\n"), lambda line: line.rlike(WORD))
    least = lambda found, seed: F.array_min(F.transform(found, lambda line: F.xxhash64(F.lit(seed), line)))
    short = lambda found: F.array_distinct(F.transform(F.filter(found, lambda line: F.regexp_count(line, F.lit(WORD)) <= BOILERPLATE_WORDS), line_hash))
    of_document = let(lines, lambda found: F.struct(F.xxhash64(least(found, 1), least(found, 2)).alias("document"), short(found).alias("lines")))
    pairs = df.select(of_document.alias("found")).select("found.document", F.explode("found.lines").alias("line"))
    counted = pairs.groupBy("line", "document").agg(F.count(F.lit(1)).alias("n"))
    by_line = counted.groupBy("line").agg(F.count(F.lit(1)).alias("documents"), F.max("n").alias("most"), F.sum("n").alias("n"))
    often = (F.col("documents") >= LEAST) & (F.col("documents") >= SHARE * df.count()) & (F.col("most") <= MOST_ALIKE * F.col("n"))
    return sorted(r["line"] for r in by_line.filter(often).select("line").collect())


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words is not part of a running text.

    * punctuation: no mark that ends a sentence anywhere in it;
    * navigation: a separator for every ten words at least, three or more;
    * symbols: three for ten words or more, at least three;
    * shouting: five words or more without a small letter, or rows of exclamation marks;
    * stutter: three of ten words are the same as the next one.
    """
    some = lambda count, tenths: (count >= 3) & (count * 10 > n * tenths)
    return (
        ~line.rlike(r"[.!?…。！？।॥؟۔]")
        | ((count_of(line, "|»›•·") >= 3) & (count_of(line, "|»›•·") * 10 >= n))
        | some(count_of(line, "#*$%&<>{}~^"), 3)
        | ((n >= 5) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}|\p{Lo}"))
        | some(F.regexp_count(line, F.lit("!!")), 2)
        | some(F.regexp_count(line, F.lit(r"(?<![^ ])([^ ]+)(?= \1(?: |$))")), 3)
    )


def clean_lines(df: DataFrame, column: str = "text", into: str = "line_report", frequent: list[int] = ()) -> DataFrame:
    """``df`` with ``into``: a struct of ``cleaned`` (the text of the lines that
    pass, line breaks between), ``n_lines`` (lines that have a word), ``n_removed``,
    ``words_removed``, ``n_words`` and ``kept``.

    Lines that fail and lines that are ``frequent`` go.  The latter are no text of the
    document's own: it is kept if it has lost no more than MOST_LOST of its other
    words, and has any.  A null text counts as empty; an empty text has lost nothing
    and is kept.  A column named as ``into`` is replaced, all others stay as they are.
    """

    def judged(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(WORD))
        common = lambda k: (k > 0) & (k <= BOILERPLATE_WORDS) & line_hash(line).isin(list(frequent)) if frequent else F.lit(False)
        verdict = lambda k: let(common(k), lambda c: F.struct(line.alias("line"), k.alias("n"), c.alias("common"), ((k > 0) & ~c & line_fails(line, k)).alias("fails")))
        return let(n, verdict)

    def summed(lines: Column) -> Column:
        total = lambda which: F.aggregate(F.filter(lines, which), F.lit(0), lambda a, x: a + x["n"])
        gone = lambda x: x["fails"] | x["common"]
        lost, common, n_words = total(lambda x: x["fails"]), total(lambda x: x["common"]), total(lambda x: F.lit(True))
        return F.struct(
            F.array_join(F.transform(F.filter(lines, lambda x: ~gone(x)), lambda x: x["line"]), "\n").alias("cleaned"),
            F.size(F.filter(lines, lambda x: x["n"] > 0)).alias("n_lines"),
            F.size(F.filter(lines, gone)).alias("n_removed"),
            (lost + common).alias("words_removed"),
            n_words.alias("n_words"),
            ((lost <= MOST_LOST * (n_words - common)) & ((n_words == 0) | (n_words > common))).alias("kept"),
        )

    return df.withColumn(into, let(F.transform(F.split(text_of(column), "\n"), judged), summed))


def report(df: DataFrame) -> DataFrame:
    """Counts of every text, the base rule over them and the verdict of the lines.

    Null and empty texts have no words and fail the base rule; equal rows are rows of
    their own; other columns are left out.
    """
    text = text_of("text")
    own = unused(df, "line_report")
    with_words = clean_lines(df.select("doc_id", "text"), into=own, frequent=frequent_lines(df)).select("doc_id", own, text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counted = with_words.select(
        "doc_id",
        own,
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words_of(F.col("text")), lambda w: F.struct(F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("counts"),
    ).select("doc_id", own, "counts.word_chars", "n_symbols", "n_dup_lines", "counts.n_words", "counts.n_repeat_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col(f"{own}.kept")).alias("kept"),
        F.col(f"{own}.n_removed").cast("long").alias("n_lines_removed"),
        F.col(f"{own}.words_removed").cast("long").alias("n_words_removed"),
    )
