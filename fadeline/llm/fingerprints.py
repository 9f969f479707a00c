"""Fingerprints of documents: a Merkle tree over paragraphs and sections.

A paragraph is a line of the text; its digest is that of its characters.  A section
is a run of paragraphs that ends after one whose digest says so (or with the text),
so a new paragraph moves no later section; its digest is that of its paragraphs'
digests.  The root is the digest of the sections' digests: equal roots, equal texts.
Below a paragraph lie its pieces: up to 32 characters, or up to the end of a
sentence.  Branches that differ lead from the root through sections to the paragraphs
that were edited (``edit``), and the pieces say how much of them is left.

The fingerprint is a text of four parts joined by ``:`` - the root, and the
digests of sections, paragraphs and pieces, each joined by ``.``.  Everything is
column expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fadeline.llm.order import with_next
from fadeline.llm.quality import let
from fadeline.llm.text import text_of

#: A piece: at most 32 characters of a sentence with the marks that end it.
PIECE = r"[^\n.!?]{1,32}+[.!?]*+|[.!?]++|\n"
LINE_BREAK, ENDS_SECTION = "\n", r"(?<=[0-3])\."


def strong(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def short(text: Column) -> Column:
    """Eight hexadecimal digits."""
    return F.substring(F.hex(F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63)))), 9, 8)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as the empty text."""

    def joined(whole: Column) -> Column:
        paragraphs = F.array_join(F.transform(F.split(whole, LINE_BREAK), strong), ".")
        pieces = F.array_join(F.transform(F.regexp_extract_all(whole, F.lit(PIECE), F.lit(0)), short), ".")

        def above(p: Column) -> Column:
            sections = F.array_join(F.transform(F.split(p, ENDS_SECTION), strong), ".")
            return let(sections, lambda s: F.concat_ws(":", F.sha2(s, 256), s, p, pieces))

        return let(paragraphs, above)

    return let(F.coalesce(text, F.lit("")), joined)


def part(of: Column, level: int) -> Column:
    """The digests of one level of a fingerprint: 1 sections, 2 paragraphs, 3 pieces."""
    return F.filter(F.split(F.split_part(of, F.lit(":"), F.lit(level + 1)), r"\."), lambda d: d != "")


def likeness(one: Column, other: Column) -> Column:
    """Share of pieces that two fingerprints have in common, 0 to 1; equal roots are 1."""

    def of_pieces(a: Column, b: Column) -> Column:
        return let(F.size(F.array_intersect(a, b)), lambda n: n / F.greatest(F.lit(1), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - n))

    shared = let(part(one, 3), lambda a: let(part(other, 3), lambda b: of_pieces(a, b)))
    return F.when(F.split_part(one, F.lit(":"), F.lit(1)) == F.split_part(other, F.lit(":"), F.lit(1)), 1.0).otherwise(shared)


def in_common(one: Column, other: Column) -> Column:
    """How many items two arrays have in common from their begin."""
    same = F.array_position(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b)), False)
    return let(same, lambda at: F.when(at > 0, at - 1).otherwise(F.least(F.size(one), F.size(other)).cast("long")).cast("int"))


def differing(one: Column, other: Column, body) -> Column:
    """``body`` of the number of items in common from the begin, and from the end beyond these."""
    return let(
        in_common(one, other),
        lambda p: let(F.least(in_common(F.reverse(one), F.reverse(other)), F.least(F.size(one), F.size(other)) - p), lambda s: body(p, s)),
    )


def edit(before: Column, after: Column) -> Column:
    """Where two fingerprints differ: ``place`` of the first paragraph (from 0) that is
    not the same, and how many paragraphs of ``before`` are ``removed`` and of
    ``after`` ``added`` there; null if the roots are equal.

    The tree is walked down: equal roots have no edit; sections that are equal from
    the begin or from the end are left aside by their digests; only of those between
    are the paragraphs compared, again from both ends.  So a removed copy of a
    repeated paragraph, a move and a deletion have their places, and edits in several
    places are one from the first to the last.
    """

    def of_paragraphs(old: Column, new: Column, ahead: Column) -> Column:
        found = lambda p, s: F.struct(
            (ahead + p).cast("long").alias("place"), (F.size(old) - p - s).cast("long").alias("removed"), (F.size(new) - p - s).cast("long").alias("added")
        )
        return differing(old, new, found)

    def of_sections(old: Column, new: Column) -> Column:
        paragraphs = lambda sections: let(F.array_join(sections, "."), lambda t: F.filter(F.split(t, r"\."), lambda d: d != ""))
        middle = lambda sections, p, s: paragraphs(F.slice(sections, p + 1, F.size(sections) - p - s))
        ahead = lambda p: F.size(paragraphs(F.slice(old, F.lit(1), p)))
        inside = lambda p, s: let(middle(old, p, s), lambda a: let(middle(new, p, s), lambda b: let(ahead(p), lambda n: of_paragraphs(a, b, n))))
        return differing(part(before, 1), part(after, 1), inside)

    sections = lambda of: F.split(F.split_part(of, F.lit(":"), F.lit(3)), ENDS_SECTION)
    found = let(sections(before), lambda a: let(sections(after), lambda b: of_sections(a, b)))
    equal = F.split_part(before, F.lit(":"), F.lit(1)) == F.split_part(after, F.lit(":"), F.lit(1))
    return F.when(~equal, found)


def report(df: DataFrame, chunks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of an edited one, whose last half comes from
    the beginning of the next document, with their likeness and the place of the edit.

    Documents of equal ids follow one another by their texts' digests; those without
    an id come last.  Null texts are empty; other columns are left out.
    """
    docs = df.select("doc_id", text_of("text").alias("text"))
    rows = with_next(docs, "doc_id", "text", "next_text", chunks)
    # only texts are shuffled: a fingerprint of the next text costs less than sending it along
    n, half = F.length("text"), F.expr("length(text) div 2").cast("int")
    after = F.coalesce("next_text", F.lit(""))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(after).alias("next_fingerprint"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring(after, F.lit(1), half)).alias("edited"),
    )
    edited = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    edited = edited.withColumn("edit", edit(F.col("fingerprint"), F.col("edited_fingerprint")))
    return edited.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        *(F.col(f"edit.{c}").alias(f"edit_{c}") for c in ("place", "removed", "added")),
    )
