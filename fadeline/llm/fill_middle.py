"""Fill-in-the-middle: a text is cut in three and written with its middle last.

The cuts lie between units (a word with the blanks before it, or blanks at the end)
and are drawn from a digest of the document's id, so every rerun cuts alike.

A batch of texts is one array of bytes.  ``ends_of_units`` scans it for the places
where cuts may lie.  A segment - a prefix, middle or suffix - moves as a whole: the
array of differences holds, where a segment begins, by how much its shift departs
from that of the segment before, and its cumulative sum is the shift of every byte.
The bytes are scattered to place + shift and the marks written into the gaps.
``restore`` finds the marks, builds the differences the same way from the segments'
places in the output, and gathers each byte from where it went.  Both walk the
bytes in blocks, so the shifts of one block are in memory at a time.

An output holds its three marks and no other: texts that contain a mark stay plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fadeline.llm.text import SPACES, slices, text_of, unused

# The marks, the seed, the shares of texts that are rearranged, and of those the ones with the suffix first.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
SEED, RATE, SUFFIX_FIRST = 42, 50, 80

MARK_BYTES = 3
#: Order of the segments in an output.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Bytes whose shifts are in memory at a time.
BLOCK = 1 << 20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the places between them; null is empty."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = (texts.fill_null("") if texts.null_count else texts).buffers()
    start = 0 if texts.null_count else texts.offset
    at = np.frombuffer(offsets, width)[start : start + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def unflat(data: np.ndarray, at: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """Texts from their bytes and places; null where ``absent``."""
    offsets = pa.array(at, pa.int64()).buffers()[1]
    texts = pa.LargeStringArray.from_buffers(len(at) - 1, offsets, pa.py_buffer(data)).cast(pa.string())
    return texts if absent is None or not absent.any() else pa.array([None if gone else t for t, gone in zip(texts.to_pylist(), absent)], pa.string())


def ends_of_units(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places after the last byte of each unit, rising."""
    blank = np.isin(data, np.frombuffer(SPACES.encode(), np.uint8))
    ends = ~blank
    ends[:-1] &= blank[1:]
    ends[at[1:][np.diff(at) > 0] - 1] = True
    return np.flatnonzero(ends) + 1


def marks_in(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, rising, and the text that each lies in."""
    places = np.flatnonzero(data[:-2] == ord("<")) if len(data) >= MARK_BYTES else np.zeros(0, np.int64)
    kind = data[places + 1]
    places = places[(data[places + 2] == ord(">")) & np.isin(kind, [mark[1] for mark in MARKS.values()])]
    text = np.searchsorted(at, places, side="right") - 1
    within = places + MARK_BYTES <= at[text + 1]
    return places[within], text[within]


def shifts(begin: np.ndarray, shift: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places 0 to n in blocks, each with its shift: that of the last segment that
    begins at or before it.  ``begin`` rises; of equal places the last one holds."""
    steps, carried = np.diff(shift, prepend=0), 0
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        i, j = np.searchsorted(begin, [low, high])
        differences = np.zeros(high - low, np.int64)
        np.add.at(differences, begin[i:j] - low, steps[i:j])
        differences[0] += carried
        moved = np.cumsum(differences)
        carried = moved[-1]
        yield np.arange(low, high), moved


def characters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between two places each; segments do not overlap and rise."""
    out = np.zeros(len(begin), np.int64)
    some = end > begin
    if some.any():
        bounds = np.stack([begin[some], end[some]], 1).ravel()
        lead = np.append((data & 0xC0) != 0x80, False)
        out[some] = np.add.reduceat(lead, bounds, dtype=np.int64)[::2]
    return out


def rearranged(texts: pa.Array, draws: np.ndarray, rate: int, suffix_first: int) -> list[pa.Array]:
    """Units, form, characters of prefix and middle, and output of each text.

    ``draws`` has four numbers for each text: two for the cuts, one for whether and
    one for how it is rearranged.
    """
    data, at = flat(texts)
    ends = ends_of_units(data, at)
    before = np.searchsorted(ends, at, side="right")
    n = np.diff(before)
    drawn = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    places = np.append(ends, 0)  # after no unit at all is the text's begin
    cuts = np.where(drawn == 0, at[:-1, None], places[before[:-1, None] + drawn - 1])
    plain = (n == 0) | (draws[:, 2] % 100 >= rate)
    plain[marks_in(data, at)[1]] = True
    spm = draws[:, 3] % 100 < suffix_first

    # segments by their order in the text: prefix, middle, suffix; a plain text is one prefix
    begin = np.stack([at[:-1], np.where(plain, at[1:], cuts[:, 0]), np.where(plain, at[1:], cuts[:, 1])], 1)
    end = np.column_stack([begin[:, 1:], at[1:]])
    prefix, middle, suffix = (end - begin).T
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) + np.where(plain, 0, len(MARKS) * MARK_BYTES))])
    first = out_at[:-1] + MARK_BYTES
    second = first + np.where(spm, suffix, prefix) + MARK_BYTES
    goes = np.stack([np.where(plain, out_at[:-1], np.where(spm, second, first)), out_at[1:] - middle, np.where(spm, first, second)], 1)
    out = np.empty(out_at[-1], np.uint8)
    for place, shift in shifts(begin.ravel(), (goes - begin).ravel(), len(data)):
        out[place + shift] = data[place[0] : place[-1] + 1]
    moved = goes[~plain]
    for column, name in enumerate(("prefix", "middle", "suffix")):
        for i, byte in enumerate(MARKS[name]):
            out[moved[:, column] - MARK_BYTES + i] = byte

    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    sizes = [pa.array(characters(data, begin[:, k], end[:, k]), pa.int64(), mask=plain) for k in (0, 1)]
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), *sizes, unflat(out, out_at)]


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that the outputs were made of; null where the marks do not fit the form."""
    data, at = flat(outputs)
    form = np.array([f or "" for f in forms.to_pylist()], object)
    places, text = marks_in(data, at)
    counts = np.bincount(text, minlength=len(form))
    fits = np.isin(form, list(ORDER)) & (counts == len(MARKS))
    three = places[fits[text]].reshape(-1, len(MARKS))
    # marks in the order in which the form has them
    found = np.zeros((len(form), len(MARKS)), np.int64)
    found[fits] = three
    for kind, names in ORDER.items():
        of = fits & (form == kind)
        wanted = np.array([MARKS[name][1] for name in names], np.uint8)
        fits[of] = (data[found[of] + 1] == wanted).all(1) & (found[of, 0] == at[:-1][of]) if of.any() else fits[of]
    plain = form == "plain"
    absent = ~(plain | fits) | np.asarray(outputs.is_null())

    one, two, three = (found[:, k] + MARK_BYTES for k in range(3))
    ends = np.stack([found[:, 1], found[:, 2], at[1:]], 1)
    psm = form == "psm"
    source = np.stack([np.where(psm, one, two), three, np.where(psm, two, one)], 1)
    until = np.stack([np.where(psm, ends[:, 0], ends[:, 1]), ends[:, 2], np.where(psm, ends[:, 1], ends[:, 0])], 1)
    source[plain], until[plain] = at[:-1][plain, None], at[1:][plain, None]
    source[plain, 1:] = until[plain, 1:]
    sizes = np.where((absent & ~plain)[:, None], 0, until - source)
    begin = np.concatenate([[0], np.cumsum(sizes.ravel())])
    text_at = begin[:: len(MARKS)]
    begin = begin[:-1]
    text = np.empty(text_at[-1], np.uint8)
    for place, shift in shifts(begin, source.ravel() - begin, len(text)):
        text[place[0] : place[-1] + 1] = data[place + shift]
    return unflat(text, text_at, absent)


def draws_of(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the digest of seed and key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


#: Columns that ``rearrange`` adds.
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def _mapped(df: DataFrame, kept: list[str], inputs: list[Column], added: str, function) -> DataFrame:
    """``kept`` columns of ``df`` and those that ``function`` makes of the inputs, in slices of few bytes."""
    own = [unused(df, f"fim_in_{i}") for i in range(len(inputs))]
    new = T.StructType.fromDDL(added).fields
    schema = T.StructType([*(df.schema[c] for c in kept), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept)):
                columns = part.columns
                yield pa.RecordBatch.from_arrays([*columns[: len(kept)], *function(*columns[len(kept) :])], names=schema.names)

    return df.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for c, n in zip(inputs, own))).mapInArrow(run, schema)


def rearrange(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``df`` with ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` in code points (null if plain) and ``output``.

    Columns of these names are replaced, all others kept.  A null text is empty and
    so plain; texts of equal keys are cut by the same draws; rows are not shuffled.
    """
    added = T.StructType.fromDDL(ADDED).names
    kept = [c for c in df.columns if c.lower() not in added]

    def function(texts, *draws):
        return rearranged(texts, np.stack([np.asarray(d) for d in draws], 1).reshape(-1, 4), rate, suffix_first)

    return _mapped(df, kept, [text_of(f"`{text}`"), *draws_of(F.col(f"`{key}`"), seed)], ADDED, function)


def restore(df: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """``df`` with ``into``, the text that ``output`` was made of; a column of that name is replaced.

    Null where output or form is null, or the output has not the three marks of its form.
    """
    kept = [c for c in df.columns if c.lower() != into.lower()]
    return _mapped(df, kept, [F.col(f"`{output}`"), F.col(f"`{form}`")], f"`{into}` string", lambda outputs, forms: [restored(outputs, forms)])


def report(df: DataFrame) -> DataFrame:
    """Cuts of every text, the digest of its output, and that of the text restored from it.

    Null texts are empty; equal rows give equal rows; other columns are left out.
    """
    rows = restore(rearrange(df.select("doc_id", "text")).drop("text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH digests AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS h
  FROM digests
), cuts AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n,
    least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
         WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
