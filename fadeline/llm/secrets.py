"""Secrets in texts: fixed patterns, and literals that end in sensitive names.

The patterns find secrets by their look.  The lexer finds more by their use: it
reads assignments of source code and configuration files (``name = "literal"``,
``"name": literal``, ``name: type = literal``, ``name := other``, ``a = b = "literal"``)
into pairs of a name and what it is given: strings with prefixes, in one or three
quotes, joined by ``+`` or standing side by side, a literal without quotes, or other
names.

A second pass follows names.  A name on the right stands for what it was given last
before, or first after if it was not given anything before, so a constant is followed
to the name in which it ends.  A value is scored by the most sensitive name that it
reaches and by the look of all its parts together; from THRESHOLD on each part is a
secret, wherever it was written.

Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fadeline.llm.text import map_texts

# The base patterns, the shortest match each, and their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of names and how surely their literals are secrets.
SENSITIVE = {
    "password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.5, "secret": 0.6, "token": 0.5, "apikey": 0.6, "api_key": 0.6, "api-key": 0.6,
    "private_key": 0.6, "privatekey": 0.6, "access_key": 0.6, "accesskey": 0.6, "credential": 0.5, "auth_key": 0.5, "signing_key": 0.5,
}
THRESHOLD = 0.8

#: A name or its quoted form, and an assignment sign; between them may be a type.
#: A name begins where a run of its characters does and nothing is given back, so no
#: character is looked at from several places.
HEAD = re.compile(
    r"""(?P<q>["']?)(?<![\w.-])(?P<name>[\w.-]++)(?P=q)[ \t]*+"""
    r"""(?:\??:[ \t]*+[A-Za-z_&*](?:[\w.]|::)*+(?:[ \t]*+[\[<|](?:[^=:\n"']|::)*+)?+\??[ \t]*+=(?![=>])|:=|=>|[:=])[ \t]*+""",
    re.ASCII,
)
#: A string with its prefix, in one or three quotes.
STRING = re.compile(
    r"""(?:[rbuf]|br|rb|fr|rf)?(?:\"{3}(?P<a>[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*)\"{3}|'{3}(?P<b>[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*)'{3}"""
    r"""|"(?P<c>[^"\\\n]*(?:\\[^\n][^"\\\n]*)*)"|'(?P<d>[^'\\\n]*(?:\\[^\n][^'\\\n]*)*)')""",
    re.ASCII | re.IGNORECASE | re.DOTALL,
)
BARE = re.compile(r"""[^\s"',;(){}\[\]<>]++""", re.ASCII)
NAME = re.compile(r"[A-Za-z_][\w.-]*+", re.ASCII)
#: ``b = `` where a value is expected: an assignment in an assignment.
CHAIN = re.compile(r"([A-Za-z_][\w.-]*+)[ \t]++=[ \t]++(?!=)", re.ASCII)
OPEN = re.compile(r"\(\s*")
PLUS = re.compile(r"\s*+(?:\\\n\s*+)?\+\s*+(?:\\\n\s*+)?(?![+=])")
#: Strings side by side are one, over lines after a backslash or inside parentheses.
BESIDE, BESIDE_OPEN = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)?"), re.compile(r"\s*+(?:\\\n\s*+)?")


class Assignment(NamedTuple):
    name: str
    literals: list[tuple[int, int]]
    names: list[str]  # of one name alone, its own place is in literals if nothing is given to it
    parts: list[tuple[int, int] | str]  # literals and names in their order
    chained: bool = False


def value(text: str, at: int) -> tuple[list[tuple[int, int] | str], int, tuple[int, int] | None]:
    """Literals and names that are joined from here, the end, and the place of the last name."""
    parts: list[tuple[int, int] | str] = []
    opened = OPEN.match(text, at)
    at, end, place = opened.end() if opened else at, at, None
    while True:
        if m := STRING.match(text, at):
            parts.append(m.span(m.lastgroup))
        elif m := BARE.match(text, at):
            close = m.end() - (m[0][-1] == "+" and STRING.match(text, m.end()) is not None)
            if NAME.fullmatch(text, at, close):
                parts.append(text[at:close])
                place = (at, close)
            elif close > at:
                parts.append((at, close))
            end = close if close > at else m.end()
        else:
            return parts, end, place
        end = m.end() if m.re is STRING else end
        beside = (BESIDE_OPEN if opened else BESIDE).match(text, end)
        if m.re is STRING and STRING.match(text, beside.end()):
            at = beside.end()
        elif plus := PLUS.match(text, end):
            at = plus.end()
        else:
            return parts, end, place


def assignments(text: str) -> list[Assignment]:
    found, at = [], 0
    while head := HEAD.search(text, at):
        at = head.end()
        if chain := CHAIN.match(text, at):
            found.append(Assignment(head["name"], [], [chain[1]], [chain[1]], True))
            continue
        parts, at, place = value(text, at)
        if not parts:
            continue
        names = [p for p in parts if isinstance(p, str)]
        literals = [p for p in parts if not isinstance(p, str)]
        found.append(Assignment(head["name"], literals if len(parts) > 1 or not names else [place], names, parts))
    return found


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    secret: int  # where the secret itself begins


def base_spans(text: str, lower: str) -> list[Span]:
    """Matches of the fixed patterns, each kind without overlaps from the left."""
    found = []
    if any(name in lower for name in ASSIGN_NAMES):
        found += [Span(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [Span(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def look(characters: Counter) -> float:
    """0 to 0.4: length, mixed characters and entropy of a literal with these characters."""
    n = characters.total()
    if n < 8 or any(not c.isascii() or c.isspace() for c in characters):
        return 0.0
    kinds = sum(any(fits(c) for c in characters) for fits in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    entropy = -sum(k / n * math.log2(k / n) for k in characters.values())
    return 0.1 * (kinds >= 2) + 0.1 * (kinds >= 3) + 0.1 * (entropy >= 2.5) + 0.1 * (entropy >= 3.2)


def sensitivity(name: str) -> float:
    name = name.lower()
    return max((weight for part, weight in SENSITIVE.items() if part in name), default=0.0)


def lexed_spans(text: str, lower: str) -> list[Span]:
    """Literals that reach a sensitive name."""
    if not any(part in lower for part in SENSITIVE):
        return []
    found = assignments(text)
    given: dict[str, list[int]] = {}
    for i, one in enumerate(found):
        given.setdefault(one.name, []).append(i)

    def source(i: int, name: str) -> int | None:
        """Where a name got what it is in assignment ``i``: last before, else first after."""
        places = given.get(name, [])
        at = bisect_left(places, i)
        later = next((j for j in places[at : at + 2] if j != i), None)
        return places[at - 1] if at and not (found[i].chained and later is not None) else later

    ends: dict[int, int | None] = {}

    def end_of(j: int | None) -> int | None:
        """The assignment that ``j`` stands for while it is one other name; None for names that only lead to one another."""
        path = []
        while j is not None and j not in ends:
            ends[j] = None
            path.append(j)
            k = source(j, found[j].names[0]) if len(found[j].parts) == 1 and found[j].names else None
            if k is None:
                ends[j] = j
                break
            j = k
        for i in path:
            ends[i] = ends[j]
        return None if j is None else ends[j]

    counted: dict[tuple[int, int], Counter] = {}

    def characters(place: tuple[int, int]) -> Counter:
        if place not in counted:
            counted[place] = Counter(text[slice(*place)])
        return counted[place]

    def joined(i: int) -> Counter:
        """The characters of the whole value; names in it are followed while they stand for one other name."""
        whole = Counter()
        for part in found[i].parts:
            j = end_of(source(i, part)) if isinstance(part, str) else None
            for place in [part] if not isinstance(part, str) else [] if j is None else found[j].literals:
                whole.update(characters(place))
        return whole

    reached: dict[tuple[int, int], float] = {}
    best: dict[int, tuple[float, float]] = {}
    todo = [(i, weight, 0.0) for i, one in enumerate(found) if (weight := sensitivity(one.name))]
    while todo:
        i, weight, whole = todo.pop()
        known = best.get(i, (0.0, -1.0))
        new = max(known[0], weight), max(known[1], whole)
        if new == known:
            continue
        best[i] = new
        one = found[i]
        sources = [j for name in one.names if (j := source(i, name)) is not None]
        if len(one.parts) > 1:
            new = new[0], max(new[1], look(joined(i)))
        if len(one.parts) > 1 or not sources:  # a name alone that nothing is given to is a literal
            for start, end in one.literals:
                score = new[0] + max(new[1], look(characters((start, end))))
                if end > start:
                    reached[start, end] = max(score, reached.get((start, end), 0.0))
        todo += [(j, *new) for j in sources]
    return [Span(start, "literal", end, start) for (start, end), score in reached.items() if score >= THRESHOLD]


def spans(text: str | None) -> list[Span]:
    """All spans by start, then kind: the fixed ones in their order, then literals
    that no fixed one covers."""
    if not text:
        return []
    lower = text.lower()
    base = base_spans(text, lower)
    more = lexed_spans(text, lower)
    if more:
        by_start = sorted((b.start, b.end) for b in base)
        furthest = list(accumulate((end for _, end in by_start), max, initial=0))
        more = [s for s in more if furthest[bisect_left(by_start, (s.start + 1,))] < s.end]
    order = {kind: i for i, kind in enumerate((*KINDS, "literal"))}
    return sorted(base + more, key=lambda s: (s.start, order[s.kind], s.end))


def redacted(text: str | None, found: list[Span], mark: str = "[secret]") -> str | None:
    """The text with ``mark`` in place of each secret; secrets that overlap are one."""
    if not found:
        return text
    out, at = [], 0
    for start, end in sorted((s.secret, s.end) for s in found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, column: str = "text", into: str = "spans") -> DataFrame:
    """``df`` with ``into``, the spans of secrets in ``column``; a null text has none.

    A column named as ``into`` is replaced, all others are kept.
    """

    def make():
        return lambda texts: (([{"kind": s.kind, "start": s.start, "end": s.end} for s in spans(t)],) for t in texts)

    return map_texts(df, column, make, {into: (SPAN_TYPE, SPAN_ARROW)})


def redact(df: DataFrame, column: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with each secret in ``column`` replaced by ``mark``; a null text stays null."""

    def make():
        return lambda texts: ((redacted(t, spans(t), mark),) for t in texts)

    return map_texts(df, column, make, {column: ("string", pa.string())}).select(*(f"`{c}`" for c in df.columns))


def report(df: DataFrame) -> DataFrame:
    """Per row the number of spans of each fixed kind, and the spans as text.

    Null and empty texts have none; repeated rows are alike; other columns are left out.
    """
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    return scan(df.select("doc_id", "text")).select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
