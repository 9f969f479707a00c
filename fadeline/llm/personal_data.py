"""Personal data in texts: labelers vote on spans, their reliability is estimated
without labels, and a classifier trained on the outcome decides.

Spans that fit the base patterns are always reported.  Besides these, every text has
candidates: the same patterns read less strictly (a number inside a longer chain of
digits, an address with ``(at)``, a telephone number without ``+``), and numbers and
names of other kinds.  Five labelers vote yes, no or nothing on each candidate: its
form, its checksum or range, gazetteers (top-level domains, issuers, calling codes,
countries, given names), cues in the words before it, and its edges.

Votes and a few features of a candidate are one small whole number, its signature.
Signatures are counted over all candidates of all texts; there are at most
``SIGNATURES`` of them however many texts there are, so their counts fit the driver.
Expectation maximisation on the counts gives each labeler's reliability for each kind
and the chance that a candidate with such votes is personal data.  A logistic
regression per kind on votes and features is then trained towards these chances,
each signature weighing as often as it occurs: nothing is sampled.

Places are code points, ends exclusive.  All patterns read a text once from left to
right; none looks at the same characters again and again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fadeline.llm.text import Bounded, map_texts, slices, text_of

# The base kinds in their order, their patterns and bounds.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CHAIN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MOST_OF_IP = (12, 19), (9, 15), 255

#: Kinds that only the method finds, after the base kinds in all orders.
MORE = ("ssn", "iban", "name")
EVERY = (*KINDS, *MORE)

# Candidates beyond the base patterns.
HIDDEN_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[{]dot[)\]}]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+|at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{2,63}+){1,4}+)",
    re.IGNORECASE,
)
IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
NATIONAL = re.compile(r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
ABROAD = re.compile(r"\+[2-9][0-9]{0,2}+(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4}(?![0-9])|[0-9]{6,10}(?![0-9]))){1,4}")
WITHOUT_PLUS = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAME = re.compile(r"(?<!\w)[A-Z][a-z]{1,20}+(?: [A-Z]\.)? [A-Z][a-z]{1,20}+(?!\w)")
CARD_BLOCKS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}

# Gazetteers.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name io co ai app dev me tv us uk de fr es it nl be ch at pl cz se no fi dk ie pt gr hu ro bg ru ua tr il in cn jp kr au nz ca mx br ar cl za".split()
)
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 234 237 254 351 352 353 358 380 420 421 972".split())
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
GIVEN = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter George Edward "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Maria Laura Julia "
    "Hans Klaus Dieter Wolfgang Stefan Sabine Monika Ursula Petra Heike Pierre Michel Philippe Sophie Camille Claire Juan Carlos Luis Carmen Lucia".split()
)
#: The first digits of issuers' numbers and the lengths that they have.
ISSUERS = re.compile(r"4[0-9]{12}(?:[0-9]{3}){0,2}|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}|62[0-9]{14,17}")
#: Words before a span that speak for its kind, and words that speak against any number.
CUES = {
    "email": r"e-?mail|mail|contact|write to|reply", "ip": r"\bip\b|host|server|addr|client|from", "card": r"card|visa|master|amex|credit|debit|payment",
    "phone": r"phone|\btel|call|mobile|cell|fax|dial|whatsapp", "ssn": r"ssn|social security|\bss#", "iban": r"iban|account|bank|transfer",
    "name": r"\b(?:mrs?|ms|dr|prof)\.? $|name(?: is|:)? $|\bi am $|signed,? $|dear $|regards,? $",
}
CUES = {kind: re.compile(words) for kind, words in CUES.items()}
AGAINST = re.compile(r"version|\bv(?:er)?\.? ?$|release|isbn|order|invoice|serial|sku|\bpart\b|build|checksum|hash|commit|section|chapter|fig(?:ure)?\.? ?$")
CUE_CHARS = 40

LABELERS = ("form", "check", "gazetteer", "context", "edges")
FEATURES = 8
#: More signatures than this there are not.
SIGNATURES = len(EVERY) * 3 ** len(LABELERS) << FEATURES

#: Added spans have this chance at least.
THRESHOLD = 0.9
#: What a labeler is thought to do before any data: chances of yes, nothing, no on personal data and on other spans; and as how many candidates that counts.
BELIEF, BELIEF_ROWS = np.array([[0.60, 0.35, 0.05], [0.15, 0.35, 0.50]]), 20.0
ROUNDS, RIDGE = 100, 1.0


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str
    base: bool


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    doubled = (2 * int(c) for c in number[-2::-2])
    return (sum(int(c) for c in number[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern.  Each ``@`` is looked at once, with the characters since the last one."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        free = at + 1
        if local and (domain := DOMAIN.match(text, at + 1)):
            yield at - local, domain.end()
            free = domain.end()
        at = text.find("@", free)


def in_range(ip: str) -> bool:
    return all(len(part) <= 3 and int(part or 0) <= MOST_OF_IP for part in (p.lstrip("0") for p in ip.split(".")))


def blocks_of(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Numbers of cards inside a chain of digits: a block of 13 to 19, or blocks of usual sizes."""
    blocks = [m.span() for m in re.finditer(r"[0-9]+", text[start:end])]
    for i, (low, high) in enumerate(blocks):
        if 13 <= high - low <= 19:
            yield start + low, start + high
        for n in (3, 4, 5):
            some = blocks[i : i + n]
            if len(some) == n and tuple(b - a for a, b in some) in CARD_BLOCKS:
                yield start + low, start + some[-1][1]


def candidates(text: str) -> list[Candidate]:
    """All spans that the labelers vote on; ``base`` are those of the fixed patterns."""
    found = [Candidate(a, z, "email", True) for a, z in emails(text)]
    lower = text.lower() if len(text.lower()) == len(text) else text
    if any(mark in lower for mark in ("(at)", "[at]", "{at}", " dot ")):
        found += [Candidate(*m.span(), "email", False) for m in HIDDEN_EMAIL.finditer(text)]
    found += [Candidate(*m.span(), "ip", in_range(m[0])) for m in IP.finditer(text)]
    if text.count(":") > 6:
        found += [Candidate(*m.span(), "ip", False) for m in IP6.finditer(text)]
    for m in CHAIN.finditer(text):
        if m.end() - m.start() < CARD_DIGITS[0]:
            continue
        number = digits(m[0])
        fits = CARD_DIGITS[0] <= len(number) <= CARD_DIGITS[1]
        base = fits and luhn(number)
        if fits:
            found.append(Candidate(*m.span(), "card", base))
        if not base:
            found += [Candidate(a, z, "card", False) for a, z in blocks_of(text, *m.span()) if (a, z) != m.span() or not fits]
    for m in PHONE.finditer(text):
        base = PHONE_DIGITS[0] <= sum("0" <= c <= "9" for c in m[0]) <= PHONE_DIGITS[1]
        if base:
            found.append(Candidate(*m.span(), "phone", True))
        elif inner := NATIONAL.match(text, m.start()) or ABROAD.match(text, m.start()):
            number = inner[0]
            while len(digits(number)) > PHONE_DIGITS[1]:
                number = re.sub(r"[ .-]?[^ .-]*$", "", number)
            if len(digits(number)) >= PHONE_DIGITS[0]:
                found.append(Candidate(m.start(), m.start() + len(number), "phone", False))
    if re.search(r"[0-9][.-][0-9]{4}", text):
        found += [Candidate(*m.span(), "phone", False) for m in WITHOUT_PLUS.finditer(text)]
        found += [Candidate(*m.span(), "ssn", False) for m in SSN.finditer(text)]
    found += [Candidate(*m.span(), "iban", False) for m in IBAN.finditer(text)]
    for m in NAME.finditer(text):
        if m[0].split(" ", 1)[0] in GIVEN or CUES["name"].search(before(text, m.start())):
            found.append(Candidate(*m.span(), "name", False))
    return found


def before(text: str, start: int) -> str:
    """The few characters before a place, on its line, in lower case."""
    return text[max(0, start - CUE_CHARS) : start].rsplit("\n", 1)[-1].lower()


def votes(text: str, one: Candidate) -> tuple[int, ...]:
    """1, 0 or -1 of each labeler."""
    span, kind, number = text[one.start : one.end], one.kind, digits(text[one.start : one.end])
    form = check = gazetteer = 0
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        form = 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}", span) else 0
        check = 1 if 6 <= len(span) <= 254 and ".." not in span else -1
        gazetteer = 1 if last in TOP_LEVEL else -1
    elif kind == "ip":
        form = 1 if ":" in span or all(p == "0" or p[0] != "0" for p in span.split(".")) else -1
        check = 1 if ":" in span or in_range(span) else -1
        gazetteer = -1 if ":" not in span and span.split(".", 1)[0].lstrip("0") in ("", "127", "255") else 0
    elif kind == "card":
        form = 1 if span == number or tuple(map(len, re.split("[ -]", span))) in CARD_BLOCKS else -1
        check = 1 if luhn(number) else -1
        gazetteer = 1 if ISSUERS.fullmatch(number) else -1
    elif kind == "phone":
        form = 1 if NATIONAL.fullmatch(span) or ABROAD.fullmatch(span) or WITHOUT_PLUS.fullmatch(span) else 0
        check = 1 if PHONE_DIGITS[0] <= len(number) <= PHONE_DIGITS[1] and number.strip(number[0]) else -1
        gazetteer = 0 if span[0] != "+" else 1 if any(number[:n] in CALLING for n in (1, 2, 3)) else -1
    elif kind == "ssn":
        form = 1
        check = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    elif kind == "iban":
        plain = span.replace(" ", "")
        rest = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97
        check = 1 if rest == 1 else -1
        gazetteer = 1 if IBAN_LENGTHS.get(plain[:2]) == len(plain) else -1
    else:
        gazetteer = 1 if span.split(" ", 1)[0] in GIVEN else 0
    ahead = before(text, one.start)
    context = 1 if CUES[kind].search(ahead) else -1 if kind != "email" and AGAINST.search(ahead) else 0
    left, right = text[one.start - 1 : one.start], text[one.end : one.end + 1]
    glued = left.isalnum() or right.isalnum() or left in tuple("-_/=@.") or right in tuple("-_/=@")
    return form, check, gazetteer, context, -1 if glued else 1


def features(text: str, one: Candidate) -> int:
    """FEATURES bits of a candidate and what surrounds it."""
    span, ahead = text[one.start : one.end], before(text, one.start)
    left, right = text[one.start - 1 : one.start], text[one.end : one.end + 1]
    bits = (
        not left or left.isspace(), not right or right.isspace(), left in tuple("\"'(<["), right in tuple(".,;:!?)>]\"'"),
        any(c in " -.()" for c in span), one.end - one.start >= 16, ahead.rstrip()[-1:] in tuple(":="), bool(re.search(r"[0-9][^\w\s]?\s?$", ahead)),
    )
    return sum(bit << i for i, bit in enumerate(bits))


def signature(text: str, one: Candidate) -> int:
    code = EVERY.index(one.kind)
    for vote in votes(text, one):
        code = 3 * code + vote + 1
    return code << FEATURES | features(text, one)


def opened(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (0 no, 1 nothing, 2 yes) and feature bits of signatures."""
    bits = codes[:, None] >> np.arange(FEATURES) & 1
    rest, out = codes >> FEATURES, []
    for _ in LABELERS:
        out.append(rest % 3)
        rest = rest // 3
    return rest, np.stack(out[::-1], 1).reshape(-1, len(LABELERS)), bits


def reliabilities(cast: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation over votes (0 no, 1 nothing, 2 yes) that occur ``n`` times.

    Gives each row's chance to be personal data, each labeler's chances of no,
    nothing and yes on personal data and on other spans, and the share of personal
    data.  Labelers are independent given the truth; BELIEF counts as BELIEF_ROWS
    candidates, and a labeler says yes on personal data no less often than on others.
    """
    belief = np.repeat(BELIEF[:, None, ::-1], cast.shape[1], axis=1)
    rates, share = belief.copy(), 0.5
    chance = np.full(len(n), share)
    for _ in range(ROUNDS):
        logs = np.log(rates)
        picked = logs[:, np.arange(cast.shape[1]), cast].sum(2)
        new = 1 / (1 + np.exp(np.clip(picked[1] + np.log1p(-share) - picked[0] - np.log(share), -500, 500)))
        moved, chance = np.abs(new - chance).max(initial=0), new
        weight = np.stack([n * chance, n * (1 - chance)])
        seen = np.stack([[np.bincount(cast[:, j], w, 3) for j in range(cast.shape[1])] for w in weight])
        rates = (seen + BELIEF_ROWS * belief) / (weight.sum(1)[:, None, None] + BELIEF_ROWS)
        worse = rates[0, :, 2] < rates[1, :, 2]  # a labeler that would speak for the contrary says nothing
        rates[:, worse] = rates[:, worse].mean(0)
        share = (weight[0].sum() + BELIEF_ROWS / 2) / (n.sum() + BELIEF_ROWS)
        if moved < 1e-9:
            break
    return chance, rates, share


def inputs(cast: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """What the classifier sees: a constant, yes and no of each labeler, the features."""
    return np.hstack([np.ones((len(cast), 1)), cast == 2, cast == 0, bits]).astype(float)


def regression(x: np.ndarray, target: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression towards chances, by Newton steps."""
    weights, penalty = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    loss = lambda w: n @ (np.logaddexp(0, x @ w) - target * (x @ w)) + w @ penalty @ w / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        gradient = x.T @ (n * (p - target)) + penalty @ weights
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        size = 1.0
        while loss(weights - size * step) > loss(weights) and size > 1e-6:
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return weights


class Model(NamedTuple):
    """Per kind: the classifier's weights, each labeler's chances (on personal data
    and on others: no, nothing, yes) and the share of personal data."""

    weights: dict[str, np.ndarray]
    rates: dict[str, np.ndarray]
    share: dict[str, float]

    def chance(self, code: int) -> float:
        """That a candidate of this signature is personal data; 0 for a kind that was not seen."""
        kind, cast, bits = opened(np.array([code]))
        weights = self.weights.get(EVERY[kind[0]])
        return 0.0 if weights is None else float(1 / (1 + np.exp(-np.clip(inputs(cast, bits)[0] @ weights, -500, 500))))


def trained(codes: np.ndarray, n: np.ndarray) -> Model:
    """The model from signatures and how often each occurs."""
    model = Model({}, {}, {})
    kinds, cast, bits = opened(codes)
    for i, kind in enumerate(EVERY):
        of = kinds == i
        if of.any():
            chance, model.rates[kind], model.share[kind] = reliabilities(cast[of], n[of].astype(float))
            model.weights[kind] = regression(inputs(cast[of], bits[of]), chance, n[of].astype(float))
    return model


def signatures(df: DataFrame, column: str = "text") -> DataFrame:
    """signature and n: over all candidates of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    seen.update(signature(text, one) for one in candidates(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["signature", "n"])

    return df.select(text_of(f"`{column}`").alias("text")).mapInArrow(count, "signature long, n long").groupBy("signature").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, column: str = "text") -> Model:
    """The model of the texts of ``df``; null texts have no candidates."""
    rows = signatures(df, column).orderBy("signature").toPandas()  # SIGNATURES rows at most
    return trained(rows["signature"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    base: bool
    score: float


def spans(text: str | None, chance) -> list[Span]:
    """Base spans, and candidates with a chance of THRESHOLD or more that lie beside
    them; of candidates that overlap the likeliest stays, then the longest, then the first.
    By start, then kind."""
    if not text:
        return []
    found = [Span(one.start, one.end, one.kind, one.base, chance(signature(text, one))) for one in candidates(text)]
    kept = [s for s in found if s.base]
    added = [s for s in found if not s.base and s.score >= THRESHOLD]
    if added:
        taken = apart(sorted((s.start, s.end) for s in kept))
        added = [s for s in added if not overlaps(taken, s)]
        chosen: list[tuple[int, int]] = []
        for s in sorted(added, key=lambda s: (-s.score, s.start - s.end, s.start)):
            if not overlaps(chosen, s):
                kept.append(s)
                insort(chosen, (s.start, s.end))
    return sorted(kept, key=lambda s: (s.start, EVERY.index(s.kind), s.end))


def apart(sorted_spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap made one; base spans of different kinds may lie in one another."""
    out: list[tuple[int, int]] = []
    for start, end in sorted_spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def overlaps(taken: list[tuple[int, int]], s: Span) -> bool:
    """``taken`` is sorted and its spans lie apart."""
    at = bisect_left(taken, (s.end,))
    return at > 0 and taken[at - 1][1] > s.start


SPAN_TYPE = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
REMEMBERED = 100_000


def scan(df: DataFrame, model: Model, column: str = "text", into: str = "spans") -> DataFrame:
    """``df`` with ``into``, the spans of ``column`` in order; a null text has none.

    A column named as ``into`` is replaced, all others are kept.
    """

    def make():
        chance = Bounded(model.chance, REMEMBERED)
        return lambda texts: (([{"kind": s.kind, "start": s.start, "end": s.end, "base": s.base, "score": s.score} for s in spans(t, chance.__getitem__)],) for t in texts)

    return map_texts(df, column, make, {into: (SPAN_TYPE, SPAN_ARROW)})


def redact(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``df`` with each span of ``column`` replaced by its kind in brackets; spans
    that overlap are one, named after the first.  A null text stays null."""

    def masked(text: str | None, chance) -> str | None:
        out, at = [], 0
        for s in spans(text, chance):
            if s.start >= at:
                out += [text[at : s.start], f"[{s.kind}]"]
            at = max(at, s.end)
        return "".join([*out, text[at:]]) if out else text

    def make():
        chance = Bounded(model.chance, REMEMBERED)
        return lambda texts: ((masked(t, chance.__getitem__),) for t in texts)

    return map_texts(df, column, make, {column: ("string", pa.string())}).select(*(f"`{c}`" for c in df.columns))


def report(df: DataFrame) -> DataFrame:
    """Per row the number of base spans of each kind, the digest of these, and all
    spans as text.  Null and empty texts have none; repeated rows are alike; other
    columns are left out."""
    docs = df.select("doc_id", "text")
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return scan(docs, fit(docs)).select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
