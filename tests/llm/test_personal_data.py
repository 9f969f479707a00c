"""Base spans against a plain reading of the patterns; reliabilities and classifier on known truth."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fadeline.llm import personal_data as pii
from fadeline.llm.queries import QUERIES


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The base spans as the contract words them."""
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    )
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, pattern, fits) in enumerate(kinds) for m in re.finditer(pattern, text or "") if fits(m[0])]
    return [s for *_, s in sorted(found)]


PARTS = ["a", "Z9", "@", ".", "-", "+", " ", "(", ")", "1", "25", "255", "256", "0", "4111111111111111", "4111 1111", "1111", "é", "\n", "%", "_", "4929963689861572", ".com", "1.2.3.4"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_base_spans(text):
    got = pii.spans(text, lambda code: 0.0)
    assert [f"{s.kind}:{s.start}:{s.end}" for s in got] == plain(text) and all(s.base for s in got)
    # whatever the model says, base spans stay and others lie beside them
    every = pii.spans(text, lambda code: 1.0)
    assert [f"{s.kind}:{s.start}:{s.end}" for s in every if s.base] == plain(text)
    beside = [s for s in every if not s.base]
    assert not any(a.start < b.end and b.start < a.end for a in beside for b in every if a is not b)


def test_signatures_open_again():
    text = "card: 4111 1111 1111 1111 9 and mail joe (at) site.com"
    for one in pii.candidates(text):
        kind, votes, bits = pii.opened(np.array([pii.signature(text, one)]))
        assert pii.EVERY[kind[0]] == one.kind and tuple(votes[0] - 1) == pii.votes(text, one)
        assert (bits[0] << np.arange(pii.FEATURES)).sum() == pii.features(text, one) and pii.signature(text, one) < pii.SIGNATURES


def test_reliabilities_of_known_labelers():
    rng = np.random.default_rng(5)
    truth = rng.random(60_000) < 0.3
    yes, no = [(0.9, 0.05), (0.7, 0.1), (0.5, 0.2), (0.7, 0.2), (0.6, 0.4)], [(0.05, 0.9), (0.1, 0.5), (0.3, 0.5), (0.2, 0.6), (0.3, 0.3)]
    cast = np.zeros((len(truth), 5), int)
    for j in range(5):
        p = np.where(truth[:, None], yes[j], no[j])
        draw = rng.random(len(truth))
        cast[:, j] = np.where(draw < p[:, 0], 2, np.where(draw < p.sum(1), 0, 1))
    rows, n = np.unique(cast, axis=0, return_counts=True)
    chance, rates, share = pii.reliabilities(rows, n.astype(float))
    assert abs(share - 0.3) < 0.02
    for j in range(5):
        assert np.abs(rates[0, j, [2, 0]] - yes[j]).max() < 0.03 and np.abs(rates[1, j, [2, 0]] - no[j]).max() < 0.03
    by_row = {tuple(r): c for r, c in zip(rows.tolist(), chance)}
    said = np.array([by_row[tuple(r)] for r in cast.tolist()]) >= 0.5
    assert (said == truth).mean() > 0.95


def number_of(rng, good):
    while True:
        number = "4" + "".join(rng.choice("0123456789") for _ in range(15)) if good else "".join(rng.choice("123789") for _ in range(16))
        if luhn(number) == good:
            return number


def texts(seed, n):
    """Texts with numbers that the base patterns miss, and whether they are cards or orders."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        good = rng.random() < 0.5
        cue = rng.choice(["card", "visa", "paid with", "and"] if good else ["order", "invoice", "and", "the"])
        out.append((f"{rng.choice(['so', 'we saw'])} {cue} {number_of(rng, good)} {rng.randint(10000, 99999)} left", good))
    return out


def test_classifier_on_texts_that_were_not_seen(spark):
    model = pii.fit(spark.createDataFrame([(t,) for t, _ in texts(1, 1500)], "text string").repartition(4))
    assert set(model.weights) == {"card"}
    right = 0
    for text, good in texts(2, 1000):
        found = [s for s in pii.spans(text, model.chance) if not s.base]
        right += (len(found) == 1 and text[found[0].start : found[0].end] == re.search("[0-9]{16}", text)[0]) if good else not found
    assert right >= 970
    assert model.rates["card"][0, 1, 2] > 0.9 and model.rates["card"][1, 1, 2] < 0.1  # the checksum is found to be reliable


def test_what_the_method_adds():
    model = pii.trained(np.array([], int), np.array([], int))
    assert pii.spans("joe (at) site.com", model.chance) == []  # nothing was learned, nothing is added
    said = lambda text: [(s.kind, text[s.start : s.end]) for s in pii.spans(text, lambda code: 1.0) if not s.base]
    assert said("write joe (at) site.com now") == [("email", "joe (at) site.com")]
    assert said("tel (283) 555-6500 or so") == [("phone", "(283) 555-6500")]
    assert said("a +1 (283) 555-6500 4041894974608795 b") == [("phone", "+1 (283) 555-6500"), ("card", "4041894974608795")]
    assert said("a +49 170 1234567 99999999 b") == [("phone", "+49 170 1234567")]
    assert said("Dear Mr. Henry Miller,") == [("name", "Henry Miller")]
    assert said("ssn 123-45-6789.") == [("ssn", "123-45-6789")]
    assert said("iban DE89 3704 0044 0532 0130 00 ok")[0] == ("iban", "DE89 3704 0044 0532 0130 00")
    assert said("Der Hund and Das Haus") == []


@pytest.mark.parametrize("piece", ["a", "1", "1.", "1 ", "+1", "@", "a@", "A", "Aa ", "+1 ", "(", "DE89 3704 ", "-"])
def test_long_texts_take_one_look(piece):
    text = piece * (1_000_000 // len(piece))
    begin = time.perf_counter()
    pii.spans(text, lambda code: 0.0)
    assert time.perf_counter() - begin < 8


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "mail a.b@c.de, " + "é" * 50_000 + " 10.0.0.1", "x"), (3, "mail a.b@c.de, " + "é" * 50_000 + " 10.0.0.1", "x"), (None, "+1 (283) 555-6500", None)],
        "doc_id long, text string, spans string",
    )
    model = pii.fit(df)
    out = [(r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in pii.scan(df, model).collect()]
    long = [("email", 5, 13, True), ("ip", 50_016, 50_024, True)]
    assert sorted(out, key=repr) == sorted([(1, []), (2, []), (3, long), (3, long), (None, [("phone", 0, 17, True)])], key=repr)
    clean = pii.redact(df, model)
    assert clean.columns == df.columns
    assert sorted((r.text or "")[:20] for r in clean.collect()) == ["", "", "[phone]", "mail [email], " + "é" * 6, "mail [email], " + "é" * 6]
    empty = df.limit(0)
    assert pii.report(empty).count() == 0 and pii.fit(empty).weights == {}


def test_op13_rows(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op13_personal_data"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = plain(d.text), got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in want) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) if want else True
