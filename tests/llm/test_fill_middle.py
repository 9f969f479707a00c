"""Rearranged texts against a plain reading of the rules, and the way back."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from fadeline.llm import fill_middle
from fadeline.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), out


def run(texts, ids):
    draws = np.array([[int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[k : k + 8], 16) for k in range(0, 32, 8)] for i in ids], np.int64).reshape(-1, 4)
    made = fill_middle.rearranged(pa.array(texts, pa.string()), draws, fill_middle.RATE, fill_middle.SUFFIX_FIRST)
    return list(zip(*(c.to_pylist() for c in made))), fill_middle.restored(made[4], made[1]).to_pylist()


PARTS = ["a", "é", "漢字", " ", "\n", "\t\x0b", " ", "<", ">", "P", "<P>", "<S", "<M", "<", "word", "😀", "\x00", "\x1f"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.lists(st.sampled_from(PARTS), max_size=20).map("".join)), max_size=12), st.sampled_from([1, 3, 1 << 20]))
def test_every_batch_against_plain_strings(docs, block):
    fill_middle.BLOCK, kept = block, fill_middle.BLOCK
    try:
        made, back = run([t for _, t in docs], [i for i, _ in docs])
    finally:
        fill_middle.BLOCK = kept
    assert made == [plain(i, t) for i, t in docs]
    assert back == [t for _, t in docs]


def test_slices_nulls_and_large_strings():
    texts = [None, "a b c", "", " x\n", "é é é é"]
    whole = pa.array(texts, pa.string())
    for array in (whole, whole.cast(pa.large_string())):
        data, at = fill_middle.flat(array.slice(1, 3))
        assert (bytes(data), at.tolist()) == (b"a b c x\n", [0, 5, 5, 8])
        data, at = fill_middle.flat(array)
        assert bytes(data) == "a b c x\né é é é".encode() and at.tolist() == [0, 0, 5, 5, 8, 19]
    assert [c.to_pylist() for c in fill_middle.rearranged(pa.array([], pa.string()), np.zeros((0, 4), np.int64), 50, 80)] == [[]] * 5


def test_outputs_that_do_not_fit_are_null():
    forms = ["psm", "spm", "psm", "other", None, "plain", "psm", "psm"]
    outputs = ["<P>a<S>b<M>c", "<P>a<S>b<M>c", "<P>a<S>b", "x", "x", "as it is", None, "y<P>a<S>b<M>c"]
    assert fill_middle.restored(pa.array(outputs), pa.array(forms)).to_pylist() == ["acb", None, None, None, None, "as it is", None, None]


def test_odd_rows_and_clashing_columns(spark):
    long = "wort é " * 200_000
    schema = "doc_id long, text string, form int, output string, N string, fim_in_0 string, restored int"
    data = [(None, "a b c", 7, "o", "n", "f", 1), (2, None, 7, None, "n", "f", 1), (2, "", 7, "o", "n", "f", 1), (8, long, 7, "o", "n", "f", 1), (8, long, 7, "o", "n", "f", 1)]
    df = spark.createDataFrame(data, schema)
    out = fill_middle.restore(fill_middle.rearrange(df)).collect()
    assert sorted((r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == sorted((d or 0, *plain(d, t)) for d, t, *_ in data)
    assert all(r.restored == (r.text or "") and r.fim_in_0 == "f" for r in out)
    assert fill_middle.rearrange(df).columns == ["doc_id", "text", "fim_in_0", "restored", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_middle.report(df.limit(0)).count() == 0


def test_parameters(spark):
    df = spark.createDataFrame([(i, "a b c d e") for i in range(200)], "doc_id long, text string")
    forms = lambda **k: {r.form for r in fill_middle.rearrange(df, **k).select("form").distinct().collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, suffix_first=0) == {"psm"} and forms(rate=100, suffix_first=100) == {"spm"}
    assert fill_middle.rearrange(df, seed=1).select("output").collect() != fill_middle.rearrange(df, seed=2).select("output").collect()


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_op11_rows(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_fill_middle"](spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(docs)
    for d in docs:
        n, form, prefix, middle, out = plain(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
