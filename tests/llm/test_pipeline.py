"""The stages on given documents, each against what it should do alone."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from fadeline.llm import byte_bpe, mixing, near_duplicates, secrets, toxicity
from fadeline.llm.queries import BYTE_BPE

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage."""
    from fadeline.session import staged

    rows, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(rows)
    for _, stage in corpus_pipeline.STAGES:
        rows = staged(stage(spark, rows, FOLDER))
        out.append(rows)
    return out


def test_stages_and_columns(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "byte_bpe"]
    assert all(rows.columns == kept[0].columns for rows in kept[:-1])


def test_each_decision_takes_effect(spark, kept):
    documents, clean, distinct, masked, mixed, encoded = kept
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in toxicity.report(documents, labels).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, p in predicted.items() if not p)
    stay = [r.doc_id for r in near_duplicates.report(clean).collect() if r.kept]
    before = {r.doc_id: r for r in distinct.collect()}
    assert sorted(stay) == sorted(before)
    after = masked.collect()
    assert sorted(r.doc_id for r in after) == sorted(before)
    for r in after:
        assert r.text == secrets.redacted(before[r.doc_id].text, secrets.spans(before[r.doc_id].text)) and r.n_chars == len(r.text)
    assert any(r.text != before[r.doc_id].text for r in after)
    copies = Counter({r.doc_id: r.copies for r in mixing.report(masked).collect()})
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    ranks = byte_bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in after}
    rows = encoded.collect()
    assert Counter(r.doc_id for r in rows) == +copies
    for r in rows:
        assert list(memoryview(bytes(r.ids)).cast("I")) == library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens * 4 == len(r.ids) and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, FOLDER)
        assert rows.count() == 0
