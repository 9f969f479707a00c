"""The index against all cosines, and scores of held-out documents."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fadeline.llm import toxicity
from fadeline.llm.queries import QUERIES


def test_nearest_are_those_of_all_examples():
    chance = random.Random(3)
    for case in range(60):
        n_features, n = chance.randint(1, 12), chance.randint(1, 300)

        def vector():
            features = sorted(chance.sample(range(n_features), chance.randint(1, min(4, n_features))))
            weights = np.array([chance.choice([1.0, 2.0, chance.random()]) for _ in features])
            return np.array(features), weights / math.sqrt(float(weights @ weights))

        vectors = [vector() for _ in range(n)]
        index = toxicity.BlockMaxIndex(vectors, n_features, block=chance.choice([1, 4, 64]))
        for _ in range(10):
            features, weights = vector()
            k, without = chance.randint(1, 20), chance.randint(-1, n - 1)
            products = [sum(w * dict(zip(f, x)).get(q, 0.0) for q, w in zip(features, weights)) for f, x in vectors]
            want = sorted((p for e, p in enumerate(products) if p > 0 and e != without), reverse=True)[:k]
            got = index.nearest(features, weights, k, without)
            np.testing.assert_allclose([s for s, _ in got], want)
            assert all(math.isclose(products[e], s) and e != without for s, e in got)
            assert len({e for _, e in got}) == len(got)


def test_shares_rise():
    raw, share = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 0, 1]))
    assert list(raw) == sorted(raw) and list(share) == sorted(share) and 0 < share.min() and share.max() < 1


def test_only_rows_that_are_not_held_out_teach(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.report(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above > 0.85
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def made(spark, n=300):
    rows = [(i, ("fine words here " * 3) + ("vile dreck" if i % 5 == 0 else f"topic{i % 7}"), int(i % 5 == 0)) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_evidence_and_odd_rows(spark):
    docs, labels = made(spark)
    more = spark.createDataFrame([(None, None), (1000, ""), (1000, ""), (1001, "a Vile! DRECK " + "x " * 50_000), (1002, "nothing of it")], "doc_id long, text string")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5000, None), (5, 1), (5, 1)], "doc_id long, toxic int"))
    documents = docs.unionByName(more).withColumns({"score": F.lit("mine"), "label": F.lit(1)})
    got = toxicity.report(documents, labels).collect()
    assert len(got) == 305
    by_id = {r.doc_id: r for r in got}
    assert by_id[1001].predicted == 1 and all(i % 5 == 0 for i in by_id[1001].neighbours) and len(by_id[1001].neighbours) == toxicity.NEIGHBOURS
    assert by_id[1000].predicted == by_id[1002].predicted == by_id[None].predicted == 0 and by_id[1000].neighbours == []
    kept = toxicity.without_toxic(documents, labels)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_terms_of_either_label_are_features(spark):
    """Label 1 in under half of a term's examples, label 0 in all of them, and more terms than a few thousand."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = " ".join("z" + letters[i // 676] + letters[i // 26 % 26] + letters[i % 26] for i in range(5_000))
    rows = [(i, "plain " + ("calm " if i % 10 else many) + (" murky" if i % 10 == 0 or i % 10 < 3 else ""), int(i % 10 == 0)) for i in range(600)]
    examples = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs, labels = examples.select("doc_id", "text"), examples.select("doc_id", F.col("label").alias("toxic"))
    model = toxicity.fit(docs, labels)
    features = model.features
    assert {"murky", "calm"} <= set(features) and "plain" not in features
    assert len(set(features)) == len(features) > 5_000
    assert len(model.ids) == examples.filter(~toxicity.held_out()).count()
    clean = spark.createDataFrame([(1000, "so calm")], "doc_id long, text string")
    got = toxicity.score(clean, model).first()
    assert got.predicted == 0 and len(got.neighbours) == toxicity.NEIGHBOURS and all(i % 10 for i in got.neighbours)


def test_without_labels(spark):
    docs, labels = made(spark, 20)
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity.report(docs, none).collect()} == {0}
    assert toxicity.report(docs.limit(0), labels).count() == 0
