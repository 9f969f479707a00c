"""Counts of texts against plain Python, and the line rules on small texts."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fadeline.llm import quality
from fadeline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


def test_op7_rows(spark, sf_dir):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op7_quality"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert {k: r[k] for k in plain("")} == plain(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_good_documents_stay_and_junk_goes(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op7_quality"](spark, sf_dir).join(labels, "doc_id").filter(~F.col("base_failed"))
    counts = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) == 0


def verdicts(spark, *lines):
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    return quality.clean_lines(df).first().line_report


def test_each_rule(spark):
    good = "This is a line of plain words, and it ends."
    assert verdicts(spark, "यह एक साधारण वाक्य है।", "هل هذه جملة عادية؟").n_removed == 0
    bad = [
        "Home Products About Contact", "a. | b | c | d | e", "x### y$$$ z%%% . w***", "THIS IS ALL VERY LOUD.", "so!! very!! loud!! it is.",
        "one one one one one two.",
    ]
    report = verdicts(spark, good, *bad, "", good)
    assert report.cleaned == f"{good}\n\n{good}"
    assert (report.n_lines, report.n_removed) == (8, 6)
    assert not report.kept
    assert verdicts(spark, *[good] * 9, bad[0]).kept


def boiler_corpus():
    """400 documents: a footer of two lines below half of them, a long passage in many,
    60 copies and 80 near copies of one text, and a line in few documents."""
    chance = random.Random(4)
    sentence = lambda n: " ".join("".join(chance.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."
    footer, passage, rare = ["Tous droits réservés.", "Contactez nous ici."], sentence(40), "Rare."
    docs = []
    for i in range(400):
        lines = [sentence(chance.randint(8, 25)) for _ in range(12)]
        if i % 2:
            lines += footer
        if i % 3 == 0:
            lines.insert(3, passage)
        if i % 20 == 0:
            lines.insert(5, rare)
        docs.append("\n".join(lines))
    base = [sentence(12) for _ in range(12)]
    docs += ["\n".join(base)] * 60
    for _ in range(80):
        own = list(base)
        own[chance.randrange(12)] = sentence(12)
        docs.append("\n".join(own))
    return docs, footer


def test_boilerplate_is_what_different_documents_share(spark):
    docs, footer = boiler_corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    frequent = quality.frequent_lines(df)
    hashes = {r.h: r.line for r in spark.createDataFrame([(line,) for d in docs for line in d.split("\n")], "line string").select("line", quality.line_hash(F.col("line")).alias("h")).distinct().collect()}
    assert sorted(hashes[h] for h in frequent) == sorted(footer)
    cleaned = {r.doc_id: r.line_report for r in quality.clean_lines(df, frequent=frequent).collect()}
    for i, text in enumerate(docs):
        assert cleaned[i].cleaned == "\n".join(line for line in text.split("\n") if line not in footer)
    assert all(r.kept for r in quality.report(df).collect())
    # as plain counting has it
    lines = spark.createDataFrame([(line,) for line in {line for d in docs for line in d.split("\n")}], "line string")
    hashed = {r.line: (r.one, r.two) for r in lines.select("line", *(F.xxhash64(F.lit(k), "line").alias(n) for k, n in ((1, "one"), (2, "two")))).collect()}
    where = defaultdict(Counter)
    for text in docs:
        own = set(text.split("\n"))
        for line in own:
            where[line][min(hashed[x][0] for x in own), min(hashed[x][1] for x in own)] += 1
    assert {line for line, by in where.items() if len(line.split()) <= 20 and len(by) >= 50 and max(by.values()) <= 0.2 * sum(by.values())} == set(footer)
    # a document of nothing else goes, one with a line of its own stays
    short = spark.createDataFrame([(1, "\n".join(footer)), (2, footer[0] + "\nSo it is."), (3, footer[0] + "\nNo end"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.line_report.kept for r in quality.clean_lines(short, frequent=frequent).collect()} == {1: False, 2: True, 3: False, 4: True}
    assert quality.frequent_lines(df.limit(40)) == [] and quality.frequent_lines(df.limit(0)) == []


def test_odd_rows(spark):
    text = "\x0b\x0c word word x \r\n\n" + "é" * 70_000
    again = " ".join(map(str, range(9)))
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, text), (4, f"{again} {again}"), (5, "a b c d e f g h " * 3000), (None, "x")], "doc_id long, text string").withColumn("line_report", F.lit("mine"))
    got = quality.report(df).collect()
    assert len(got) == 7
    texts = {1: "", 2: "", 3: text, 4: f"{again} {again}", 5: "a b c d e f g h " * 3000, None: "x"}
    for r in got:
        assert {k: r[k] for k in plain("")} == plain(texts[r.doc_id])
    assert quality.report(df.limit(0)).count() == 0
    assert not quality.clean_lines(df).filter("doc_id = 1 and not line_report.kept").count()


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = QUERIES["op7_quality"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_characters_are_counted_without_a_look_up_for_each(spark):
    """translate() looks every character up; marks that mean something in a class of characters are marks."""
    text = "a^b [c] d-e \\ #*$%&&|<>~{} é·»› 𝒳\n\t x"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = df.select(*(quality.count_of(F.col("text"), s).alias(str(i)) for i, s in enumerate((quality.SYMBOLS, "^-]\\", "»›•·")))).first()
    assert tuple(found) == (9, 4, 3)
    counted = quality.report(df)
    assert [r["word_chars"] for r in counted.orderBy("doc_id").collect()] == [len("".join(text.split())), 0]
    assert "translate(" not in counted._jdf.queryExecution().toString()
