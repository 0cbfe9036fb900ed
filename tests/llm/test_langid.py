"""Language identification by compression: accuracy on held-out texts and odd rows."""

import os

from pyspark.sql import functions as F

from tallyweave.llm import compression_langid as m
from tallyweave.llm import entries
from tests.llm.conftest import SF_DIR


def test_accuracy_on_held_out_documents(spark):
    sf = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    truth = {r["doc_id"]: r for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    got = entries.QUERIES["op6_compression_langid"](spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"] and len(truth[r["doc_id"]]["text"].split()) >= 20]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.95 * len(held) > 200
    assert all(0 <= r["score"] <= 1 for r in got)


ODD = [(1, None), (2, ""), (3, "12 !! \n"), (4, "the of and"), (4, "the of and"), (5, "le la du " * 50000), (6, "中"), (7, "x")]


def test_odd_rows_and_few_languages(spark):
    frame = spark.createDataFrame(ODD, "doc_id int, text string").withColumn("score", F.lit("s")).withColumn("_doc", F.lit(0))
    en, fr = ("en", b"the of and with that " * 40), ("fr", "le la du des été ".encode() * 40)
    got = m.classify(frame, [en, fr]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) and got[0].asDict().keys() == {"doc_id", "text", "_doc", "lang_pred", "score"}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[1]["score"] == 0
    assert by[4]["lang_pred"] == "en" and by[5]["lang_pred"] == "fr" and by[4]["score"] > 0.1
    assert {r["lang_pred"] for r in m.classify(frame, []).collect()} == {"und"}
    alone = {r["doc_id"]: r for r in m.classify(frame, [en]).collect()}
    assert alone[4]["lang_pred"] == "en" and 0 < alone[4]["score"] <= 1
    assert sorted(r["doc_id"] for r in m.confident(m.classify(frame, [en, fr])).collect()) == [4, 4, 5]
    assert m.classify(frame.limit(0), [en]).count() == 0


def test_learning_from_odd_rows(spark):
    long = " ".join(f"w{i * i}" for i in range(900))
    rows = [(long, "en"), (long, "en"), (None, "en"), ("x", None), ("", "de"), ("ab" * 9, "fr")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    learned = m.learn_dictionaries(frame, dictionary_bytes=1500)
    assert [n for n, _ in learned] == ["en", "fr"] and len(learned[0][1]) == 1500
    assert m.learn_dictionaries(frame.limit(0)) == []
    assert learned == m.learn_dictionaries(frame.repartition(3), dictionary_bytes=1500)


def test_copies_do_not_empty_a_dictionary(spark):
    """Thirty texts of a thousand characters, each a thousand times: rates taken from all of it draw nothing."""
    texts = [(" ".join(f"t{i}w{j * j}" for j in range(200))[:1000], lang) for lang in ("aa", "bb", "cc", "dd") for i in range(30)]
    frame = spark.createDataFrame([(lang + t[2:], lang) for t, lang in texts], "text string, lang string")
    many = frame.crossJoin(spark.range(1000)).drop("id")
    once = m.learn_dictionaries(frame, dictionary_bytes=1500)
    assert [(n, len(c)) for n, c in once] == [(n, 1500) for n in ("aa", "bb", "cc", "dd")]
    assert m.learn_dictionaries(many, dictionary_bytes=1500) == once
    assert [n for n, _ in m.learn_dictionaries(many, dictionary_bytes=8)] == ["aa", "bb", "cc", "dd"]
