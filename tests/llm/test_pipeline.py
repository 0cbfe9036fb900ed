"""The pipeline stage by stage: each works on what the one before kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from tallyweave.llm import compression_langid, quality_llr
from tallyweave.llm.entries import tokenizer_path
from tests.llm.conftest import SF_DIR
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_packing import check as check_pack
from tests.llm.test_packing import truth

ODD = [(9000, None, "en", "src0", 0), (9001, "", None, None, 0), (9002, "x " * 3000, "en", "src1", None), (9003, "!!!", "xx", "", 3)]


def test_every_stage(spark, docs):
    odd = spark.createDataFrame(ODD, docs.schema)
    now = docs.unionByName(odd).withColumn("kept", F.lit(1)).withColumn("score", F.lit("s")).cache()
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "quality", "near_duplicates", "mixing", "packing"]
    rows = {r["doc_id"]: r for r in now.collect()}

    learned = tuple(compression_langid.learn_dictionaries(now))
    got = steps["language"](spark, now, SF_DIR).cache()
    assert got.columns == now.columns
    want = set()
    for k, r in rows.items():
        lang, score = compression_langid.classify_text(r["text"], learned)
        if lang != "und" and score >= compression_langid.MARGIN:
            want.add(k)
    assert {r["doc_id"] for r in got.collect()} == want and 9000 not in want and len(want) > 150

    before, got = got, steps["quality"](spark, got, SF_DIR).cache()
    judged = quality_llr.judge_quality(
        before.drop("kept", "score"),
        quality_llr.bucket_ratios(before, "text", spark.read.parquet(SF_DIR + "/labels.parquet").where("quality = 1").select("doc_id"), "doc_id"),
    )
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in judged.collect() if r["kept"]}
    assert got.columns == now.columns and 9002 not in {r["doc_id"] for r in got.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(SF_DIR + "/labels.parquet").collect()}
    good = {k for k in want if labels.get(k) == 1 and len((rows[k]["text"] or "").split()) >= 50}
    assert len(good - {r["doc_id"] for r in got.collect()}) <= 0.02 * len(good)

    before, got = got, steps["near_duplicates"](spark, got, SF_DIR).cache()
    want = brute_kept([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in got.collect()} == want and got.columns == now.columns and 177 not in want

    before, got = got, steps["mixing"](spark, got, SF_DIR).cache()
    copies = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    given = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    from tallyweave.llm.cube_mixing import mix

    mixed = mix(before, keep=["doc_id", "source"]).collect()
    check_mix(mixed, given)
    assert copies == {r["doc_id"]: r["copies"] for r in mixed if r["copies"]} and got.columns == now.columns

    packed = steps["packing"](spark, got, SF_DIR).collect()
    ids = {}
    taken = got.collect()
    for r, i in zip(taken, truth([r["text"] for r in taken])):
        ids.setdefault(r["doc_id"], []).append(i)
    assert check_pack(packed, ids) < 0.1


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 50 and {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)


def test_empty_table(spark, docs, tmp_path):
    now = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF_DIR)
        assert now.count() == 0
        now = spark.createDataFrame([], now.schema)
