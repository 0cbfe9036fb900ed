"""URL filter, quality rules and multiset fingerprints against plain Python."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import entries
from tallyweave.llm.multiset_hash import combine, fingerprint_edits, fingerprints
from tallyweave.llm.quality_llr import bucket_ratios, judge_quality
from tallyweave.llm.url_filter import Rule, bloom_blocks, block_count, canonical, judge_urls, with_bloom_hit
from tests.llm.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ urls
def test_urls_match_the_sql_text(spark):
    ours = {r["page_id"]: r for r in entries.QUERIES["op5_url_filter"](spark, SF_DIR).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_DIR}/pages.parquet')")
    truth = duck.execute(entries.ORACLES["op5_url_filter"]).fetchall()
    names = [d[0] for d in duck.description]
    assert len(truth) == len(ours)
    for row in truth:
        row = dict(zip(names, row))
        assert ours[row["page_id"]].asDict() == row


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls_of_every_kind(spark, limit):
    given = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.A.Example:80/x/?utm_a=1&b=2&a=1#top"),
        (6, "https://a.example/x?a=1&b=2"), (6, "https://a.example/x?a=1&b=2"), (7, "https://xorg/y"),
        (8, "http://q.org"), (9, "http://q.org/z"), (10, "http://q.org/no/" + "z" * 100_000),
    ]
    pages = spark.createDataFrame(given, "page_id int, url string").withColumn("verdict", F.lit("old")).withColumn("_key", F.lit(1))
    listed = spark.createDataFrame([("http://a.example/x?b=2&a=1&ref=u",), (None,), ("bad",)], "u string")
    rules = [Rule("allow", "org", "/"), Rule("block", "q.org", "/no")]
    got = [r.asDict() for r in judge_urls(pages, "url", listed, rules, limit).collect()]
    assert len(got) == len(given)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["host"], r["path"][:6], r["rule"], r["verdict"]))
    assert by[1] == by[2] == by[3] == by[4] == [("", "", None, "allow")]
    assert by[5][0][2:] == (None, "block") and by[6] == [("a.example", "/x", None, "block")] * 2
    assert by[7] == [("xorg", "/y", None, "allow")]
    assert by[8] == [("q.org", "", None, "allow")]  # the rule's path is not the start of an empty one
    assert by[9] == [("q.org", "/z", "org/", "allow")] and by[10] == [("q.org", "/no/zz", "q.org/no", "block")]
    assert judge_urls(pages.limit(0), "url", listed, rules, limit).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, "url", listed.limit(0), (), limit).collect()} == {"allow"}


def test_bloom_filter_loses_no_key_and_passes_few_others(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    others = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("k"))
    blocks = block_count(3000)
    blooms = bloom_blocks(keys, "k", blocks)
    assert with_bloom_hit(keys, "k", blooms, blocks, 1 << 20, "hit").where("hit").count() == 3000
    assert with_bloom_hit(others, "k", blooms, blocks, 1 << 20, "hit").where("hit").count() < 200


# ------------------------------------------------------------------ quality
def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b c a b c"), (5, "x x x x x x"), (6, "a\n\na\na \n b"), (7, "über 𝄞 #|<"),
    (8, "w " * 30000), (9, "one"), (9, "one"), (None, "p q r s p q r"), (10, "a b c\x0bd"),
]


def test_plain_counts(spark, docs):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_words", F.lit(1))
    both = odd.select("doc_id", "text", "_words", "score").unionByName(
        docs.select("doc_id", "text", F.lit(1).alias("_words"), F.lit("x").alias("score"))
    )
    none = [0.0] * 8
    got = judge_quality(both, none).collect()
    assert len(got) == len(ODD) + docs.count()
    for r in got:
        n = plain(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert judge_quality(both.limit(0), none).count() == 0


def test_ratio_score(spark, docs):
    from pyspark.sql.functions import xxhash64

    buckets = 64
    trusted = spark.read.parquet(SF_DIR + "/labels.parquet").where("quality = 1").select("doc_id")
    rows = docs.select("doc_id", "text").collect()
    good = {r[0] for r in trusted.collect()}
    grams = set()
    for r in rows:
        w = WORD.findall(r["text"])
        grams |= {(a, None) for a in w} | set(zip(w, w[1:]))
    frame = spark.createDataFrame(sorted(grams, key=str), "a string, b string")
    hashed = {
        (r["a"], r["b"]): r["h"] % buckets
        for r in frame.select("a", "b", F.when(F.col("b").isNull(), xxhash64("a")).otherwise(xxhash64("a", "b")).alias("h")).collect()
    }
    raw, target, per = Counter(), Counter(), {}
    for r in rows:
        w = WORD.findall(r["text"])
        per[r["doc_id"]] = [hashed[a, None] for a in w] + [hashed[p] for p in zip(w, w[1:])]
        raw.update(per[r["doc_id"]])
        if r["doc_id"] in good:
            target.update(per[r["doc_id"]])
    n, t = sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] + 5) / (raw[b] * t / n + 5)) for b in raw}
    got = judge_quality(docs.select("doc_id", "text"), bucket_ratios(docs, "text", trusted, "doc_id", buckets), floor=-0.01)
    for r in got.collect():
        want = sum(ratio[b] for b in per[r["doc_id"]]) / max(1, len(per[r["doc_id"]]))
        assert abs(r["score"] - want) < 1e-5
        if abs(want + 0.01) > 1e-5:
            assert r["kept"] == (not r["base_failed"] and want >= -0.01)


def test_no_trusted_documents_mean_ratio_zero(spark, docs):
    none = docs.select("doc_id").limit(0)
    assert set(bucket_ratios(docs, "text", none, "doc_id")) == {0.0}


# ------------------------------------------------------------------ fingerprints
def test_edited_texts(spark, docs, monkeypatch):
    import tallyweave.llm.multiset_hash as m

    monkeypatch.setattr(m, "ROWS_PER_BUCKET", 7)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1001, "\U0001d11eé" * 5), (1003, "a. b.\n\nc"), (1004, "b.\nc\na.")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("key", F.lit(1))
    rows = sorted(((r[0], r[1] or "") for r in both.collect()), key=lambda r: (-r[0], r[1].encode()))
    want = Counter()
    for (k, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        third = len(t) // 3
        want[k, len(t), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest()] += 1
    got = fingerprint_edits(both).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[1003]["fingerprint"] == by[1004]["fingerprint"] and by[1003]["near_next"] <= 1
    texts = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        texts.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    long = [r for r in got if r["n_chars"] > 1500]
    assert sum(r["near_edited"] > 0.4 for r in long) > 0.8 * len(long) > 10
    assert sum(r["near_next"] for r in long) / len(long) < 0.25
    assert fingerprint_edits(both.limit(0)).count() == 0
    alone = fingerprint_edits(odd.limit(1)).collect()[0]
    assert alone["near_edited"] == alone["near_next"] == 1.0


def test_insert_and_delete(spark):
    rows = spark.createDataFrame([("ab", "a x.\nb y."), ("ba", "b y.\na x."), ("a", "a x."), ("b", "b y."), ("e", "")], "k string, text string")
    got = {r["k"]: r["vector"] for r in fingerprints(rows, ["k"], "text").collect()}
    assert got["ab"] == got["ba"] != got["a"] and set(got["e"]) == {0}
    pair = spark.createDataFrame([(got["a"], got["b"], got["ab"])], "a array<long>, b array<long>, ab array<long>")
    r = pair.select(combine(F.col("a"), F.col("b")).alias("s"), combine(F.col("ab"), F.col("b"), -1).alias("d")).first()
    assert r["s"] == got["ab"] and r["d"] == got["a"]


def test_canonical_forms(spark):
    given = ["http://www.A.org:443/p/?b=1&ref=x&a=", "ftp://a.org/p?a=&b=1&utm_q", "//x", None]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "u string").select(canonical(F.col("u"))).collect()]
    assert got == ["a.org/p?a=&b=1"] * 2 + [None, None]
