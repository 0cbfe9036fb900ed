"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Single words and pairs of neighbouring words are hashed into ``buckets`` numbers. Two
multinomials are counted over all documents: one over the trusted ones, one over all. A
document's score is the mean over its n-grams of log p_trusted - log p_raw, so that long and
short texts compare. A document is kept if it passes the plain rules and its score is at
least ``floor``, a number fixed beforehand and the same for every document and corpus size.

Defined results: a null text counts as empty; a text without a word fails the plain rules and
has score 0. Repeated rows are judged one by one and each counts in the raw corpus; a document
is trusted if any label row says so. Without trusted documents all ratios are 0. Extra columns
are kept; those named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import SPACE, WORD, words_of

BUCKETS = 1 << 16  # also bounds what reaches the driver and goes with the plan: 65,536 numbers
SMOOTHING = 5.0
FLOOR = -0.12

OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_words", words_of(F.col(f"`{text}`")))


def _shifted(array: Column, by: int) -> Column:
    """The array without its last ``by`` elements; empty if it is no longer than that."""
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - by, F.lit(0)))


def _ngrams(words: Column, buckets: int) -> Column:
    """Bucket numbers of all words and all pairs of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(
        _shifted(words, 1),
        lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def plain_counts(docs: DataFrame, text: str) -> DataFrame:
    """Add the array ``_words`` and the five counts of the plain rules.

    Repeated windows are found inside the row: the hashes of all three-word windows are sorted
    with their positions, neighbours with equal hashes are repeats, and the words they cover
    are counted once each. The sort is left out where all windows differ.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    words = F.col("_words")
    windows = F.transform(
        _shifted(words, 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    nothing = F.expr("CAST(array() AS array<struct<h: bigint, i: int>>)")
    ordered = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))),
    ).otherwise(nothing)
    repeated = F.filter(
        "_ordered",
        lambda x, k: F.coalesce(x["h"] == F.get("_ordered", k - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("_ordered", k + 1)["h"], F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform("_repeated", lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )
    return (
        _with_words(docs, text)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": (F.char_length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long"),
                "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
                "_lines": lines,
                "_windows": windows,
            }
        )
        .withColumns(
            {
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "_ordered": ordered,
            }
        )
        .withColumn("_repeated", repeated)
        .withColumn("n_repeat_words", covered)
        .drop("_lines", "_windows", "_ordered", "_repeated")
    )


def bucket_ratios(
    docs: DataFrame, text: str, trusted: DataFrame, key: str, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> list[float]:
    """log p_trusted - log p_raw of every bucket; 0 for buckets that do not occur.

    Both counts are taken at the size of the trusted text and raised by ``smoothing``, so that
    a bucket says little while few trusted occurrences are to be expected in it.

    ``trusted`` has the keys of the trusted documents. It grows with the documents, so it is
    joined by a shuffle at every size. Counting is combined before its shuffle: at most
    ``buckets`` rows leave a task, and as many reach the driver.
    """
    good = trusted.select(F.col(f"`{key}`").alias("_good")).where(F.col("_good").isNotNull()).distinct()
    marked = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(
        good.hint("merge"), F.col("_key") == F.col("_good"), "left"
    )
    counts = (
        _with_words(marked.select(F.col("_good").isNotNull().cast("long").alias("_is_good"), "_text"), "_text")
        .select("_is_good", F.explode(_ngrams(F.col("_words"), buckets)).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("_is_good").alias("target"))
        .collect()
    )
    raw, target = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    ratios = [0.0] * buckets
    for r in counts if target else []:
        expected = r["raw"] * target / raw
        ratios[r["_bucket"]] = math.log((r["target"] + smoothing) / (expected + smoothing))
    return ratios


def judge_quality(
    docs: DataFrame,
    ratios: list[float],
    text: str = "text",
    floor: float = FLOOR,
) -> DataFrame:
    """``docs`` with the plain counts, the score and the verdict; nothing is shuffled."""
    kept = [c for c in docs.columns if c not in OUTPUTS]
    # the columns travel in a struct, so that theirs and the working names cannot clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    counted = plain_counts(rows.withColumn("_text", F.col("_doc").getField(text)), "_text")
    buckets = len(ratios)
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<float>")  # one constant of the plan
    words = F.col("_words")

    def both(w: Column, i: Column) -> Column:
        one = F.get(table, F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
        following = F.get(words, i + 1)
        two = F.get(table, F.pmod(F.xxhash64(w, following), F.lit(buckets)).cast("int"))
        return one.cast("double") + F.when(following.isNull(), F.lit(0.0)).otherwise(two.cast("double"))

    total = F.aggregate(F.transform(words, both), F.lit(0.0), lambda acc, x: acc + x)
    ngrams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return (
        counted.withColumn("score", total / ngrams)
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= floor))
        .select(*[F.col("_doc").getField(c).alias(c) for c in kept], *OUTPUTS)
    )


def kept_rows(judged: DataFrame) -> DataFrame:
    """The rows that passed. The row number only keeps the optimizer from writing the verdict out
    in full for the filter, which would work out every shared step many times over."""
    return judged.withColumn("_at", F.monotonically_increasing_id()).where("kept AND _at >= 0").drop("_at")
