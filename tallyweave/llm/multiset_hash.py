"""Document fingerprints: a homomorphic multiset hash over passages.

A text is the multiset of its passages: paragraphs (lines), cut once more after ``.``, ``!``
or ``?`` before a blank, without empty ones. Every passage is hashed to a wide vector and the
vectors are added modulo 2^32, so order does not matter, a passage is inserted by adding its
vector and deleted by subtracting it, and equal multisets have equal fingerprints. The vector:

* 1 number, always one: how many passages there are;
* 4 numbers of 32 random bits each, which tell different multisets apart;
* 64 numbers, each 0 or 1. With the count these give 64 sums of random signs, and the mean
  square of the difference of two such sums estimates in how many passages two texts differ.

``likeness`` is 1 - difference / (norm + norm), cut to 0..1: exactly 1 for equal multisets, and
near 0 for texts that share nothing.

Defined results: a null text counts as empty; the fingerprint of an empty text is all zeros and
two empty texts have likeness 1. Rows that repeat a key are neighbours, ordered by their text.
A null key comes last. The next document of the last row is the first one, and of a single
row itself. Columns of the input other than key and text are not returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANES = 64
WIDE = 4
LOW = 0xFFFFFFFF
ROWS_PER_BUCKET = 2000
FAN = 64  # cut points are looked up in two levels of this many


def passages(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?])[ ]+"), lambda p: p != "")


def _sums(passage: Column) -> list[Column]:
    """Aggregates over passages: count, 4 wide sums, 32 sums that hold two lanes each."""
    wide = []
    hashed = lambda *salt: F.when(passage.isNotNull(), F.xxhash64(passage, *salt))
    for salt in range(WIDE // 2):
        h = hashed(F.lit(salt + 1))
        wide += [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(LOW)))]
    h = hashed()
    pair = F.lit(0x0000000100000001)
    return [F.count(passage)] + wide + [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(pair)) for j in range(LANES // 2)]


def _vector(sums: list[str]) -> Column:
    """The sums as 69 numbers modulo 2^32."""
    zero = F.lit(0).cast("long")
    plain = [F.coalesce(F.col(c), zero).bitwiseAND(F.lit(LOW)) for c in sums[: 1 + WIDE]]
    low = [F.coalesce(F.col(c), zero).bitwiseAND(F.lit(LOW)) for c in sums[1 + WIDE :]]
    high = [F.shiftrightunsigned(F.coalesce(F.col(c), zero), 32) for c in sums[1 + WIDE :]]
    return F.array(*plain, *low, *high)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets, or with ``sign=-1`` of a without b."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW)))


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _signs(vector: Column) -> Column:
    """The 64 sums of signs of a vector."""
    count = F.get(vector, F.lit(0))
    return F.transform(F.slice(vector, 2 + WIDE, LANES), lambda c: (2 * c - count).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two vectors; a lane of the difference is read as a small signed number."""
    zero = F.lit(0.0)
    squares = lambda v: F.aggregate(_signs(v), zero, lambda acc, x: acc + x * x)
    apart = F.aggregate(F.zip_with(_signs(a), _signs(b), lambda x, y: x - y), zero, lambda acc, x: acc + x * x)
    both = squares(a) + squares(b)
    return F.when(a == b, F.lit(1.0)).when(both == 0, zero).otherwise(F.greatest(zero, F.least(F.lit(1.0), 1 - apart / both)))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, vector): one row per key of ``rows``, sums combined before any shuffle."""
    sums = _sums(F.col("_passage"))
    names = [f"_s{i}" for i in range(len(sums))]
    exploded = rows.select(*keys, F.explode_outer(passages(F.col(text))).alias("_passage"))
    return exploded.groupBy(*keys).agg(*[s.alias(n) for s, n in zip(sums, names)]).select(*keys, _vector(names).alias("vector"))


def _cuts(rows: DataFrame, key: str) -> list[int]:
    """Ascending keys that cut the rows into about equal ranges; 4,096 at most."""
    n = rows.count()
    ranges = min(FAN * FAN, math.ceil(n / ROWS_PER_BUCKET))
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx(key, shares, 20 * ranges).alias("cuts")).first()["cuts"] or []
    return sorted(set(found))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the key, by two short lists; null keys fall below all."""
    if not cuts:
        return F.lit(0)
    parts = [cuts[i : i + FAN] for i in range(0, len(cuts), FAN)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    heads = longs([p[0] for p in parts])
    part = F.greatest(below(heads) - 1, F.lit(0))
    inside = below(F.get(F.array(*[longs(p) for p in parts]), part))
    return F.when(key.isNull(), F.lit(-1)).otherwise(part * FAN + inside)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, next, _range, _place): every text with that of the next row by descending key.

    The texts are shuffled once, by ranges of the key. Inside a range the next row comes from a
    window; the last row of a range takes the first row of the following one from a table with
    one row per range.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ranges = rows.withColumn("_range", _range_of(F.col("key"), _cuts(rows, "key")))
    order = Window.partitionBy("_range").orderBy(F.col("key").desc_nulls_last(), "text")
    placed = ranges.withColumns({"_place": F.row_number().over(order), "_lead": F.lead("text").over(order)})
    heads = placed.where("_place = 1").select("_range", F.col("text").alias("_head"))
    names = ranges.select("_range").distinct()
    over_all = Window.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())  # 4,097 rows at most
    following = names.withColumns(
        {"_following": F.coalesce(F.lead("_range").over(over_all), F.max("_range").over(Window.partitionBy(F.lit(0))))}
    )
    entering = following.join(heads.withColumnRenamed("_range", "_following"), "_following").select("_range", "_head")
    joined = placed.join(entering, "_range", "left")
    return joined.select(
        "key", "text", "_range", "_place", F.coalesce("_lead", "_head").alias("next")
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last third of ``text`` replaced by as many code points of ``following``, or all of it."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next text's are."""
    rows = with_next(docs, key, text).withColumn("edited", edited_text(F.col("text"), F.col("next")))
    facts = F.struct(
        F.col("key").alias("key"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
    )
    three = rows.select("_range", "_place", facts.alias("_facts"), F.posexplode(F.array("text", "edited", "next")).alias("_which", "_text"))
    named = three.select("_range", "_place", F.when(F.col("_which") == 0, F.col("_facts")).alias("_facts"), "_which", "_text")
    sums = _sums(F.col("_passage"))
    names = [f"_s{i}" for i in range(len(sums))]
    summed = (
        named.select("_range", "_place", "_which", "_facts", F.explode_outer(passages(F.col("_text"))).alias("_passage"))
        .groupBy("_range", "_place", "_which", "_facts")
        .agg(*[s.alias(n) for s, n in zip(sums, names)])
        .select("_range", "_place", "_which", "_facts", _vector(names).alias("vector"))
    )
    side = lambda k: F.max(F.when(F.col("_which") == k, F.col("vector")))
    return (
        summed.groupBy("_range", "_place")
        .agg(F.max("_facts").alias("f"), side(0).alias("own"), side(1).alias("changed"), side(2).alias("following"))
        .select(
            F.col("f.key").alias(key),
            "f.n_chars",
            "f.edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("following")).alias("near_next"),
        )
    )
