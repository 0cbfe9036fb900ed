"""Ordered operations without a single-task sort: running totals, exact quantiles, ranks.

A plain window over a group sorts the whole group in one task, which a group holding a
third of the rows does not survive. Here equal values are first added up (map-side), the
remaining distinct values are cut into buckets by a mergeable quantile sketch, and only
each bucket is sorted. The sketch decides balance, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import cut_lineage

BUCKETS = 128
SKETCH = 10_000  # accuracy of the sketch that a quantile is looked for with


def join_null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null groups meet, keeping the left names."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in columns})
    condition = [left[c].eqNullSafe(renamed[f"__{c}"]) for c in columns]
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{c}" for c in columns])


def _bucketed(base: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """Add ``__bucket``, monotone in ``value`` within each group."""
    probabilities = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    sketch = F.percentile_approx(F.col(value).cast("double"), probabilities, F.lit(4 * buckets)).alias("__cuts")
    if by:
        with_cuts = join_null_safe(base, base.groupBy(*by).agg(sketch), by)
    else:
        with_cuts = base.withColumn("__cuts", base.agg(sketch).scalar())
    below = F.size(F.filter("__cuts", lambda cut: cut < F.col(value).cast("double")))
    return with_cuts.withColumn("__bucket", below).drop("__cuts")


def _prefixed(bucketed: DataFrame, by: list[str], value: str, ties: list[str], buckets: int) -> DataFrame:
    """Turn ``n`` and ``w`` into exclusive running totals and group totals."""
    per_bucket = bucketed.groupBy(*by, "__bucket").agg(F.sum("n").alias("__bn"), F.sum("w").alias("__bw"))
    if by:
        group = Window.partitionBy(*by)
    else:
        group = Window.partitionBy(F.lit(0))  # at most ``buckets`` rows
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by,
        "__bucket",
        F.coalesce(F.sum("__bn").over(before), F.lit(0)).alias("__on"),
        F.coalesce(F.sum("__bw").over(before), F.lit(0.0)).alias("__ow"),
        F.sum("__bn").over(group).alias("total_n"),
        F.sum("__bw").over(group).alias("total_w"),
    )
    joined = join_null_safe(bucketed, offsets, [*by, "__bucket"])
    inside = Window.partitionBy(*by, "__bucket").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumns(
        {
            "before_n": F.col("__on") + F.coalesce(F.sum("n").over(inside), F.lit(0)),
            "before_w": F.col("__ow") + F.coalesce(F.sum("w").over(inside), F.lit(0.0)),
        }
    ).drop("__bucket", "__on", "__ow")


def ordered_totals(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """One row per group and distinct non-null value, with ``n`` rows and ``w`` weight at
    the value, ``before_n``/``before_w`` below it and ``total_n``/``total_w`` overall."""
    by = list(by)
    weighed = F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")
    base = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"), weighed.alias("w"))
    )
    # the sketch, the bucket totals and the result all read it: scan the data once
    base = cut_lineage(base)
    return _prefixed(_bucketed(base, by, value, buckets), by, value, [], buckets)


def ranked(
    df: DataFrame, value: str, ties: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """``df`` with a 0-based ``rank`` and the group size ``size``, ordered by ``value`` and
    then by ``ties``, which together must be unique within a group.

    Values are counted first, which gives the rank of the first row of each. Rows of a value
    that few rows have follow by a window over the value. A hot value, with more than a
    ``buckets``-th of the rows, is cut into buckets by its first tie column, so its rows are
    not sorted in one task either. Rows without a value are left out.
    """
    by, ties = list(by), list(ties)
    hot = (F.col("n") > 1) & (F.col("n") * buckets > F.col("total_n"))
    totals = ordered_totals(df, value, by, buckets=buckets).select(
        *by, value, F.col("before_n").alias("__first"), F.col("total_n").alias("size"), hot.alias("__hot")
    )
    placed = join_null_safe(df, totals, [*by, value])
    if not ties:
        return placed.withColumn("rank", F.col("__first")).drop("__first", "__hot")
    group = [*by, value]
    inside = Window.partitionBy(*group).orderBy(*ties)
    cold = placed.where("NOT __hot").withColumn("rank", F.col("__first") + F.row_number().over(inside) - 1)
    packed = placed.where("__hot").select(*group, *[t for t in ties if t not in group], F.struct("*").alias("__row"))
    tied = packed.withColumns({"n": F.lit(1).cast("long"), "w": F.lit(0.0)})
    inner = _prefixed(_bucketed(tied, group, ties[0], buckets), group, ties[0], ties[1:], buckets)
    ranks = inner.select("__row.*", (F.col("__row.__first") + F.col("before_n")).alias("rank"))
    return cold.unionByName(ranks).drop("__first", "__hot")


def _name(probability: float) -> str:
    return "q" + f"{probability * 100:g}".replace(".", "_")


def quantiles_of(totals: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles (type 7) from :func:`ordered_totals`; columns q25, q50, ..."""
    picks, results = [], []
    for p in probabilities:
        h = (F.col("total_n") - 1) * F.lit(float(p))
        low = F.floor(h)
        for tag, rank in (("lo", low), ("hi", F.least(low + 1, F.col("total_n") - 1))):
            hit = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{_name(p)}_{tag}"))
        fraction = (F.col("__size") - 1) * F.lit(float(p))
        fraction = fraction - F.floor(fraction)
        lo, hi = F.col(f"__{_name(p)}_lo"), F.col(f"__{_name(p)}_hi")
        results.append((lo + fraction * (hi - lo)).alias(_name(p)))
    grouped = totals.groupBy(*by).agg(F.max("total_n").alias("__size"), *picks)
    return grouped.select(*by, *results)


def weighted_quantiles_of(
    totals: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Smallest value whose cumulative weight share reaches each probability."""
    reached = F.col("before_w") + F.col("w")
    return totals.groupBy(*by).agg(
        *[
            F.min(F.when(reached >= F.col("total_w") * F.lit(float(p)), F.col(value).cast("double"))).alias(_name(p))
            for p in probabilities
        ]
    )


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per group; weighted ones when ``weight`` is given."""
    totals = ordered_totals(df, value, by, weight)
    if weight:
        return weighted_quantiles_of(totals, value, probabilities, by)
    return quantiles_of(totals, value, probabilities, by)


def exact_quantile(df: DataFrame, value: str, probability: float) -> float | None:
    """One quantile (type 7) of a whole table, as :func:`quantiles` gives it.

    A sketch gives two values around it; only the rows between these are put in order, what lies
    below is counted. Should the sketch be off, all rows are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value))
    around = F.array(*[F.lit(min(max(probability + e, 0.0), 1.0)) for e in (-3 / SKETCH, 3 / SKETCH)])
    n, ends = rows.agg(F.count(F.lit(1)), F.percentile_approx(value, around, F.lit(SKETCH))).first()
    if not n:
        return None
    below = rows.agg(F.count_if(F.col(value) < F.lit(ends[0]))).first()[0]
    inside = ordered_totals(rows.where(F.col(value).between(*ends)), value)
    whole = inside.withColumns({"before_n": F.col("before_n") + F.lit(below), "total_n": F.lit(n)})
    found = quantiles_of(whole, value, [probability]).first()[0]
    return quantiles(rows, value, [probability]).first()[0] if found is None else found
