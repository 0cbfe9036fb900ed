"""Descriptive tables: column profiles, box plots, histograms, bins, densities, shares."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.ranks import join_null_safe, ordered_totals, quantiles_of, weighted_quantiles_of


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest key (a bounded top-n, not a full sort)."""
    return df.orderBy(key).limit(n)


def sampled_rows(df: DataFrame, key: str, n: int, order) -> DataFrame:
    """n rows in the order of a reproducible hash of the key."""
    return df.orderBy(order, key).limit(n)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "variable", "n_missing")


def lengthen(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """One row per (row, column): ids, ``variable``, ``value``."""
    typed = df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in columns])
    return typed.unpivot(list(ids), list(columns), "variable", "value")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count, complete rate, mean, sd, minimum, quartiles and maximum per column."""
    long = lengthen(df, columns)
    moments = long.groupBy("variable").agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        (F.count("value") / F.count(F.lit(1))).alias("complete_rate"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    totals = ordered_totals(long, "value", ["variable"])
    spread = quantiles_of(totals, "value", [0.0, 0.25, 0.5, 0.75, 1.0], ["variable"])
    return moments.join(spread, "variable", "left")


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, column: str, relative_error: float | None = None) -> DataFrame:
    """Exact number of distinct values, or a sketch when an error is accepted."""
    if relative_error is None:
        return df.agg(F.count_distinct(F.col(column)).alias("n_distinct"))
    return df.agg(F.approx_count_distinct(column, relative_error).alias("n_distinct"))


def weights_on(df: DataFrame, weight: str) -> DataFrame:
    return df.agg((F.max(weight) > 1).alias("weight_on"))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each value over the column total; the total is a one-row subquery."""
    return df.withColumn(name, F.col(value) / df.agg(F.sum(value)).scalar())


def boxplot(df: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and the outliers beyond."""
    by = list(by)
    totals = ordered_totals(df, value, by, weight)
    pick = weighted_quantiles_of if weight else quantiles_of
    quartiles = pick(totals, value, [0.25, 0.5, 0.75], by)
    reach = F.lit(1.5) * (F.col("q75") - F.col("q25"))
    low, high = F.col("q25") - reach, F.col("q75") + reach
    inside = F.col(value).between(low, high)
    placed = join_null_safe(totals, quartiles, by)
    return placed.groupBy(*by, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col(value))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).cast("double").alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"),
        F.sum("n").alias("n"),
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins of every column over its observed range, with count and density, in two
    scans for all columns. Bins without rows count zero; a column of one value has one bin with
    rows, and a column without values has no bins."""
    values = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]
    long = df.select(F.explode(F.array(*values)).alias("v")).select("v.*").where("x IS NOT NULL")
    ends = long.groupBy("variable").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("total"))
    ends = ends.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    index = F.when(F.col("width") > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0)
    counted = long.join(F.broadcast(ends), "variable").groupBy("variable", index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return every.join(counted, ["variable", "bin"], "left").select(
        "variable", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("x_from"), n.alias("n"),
        (n / (F.col("total") * F.nullif("width", F.lit(0.0)))).alias("density"),
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the observed range, with count and density; empty bins count zero."""
    return histograms(df, [value], bins).drop("variable")


def density_curve(df: DataFrame, value: str, by: Sequence[str] = (), points: int = 512) -> DataFrame:
    """Gaussian kernel density on an even grid reaching three bandwidths past the data.

    Bandwidth: 0.9 * min(sd, IQR / 1.34) * n^(-1/5). Values are split linearly between
    their two grid points first, so each group costs ``points`` squared, whatever its size.
    """
    by = list(by)
    long = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    totals = ordered_totals(long, "__x", by)
    spread = quantiles_of(totals, "__x", [0.25, 0.75], by)
    stats = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.stddev_samp("__x").alias("__sd"),
        F.min("__x").alias("__min"),
        F.max("__x").alias("__max"),
    )
    stats = join_null_safe(stats, spread, by) if by else stats.withColumns(
        {q: spread.select(q).scalar() for q in ("q25", "q75")}
    )
    # with an IQR of zero the sd stands in
    iqr = F.nullif((F.col("q75") - F.col("q25")) / 1.34, F.lit(0.0))
    stats = stats.withColumn("bandwidth", 0.9 * F.least("__sd", F.coalesce(iqr, F.col("__sd"))) * F.pow("__n", F.lit(-0.2)))
    stats = stats.select(
        *by,
        "bandwidth",
        "__n",
        (F.col("__min") - 3 * F.col("bandwidth")).alias("__lo"),
        ((F.col("__max") - F.col("__min") + 6 * F.col("bandwidth")) / (points - 1)).alias("__step"),
    )
    counted = totals.select(*by, "__x", "n")
    if by:
        placed = join_null_safe(counted, stats, by)
    else:
        row = stats.select(F.struct(*stats.columns).alias("s")).scalar()
        placed = counted.withColumn("__s", row).select("__x", "n", "__s.*")
    position = (F.col("__x") - F.col("__lo")) / F.col("__step")
    cell = F.floor(position)
    split = F.explode(
        F.array(
            F.struct(cell.alias("i"), (F.col("n") * (1 - (position - cell))).alias("m")),
            F.struct((cell + 1).alias("i"), (F.col("n") * (position - cell)).alias("m")),
        )
    )
    ids = [*by, "bandwidth", "__n", "__lo", "__step"]
    grid = placed.select(*ids, split.alias("c")).groupBy(*ids, F.col("c.i").alias("i")).agg(F.sum("c.m").alias("m"))
    curves = grid.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("mass"))
    at = curves.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    kernel = F.aggregate(
        "mass",
        F.lit(0.0),
        lambda acc, c: acc
        + c["m"] * F.exp(-0.5 * F.pow((F.col("point") - c["i"]) * F.col("__step") / F.col("bandwidth"), F.lit(2.0))),
    )
    return at.select(
        *by,
        "point",
        (F.col("__lo") + F.col("point") * F.col("__step")).alias("x"),
        (kernel / (F.col("__n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"),
    )


def sturges(n: int) -> int:
    return math.ceil(math.log2(n)) + 1 if n > 1 else 1


def bin_edges(df: DataFrame, value: str, bins: int | None = None, kind: str = "quantile") -> list[float]:
    """Distinct bin edges: ``quantile`` (type 7, duplicates merged) or ``equal`` width."""
    x = F.col(value).cast("double")
    if bins is None:
        bins = sturges(df.agg(F.count(value)).first()[0])
    if kind == "equal":
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        edges = [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    else:
        probabilities = [i / bins for i in range(bins + 1)]
        row = quantiles_of(ordered_totals(df, value), value, probabilities).first()
        edges = list(row)
    return sorted(set(edges))


def bin_values(df: DataFrame, value: str, edges: Sequence[float], name: str = "bin") -> DataFrame:
    """Number (1..) and label of the bin; bins are open below, the first one closed."""
    x = F.col(value).cast("double")
    number, label = None, None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = x.between(lo, hi) if i == 0 else (x > lo) & (x <= hi)
        text = f"{'[' if i == 0 else '('}{lo:.6g},{hi:.6g}]"
        number = F.when(inside, i + 1) if number is None else number.when(inside, i + 1)
        label = F.when(inside, text) if label is None else label.when(inside, text)
    if number is None:  # all values equal
        number, label = F.when(x.isNotNull(), 1), F.when(x.isNotNull(), f"[{edges[0]:.6g},{edges[0]:.6g}]")
    return df.withColumns({name: number, f"{name}_label": label})


def bin_counts(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Rows per bin, with the edges."""
    table = F.array(*[F.lit(float(e)) for e in edges])
    return (
        bin_values(df.where(F.col(value).isNotNull()), value, edges)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"x_from": F.get(table, F.col("bin") - 1), "x_to": F.get(table, F.col("bin"))})
    )


def last_bin_threshold(counts: DataFrame) -> DataFrame:
    """Lower edge of the last bin that holds rows."""
    return counts.agg(F.max_by("x_from", "bin").alias("threshold"))


def stacked_shares(shares: DataFrame, row: str, column: str, share: str) -> DataFrame:
    """Start and end of every share in a stacked bar of a (small) share table."""
    order = Window.partitionBy(row).orderBy(F.col(column).asc_nulls_last())
    return shares.withColumn(
        "stack_to", F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("stack_from", F.col("stack_to") - F.col(share))
