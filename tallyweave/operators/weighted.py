"""Weighted shares, means and crosstabs; every table is one pre-aggregated shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.recode import percent
from tallyweave.functions.special import chi_square_tail


def weighted_share(df: DataFrame, column: str, weight: str, na_rm: bool = False) -> DataFrame:
    """Percentage of the weight per level; null is a level of its own unless removed."""
    rows = df.where(F.col(column).isNotNull()) if na_rm else df
    levels = rows.groupBy(column).agg(F.sum(weight).alias("weight"))
    total = levels.agg(F.sum("weight")).scalar()
    return levels.withColumn("pct", percent(F.col("weight"), total))


def weighted_means(df: DataFrame, by: Sequence[str], values: dict[str, str], weight: str) -> DataFrame:
    """Weighted mean per group of several columns; a null drops its value and its weight.
    ``values`` maps result names to columns."""
    means = []
    for name, value in values.items():
        counted = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
        means.append((F.sum(F.col(value) * F.col(weight)) / F.nullif(counted, F.lit(0.0))).alias(name))
    return df.groupBy(*by).agg(*means)


def crosstabs(df: DataFrame, row: str, questions: Sequence[str], weight: str | None = None) -> DataFrame:
    """Weighted crosstabs of one row variable against many questions, in one pass.

    The questions are unpivoted, partially summed per task and shuffled once as cells
    (question, row, level). Rows with a null row label or a null answer are left out, as
    in a contingency table. ``pct`` is the row percentage; combinations that never occur
    appear with weight 0.
    """
    chosen = list(dict.fromkeys(questions))
    weighed = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = (
        df.where(F.col(row).isNotNull())
        .select(F.col(row).alias("row"), weighed.alias("__w"), *[F.col(q).cast("string").alias(q) for q in chosen])
        .unpivot(["row", "__w"], chosen, "question", "level")
        .where(F.col("level").isNotNull())
    )
    cells = long.groupBy("question", "row", "level").agg(F.sum("__w").alias("weight"))
    # complete the table from the cells themselves, so that the data is scanned once
    levels = F.array_sort(F.collect_set("level").over(Window.partitionBy("question")))
    rows = (
        cells.withColumn("levels", levels)
        .groupBy("question", "row")
        .agg(
            F.first("levels").alias("levels"),
            F.sum("weight").alias("row_weight"),
            F.map_from_entries(F.collect_list(F.struct("level", "weight"))).alias("weights"),
        )
    )
    weight_at = F.coalesce(F.try_element_at("weights", F.col("level")), F.lit(0.0))
    return (
        rows.select("question", "row", "row_weight", "weights", F.explode("levels").alias("level"))
        .withColumn("weight", weight_at)
        .withColumn("pct", percent(F.col("weight"), F.col("row_weight")))
        .select("question", "row", "level", "weight", "pct")
    )


def crosstab(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    return crosstabs(df, row, [column], weight).drop("question")


@F.pandas_udf(T.DoubleType())
def _tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(s, d) for s, d in zip(statistic, df)])


def chi_square(cells: DataFrame, p_value: bool = True) -> DataFrame:
    """Chi-square of independence per question from a :func:`crosstabs` table."""
    per_question = Window.partitionBy("question")
    expected = (
        cells.withColumn("__r", F.sum("weight").over(Window.partitionBy("question", "row")))
        .withColumn("__c", F.sum("weight").over(Window.partitionBy("question", "level")))
        .withColumn("__t", F.sum("weight").over(per_question))
        .withColumn("__e", F.col("__r") * F.col("__c") / F.nullif(F.col("__t"), F.lit(0.0)))
    )
    tested = expected.groupBy("question").agg(
        F.sum(F.pow(F.col("weight") - F.col("__e"), F.lit(2.0)) / F.nullif(F.col("__e"), F.lit(0.0))).alias("statistic"),
        ((F.count_distinct("row") - 1) * (F.count_distinct("level") - 1)).alias("df"),
        F.sum("weight").alias("total"),
    )
    return tested.withColumn("p_value", _tail("statistic", "df")) if p_value else tested
