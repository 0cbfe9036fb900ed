"""Means, covariances and correlations of many columns in one pass.

Each task multiplies its Arrow batches into p x p sums; only the entries are shuffled and
added up, spread over (group, entry), so neither rows nor a group ever meet in one task.
What reaches the driver is p x p numbers per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.special import chi_square_tail


@dataclass(frozen=True)
class PairSums:
    """Pairwise-complete sums, centred on ``shift``: for columns j, k over the rows where
    both are present, ``n`` counts, ``sx`` sums j, ``sxx`` squares j, ``sxy`` products."""

    columns: list[str]
    shift: np.ndarray
    n_rows: int
    n: np.ndarray
    sx: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.shift + np.diag(self.sx) / np.diag(self.n)

    @property
    def cov(self) -> np.ndarray:
        """Sample covariance over pairwise-complete rows."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.sxy - self.sx * self.sx.T / self.n) / (self.n - 1)

    @property
    def corr(self) -> np.ndarray:
        """Pearson correlation over pairwise-complete rows; nan for a constant column."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = self.sxy - self.sx * self.sx.T / self.n
            var = self.sxx - self.sx * self.sx / self.n
            scale = np.sqrt(var * var.T)
            return np.where(scale > 1e-12 * np.maximum(self.sxx, 1.0), cross / scale, np.nan)

    @property
    def missing_corr(self) -> np.ndarray:
        """[j, k]: correlation of "j is missing" with column k, where k is present."""
        n_k = np.diag(self.n)[None, :]
        gone = n_k - self.n  # rows with k present and j missing
        sum_k = np.diag(self.sx)[None, :]
        sum_k2 = np.diag(self.sxx)[None, :]
        gone_k = sum_k - self.sx.T
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = gone_k - gone * sum_k / n_k
            scale = np.sqrt((gone - gone * gone / n_k) * (sum_k2 - sum_k * sum_k / n_k))
            return np.where(scale > 1e-12, cross / scale, np.nan)


def _matrix(batch: pa.RecordBatch, columns: Sequence[str], shift: np.ndarray) -> np.ndarray:
    stacked = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]
    return np.stack(stacked, axis=1) - shift


def _sums(x: np.ndarray, n: np.ndarray | None) -> np.ndarray:
    present = ~np.isnan(x)
    m = present.astype(float)
    x0 = np.where(present, x, 0.0)
    mn, xn = (m, x0) if n is None else (m * n[:, None], x0 * n[:, None])
    return np.stack([m.T @ mn, x0.T @ mn, (x0 * x0).T @ mn, x0.T @ xn])


def pair_sums_by(df: DataFrame, columns: Sequence[str], by: str | None = None, count: str | None = None) -> dict[object, PairSums]:
    """:class:`PairSums` per value of ``by`` (one entry under None without it). ``by`` is a
    cluster label: its number of values times p squared is what the driver receives. With
    ``count`` a row stands for that many equal ones."""
    columns = list(columns)
    p = len(columns)
    counted = [F.col(count).cast("double").alias("__n")] if count else []
    typed = df.select(
        (F.col(by) if by else F.lit(0)).alias("__g"), *counted, *[F.col(c).cast("double").alias(c) for c in columns]
    )
    mean = lambda c: F.sum(F.col(c) * F.col("__n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("__n"))) if count else F.avg(c)
    centre = typed.agg(*[F.coalesce(mean(c), F.lit(0.0)).alias(c) for c in columns]).first()
    shift = np.array(list(centre), dtype=float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[object, np.ndarray] = {}
        rows: dict[object, float] = {}
        for batch in batches:
            x = _matrix(batch, columns, shift)
            n = batch.column("__n").to_numpy(zero_copy_only=False) if count else None
            if by is None:
                parts = [(0, slice(None))] if len(x) else []
            else:
                coded = batch.column("__g").dictionary_encode("encode")
                places = coded.indices.to_numpy(zero_copy_only=False)
                parts = [(g, places == i) for i, g in enumerate(coded.dictionary.to_pylist())]
            for g, at in parts:
                seen[g] = seen.get(g, 0.0) + _sums(x[at], n[at] if count else None)
                rows[g] = rows.get(g, 0) + (n[at].sum() if count else len(x[at]))
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_pydict(
                {
                    "__g": pa.array(keys, type=group_type),
                    "entries": pa.array(
                        [np.append(seen[k].ravel(), rows[k]) for k in keys], type=pa.list_(pa.float64())
                    ),
                }
            )

    from pyspark.sql.pandas.types import to_arrow_type

    group_type = to_arrow_type(typed.schema["__g"].dataType)
    schema = f"__g {typed.schema['__g'].dataType.simpleString()}, entries array<double>"
    totals = (
        typed.mapInArrow(partial, schema)
        .select("__g", F.posexplode("entries").alias("i", "v"))
        .groupBy("__g", "i")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    filled: dict[object, np.ndarray] = {}
    for row in totals:
        filled.setdefault(row["__g"], np.zeros(4 * p * p + 1))[row["i"]] = row["v"]
    result = {}
    for g, entries in filled.items():
        n, sx, sxx, sxy = entries[:-1].reshape(4, p, p)
        result[g if by else None] = PairSums(columns, shift, int(entries[-1]), n, sx, sxx, sxy)
    return result


def pair_sums(df: DataFrame, columns: Sequence[str], complete: bool = False) -> PairSums:
    """Sums over all rows, or over rows without any null when ``complete``."""
    rows = df.na.drop("any", subset=list(columns)) if complete else df
    found = pair_sums_by(rows, columns)
    if not found:
        raise ValueError("no rows to summarise")
    return found[None]


def _matrix_table(df: DataFrame, columns: Sequence[str], values: np.ndarray, name: str) -> DataFrame:
    rows = [
        (a, b, None if math.isnan(values[i, j]) else float(values[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, f"row string, column string, {name} double")


def correlation_matrix(df: DataFrame, columns: Sequence[str], complete: bool = False) -> DataFrame:
    """Long Pearson correlations; pairwise-complete unless ``complete``."""
    return _matrix_table(df, columns, pair_sums(df, columns, complete).corr, "corr")


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _matrix_table(df, columns, pair_sums(df, columns, complete=True).cov, "cov")


def mean_vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], list(columns), "variable", "mean")


def variance_homogeneity(df: DataFrame, columns: Sequence[str], p_value: bool = True) -> DataFrame:
    """Bartlett's test that all columns share one variance."""
    stats = df.agg(
        *[F.count(c).cast("double").alias(f"n_{c}") for c in columns],
        *[F.var_samp(c).alias(f"v_{c}") for c in columns],
    )
    k = len(columns)
    free = [F.col(f"n_{c}") - 1 for c in columns]
    total = sum(free[1:], free[0])
    pooled = sum((f * F.col(f"v_{c}") for f, c in zip(free, columns)), F.lit(0.0)) / total
    logs = sum((f * F.log(F.col(f"v_{c}")) for f, c in zip(free, columns)), F.lit(0.0))
    correction = 1 + (sum((1 / f for f in free), F.lit(0.0)) - 1 / total) / (3 * (k - 1))
    tested = stats.select(((total * F.log(pooled) - logs) / correction).alias("statistic"), F.lit(k - 1).alias("df"))
    if not p_value:
        return tested
    statistic, df_ = tested.first()
    return df.sparkSession.createDataFrame(
        [(statistic, df_, chi_square_tail(statistic, df_))], "statistic double, df int, p_value double"
    )


def sphericity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bartlett's test that the correlation matrix is the identity."""
    sums = pair_sums(df, columns, complete=True)
    p, n = len(columns), sums.n_rows
    _, log_det = np.linalg.slogdet(sums.corr)
    statistic = float(-(n - 1 - (2 * p + 5) / 6) * log_det)
    free = p * (p - 1) // 2
    return df.sparkSession.createDataFrame(
        [(statistic, free, chi_square_tail(statistic, free))], "statistic double, df int, p_value double"
    )


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Centre and divide by the sample sd; a constant column becomes null. The statistics
    are one-row subqueries, so the plan stays lazy and joins nothing."""
    named = [c for c in columns]
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in named],
            *[F.nullif(F.stddev_samp(c), F.lit(0.0)).alias(f"s_{c}") for c in named],
        )
    ).scalar()
    return (
        df.withColumn("__stats", stats)
        .withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"__stats.m_{c}")) / F.col(f"__stats.s_{c}") for c in named})
        .drop("__stats")
    )


def partition_summary(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Total, within and between sums of squares and the cluster sizes of a labelling."""
    columns = list(columns)
    n = F.col("size").cast("double")
    parts = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.var_pop(c).alias(f"v_{c}") for c in columns],
    )
    overall = parts.select(
        *[(F.sum(n * F.col(f"m_{c}")).over(Window.partitionBy(F.lit(0))) / F.sum(n).over(Window.partitionBy(F.lit(0))))
          .alias(f"g_{c}") for c in columns],
        "*",
    )
    within = sum((n * F.col(f"v_{c}") for c in columns), F.lit(0.0))
    between = sum((n * F.pow(F.col(f"m_{c}") - F.col(f"g_{c}"), F.lit(2.0)) for c in columns), F.lit(0.0))
    return overall.select(cluster, "size", within.alias("within_ss"), between.alias("between_ss"))


def fit_summary(parts: DataFrame) -> DataFrame:
    """One row with the totals of :func:`partition_summary`."""
    return parts.agg(
        (F.sum("within_ss") + F.sum("between_ss")).alias("total_ss"),
        F.sum("within_ss").alias("within_ss"),
        F.sum("between_ss").alias("between_ss"),
        F.count(F.lit(1)).alias("k"),
        F.sum("size").alias("n"),
    )
