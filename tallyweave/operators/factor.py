"""Principal components per cluster, rotated, with loadings and scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.moments import pair_sums_by


@dataclass(frozen=True)
class Components:
    """Rotated components of one cluster; small matrices only."""

    cluster: int
    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    eigenvalues: np.ndarray
    loadings: np.ndarray  # variables x components
    phi: np.ndarray  # correlations of the components
    weights: np.ndarray  # score weights for standardised variables


def oblimin(a: np.ndarray, gamma: float = 0.0, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Oblique rotation by gradient projection: minimises the cross products of squared
    loadings (Bernaards and Jennrich 2005). Returns pattern loadings and phi."""
    p, m = a.shape
    if m < 2:
        return a, np.eye(m)
    n = np.ones((m, m)) - np.eye(m)

    def criterion(l: np.ndarray) -> tuple[float, np.ndarray]:
        squared = l * l
        mixed = squared @ n
        if gamma:
            mixed = mixed - gamma * np.ones((p, p)) @ mixed / p
        return float((squared * mixed).sum() / 4), l * mixed

    t = np.eye(m)
    l = a @ np.linalg.inv(t).T
    f, g = criterion(l)
    step = 1.0
    for _ in range(rounds):
        gradient = -(l.T @ g @ np.linalg.inv(t)).T
        tangent = gradient - t * (t * gradient).sum(0)
        size = np.linalg.norm(tangent)
        if size < 1e-8:
            break
        step *= 2
        for _ in range(20):
            trial = t - step * tangent
            trial = trial / np.sqrt((trial**2).sum(0))
            l_new = a @ np.linalg.inv(trial).T
            f_new, g_new = criterion(l_new)
            if f - f_new > 0.5 * size**2 * step:
                break
            step /= 2
        t, l, f, g = trial, l_new, f_new, g_new
    return l, t.T @ t


def varimax(a: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Orthogonal rotation maximising the variance of the squared loadings, with rows
    scaled to unit length while rotating."""
    p, m = a.shape
    if m < 2:
        return a
    length = np.sqrt((a**2).sum(1))
    length[length == 0] = 1.0
    x, t, last = a / length[:, None], np.eye(m), 0.0
    for _ in range(rounds):
        z = x @ t
        u, s, v = np.linalg.svd(x.T @ (z**3 - z @ np.diag((z**2).sum(0)) / p))
        t = u @ v
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    return (x @ t) * length[:, None]


def rotated_components(corr: np.ndarray, factors: int, rotation: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, rotated loadings, component correlations and score weights of one
    correlation matrix. Signs make every component's loadings sum to a positive number;
    components are in order of their sum of squared loadings."""
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    loadings = vectors[:, :factors] * np.sqrt(np.maximum(values[:factors], 0.0))
    loadings = loadings * np.where(loadings.sum(0) < 0, -1.0, 1.0)
    phi = np.eye(factors)
    if rotation == "oblimin":
        loadings, phi = oblimin(loadings)
    elif rotation == "varimax":
        loadings = varimax(loadings)
    elif rotation != "none":
        raise ValueError(f"unknown rotation {rotation!r}")
    sign = np.where(loadings.sum(0) < 0, -1.0, 1.0)
    loadings, phi = loadings * sign, phi * np.outer(sign, sign)
    strongest = np.argsort(-(loadings**2).sum(0), kind="stable")
    loadings, phi = loadings[:, strongest], phi[np.ix_(strongest, strongest)]
    return values, loadings, phi, np.linalg.pinv(corr) @ (loadings @ phi)


def cluster_components(
    df: DataFrame, cluster: str, columns: Sequence[str], factors: int = 4, rotation: str = "oblimin"
) -> list[Components]:
    """Components of every cluster from one pass over the data: the correlations of all
    clusters are gathered together, p x p numbers each. A column that is constant within a
    cluster is left out of its correlations (treated as uncorrelated)."""
    fitted = []
    for value, sums in sorted(pair_sums_by(df.where(F.col(cluster) > 0), columns, cluster).items()):
        corr = np.nan_to_num(sums.corr)
        np.fill_diagonal(corr, 1.0)
        eigenvalues, loadings, phi, weights = rotated_components(corr, factors, rotation)
        sd = np.sqrt(np.maximum(np.diag(sums.cov), 0.0))
        fitted.append(Components(int(value), list(columns), sums.mean, sd, eigenvalues, loadings, phi, weights))
    return fitted


def eigenvalue_table(df: DataFrame, fitted: Sequence[Components]) -> DataFrame:
    """Eigenvalue, share and cumulative share per cluster and component."""
    rows = []
    for c in fitted:
        share = c.eigenvalues / c.eigenvalues.sum()
        for i, (value, part, total) in enumerate(zip(c.eigenvalues, share, share.cumsum())):
            rows.append((c.cluster, i + 1, float(value), float(part), float(total)))
    return df.sparkSession.createDataFrame(rows, "cluster int, component int, eigenvalue double, share double, cumulative double")


def loading_table(df: DataFrame, fitted: Sequence[Components], cutoff: float = 0.0) -> DataFrame:
    """Loadings of at least ``cutoff`` in absolute value."""
    rows = [
        (c.cluster, j + 1, variable, float(c.loadings[i, j]))
        for c in fitted
        for i, variable in enumerate(c.columns)
        for j in range(c.loadings.shape[1])
        if abs(c.loadings[i, j]) >= cutoff
    ]
    return df.sparkSession.createDataFrame(rows, "cluster int, component int, variable string, loading double")


def component_scores(df: DataFrame, key: str, cluster: str, fitted: Sequence[Components]) -> DataFrame:
    """Scores of every clustered row on its cluster's components: a join with one small
    row per cluster and a dot product."""
    first = fitted[0]
    m = first.loadings.shape[1]
    rows = []
    for c in fitted:
        scaled = np.divide(c.weights, c.sd[:, None], out=np.zeros_like(c.weights), where=c.sd[:, None] > 0)
        rows.append((c.cluster, [float(v) for v in c.mean], [[float(v) for v in scaled[:, j]] for j in range(m)]))
    table = df.sparkSession.createDataFrame(rows, f"{cluster} int, __mean array<double>, __weights array<array<double>>")
    x = F.array(*[F.col(c).cast("double") for c in first.columns])
    centred = F.zip_with(x, F.col("__mean"), lambda a, b: a - b)
    joined = df.withColumn(cluster, F.col(cluster).cast("int")).join(F.broadcast(table), cluster).withColumn("__z", centred)
    scores = [
        F.aggregate(F.zip_with(F.get("__weights", F.lit(j)), F.col("__z"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias(f"score{j + 1}")
        for j in range(m)
    ]
    return joined.select(key, cluster, *scores)
