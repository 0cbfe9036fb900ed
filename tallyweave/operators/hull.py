"""Convex hulls of clusters in the plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def _corners(points: np.ndarray) -> np.ndarray:
    """Hull corners, counter-clockwise from the lowest x (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(points), chain(points[::-1])
    return np.array(lower[:-1] + upper[:-1])


def cluster_hulls(df: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """(cluster, vertex, x, y). Every task first reduces its rows to hull corners, so what
    meets in one group is a few corners per task, not the cluster."""
    typed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(cluster).cast("int").alias("cluster"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in batch.groupby("cluster"):
                p = part[["x", "y"]].to_numpy()
                kept[c] = _corners(np.vstack([kept[c], p]) if c in kept else p)
        for c, p in kept.items():
            yield pd.DataFrame({"cluster": c, "x": p[:, 0], "y": p[:, 1]})

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        p = _corners(part[["x", "y"]].to_numpy())
        return pd.DataFrame({"cluster": part["cluster"].iloc[0], "vertex": range(1, len(p) + 1), "x": p[:, 0], "y": p[:, 1]})

    def thin(part: pd.DataFrame) -> pd.DataFrame:
        p = _corners(part[["x", "y"]].to_numpy())
        return pd.DataFrame({"cluster": part["cluster"].iloc[0], "x": p[:, 0], "y": p[:, 1]})

    fields = "cluster int, x double, y double"
    pruned = typed.mapInPandas(prune, fields)
    # with very many tasks even their corners are many: thin them in salted groups first
    salted = pruned.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)))
    thinned = salted.groupBy("cluster", "salt").applyInPandas(thin, fields)
    return thinned.groupBy("cluster").applyInPandas(finish, "cluster int, vertex int, x double, y double")
