"""Registered queries: neighbours, clustering and its evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import consistency, dbscan, hull, kmeans, kmedoids, moments, neighbors, ward
from tallyweave.plans.registry import query, rounded, table

DIM = 64
EMBEDDED = [f"e{i}" for i in range(DIM)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one column per dimension, with their label."""
    stored = table(spark, sf_dir, "embeddings")
    return stored.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(e) for i, e in enumerate(EMBEDDED)])


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points in the plane."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 3.0).alias("y")
    )


_PLANE = "pts AS MATERIALIZED (SELECT c_custkey, c_acctbal / 1000 AS x, c_nationkey / 3.0::DOUBLE AS y FROM customer)"
_V = "v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_D = "list_distance(a.e, b.e)"


def _knn_sql(k: int) -> str:
    return (
        f"WITH {_V}, d AS (SELECT a.vec_id, b.vec_id AS neighbour, {_D} AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id), "
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS INT) AS rank FROM d), "
        f"nn AS (SELECT vec_id, neighbour, distance, rank FROM r WHERE rank <= {k})"
    )


@query("knn_exact", f"{_knn_sql(5)} SELECT vec_id, neighbour, round(distance, 6) AS distance, rank FROM nn")
def _(spark, sf_dir):
    return rounded(neighbors.knn(vectors(spark, sf_dir), "vec_id", EMBEDDED, 5))


@query(
    "knn_dist_curve",
    f"{_knn_sql(4)} SELECT vec_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, vec_id) AS position "
    "FROM nn WHERE rank = 4",
)
def _(spark, sf_dir):
    return rounded(neighbors.distance_curve(neighbors.knn(vectors(spark, sf_dir), "vec_id", EMBEDDED, 4), "vec_id", 4))


_GOWER = (
    "WITH m AS (SELECT max(p_size) - min(p_size) AS r1, max(p_retailprice) - min(p_retailprice) AS r2 FROM part), "
    "d AS (SELECT a.p_partkey, b.p_partkey AS neighbour, (abs(a.p_size - b.p_size) / r1 + abs(a.p_retailprice - b.p_retailprice) / r2 "
    "+ (a.p_brand <> b.p_brand)::INT + (a.p_type <> b.p_type)::INT) / 4 AS distance FROM part a, part b, m "
    "WHERE a.p_partkey <> b.p_partkey), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, neighbour) AS rank FROM d)"
)


def _gower(spark, sf_dir):
    return neighbors.gower_nearest(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"], ["p_brand", "p_type"])


@query("gower_nearest", f"{_GOWER} SELECT p_partkey, round(distance, 6) AS distance FROM r WHERE rank = 1")
def _(spark, sf_dir):
    return rounded(_gower(spark, sf_dir).select("p_partkey", "distance"))


@query(
    "most_similar_pair",
    f"{_GOWER}, p AS (SELECT least(p_partkey, neighbour) AS first, greatest(p_partkey, neighbour) AS second, distance FROM r "
    "WHERE distance > 0) SELECT round(min(distance), 6) AS distance FROM p",
)
def _(spark, sf_dir):
    return rounded(neighbors.closest_pair(_gower(spark, sf_dir), "p_partkey").select("distance"))


@query(
    "trace_back",
    "WITH m AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM customer), d AS (SELECT s_suppkey, c_custkey, "
    "(abs(s_acctbal - c_acctbal) / r + (s_nationkey <> c_nationkey)::INT) / 2 AS distance FROM supplier, customer, m), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, c_custkey) AS rank FROM d) "
    "SELECT s_suppkey, c_custkey AS neighbour, round(distance, 6) AS distance FROM n WHERE rank = 1",
)
def _(spark, sf_dir):
    """Nearest known row for every new one, over mixed columns; the keys of the tables overlap."""
    known = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    new = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey")
    )
    found = neighbors.gower_nearest(known, "c_custkey", ["c_acctbal"], ["c_nationkey"], queries=new)
    return rounded(found.select(F.col("c_custkey").alias("s_suppkey"), "neighbour", "distance"))


@query(
    "gower_equal_rows",
    "WITH m AS (SELECT max(s) - min(s) AS r FROM (SELECT p_size // 10 AS s FROM part)), "
    "p AS (SELECT p_partkey, p_size // 10 AS s, p_brand FROM part), "
    "d AS (SELECT a.p_partkey, b.p_partkey AS neighbour, (abs(a.s - b.s) / r + (a.p_brand <> b.p_brand)::INT) / 2 AS distance "
    "FROM p a, p b, m WHERE a.p_partkey <> b.p_partkey), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY distance, neighbour) AS INT) AS rank FROM d) "
    "SELECT p_partkey, neighbour, round(distance, 6) AS distance, rank FROM r WHERE rank <= 3",
)
def _(spark, sf_dir):
    """Nearest parts by size class and brand, of which many are equal."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_size") / 10).alias("s"), "p_brand")
    return rounded(neighbors.gower_nearest(parts, "p_partkey", ["s"], ["p_brand"], 3))


@query(
    "knn_far_from_origin",
    "WITH p AS (SELECT s_suppkey, s_acctbal / 1000 + 1e7 AS x, (s_suppkey * 7919 % 1009) / 100 + 1e7 AS y FROM supplier), "
    "d AS (SELECT a.s_suppkey, b.s_suppkey AS neighbour, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a, p b "
    "WHERE a.s_suppkey <> b.s_suppkey), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, neighbour) AS INT) AS rank FROM d) "
    "SELECT s_suppkey, neighbour, round(distance, 6) AS distance, rank FROM r WHERE rank <= 3",
)
def _(spark, sf_dir):
    """Neighbours of points whose distances are small against their coordinates."""
    points = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        (F.col("s_acctbal") / 1000 + 1e7).alias("x"),
        (F.col("s_suppkey") * 7919 % 1009 / 100 + 1e7).alias("y"),
    )
    return rounded(neighbors.knn(points, "s_suppkey", ["x", "y"], 3))


@query("hopkins")
def _(spark, sf_dir):
    return neighbors.hopkins(plane(spark, sf_dir), "c_custkey", ["x", "y"], 50)


# ---- consistency --------------------------------------------------------------------


def _silhouette_sql(label: str, tag: str) -> str:
    return (
        f"l{tag} AS MATERIALIZED (SELECT vec_id, {label} AS g, e FROM v), "
        f"d{tag} AS (SELECT a.vec_id, a.g, b.g AS h, sum({_D}) AS s FROM l{tag} a, l{tag} b GROUP BY 1, 2, 3), "
        f"n{tag} AS (SELECT g, count(*) AS n FROM l{tag} GROUP BY 1), "
        f"w{tag} AS (SELECT vec_id, max(CASE WHEN d{tag}.g = h THEN s / (n - 1) END) AS a, "
        f"min(CASE WHEN d{tag}.g <> h THEN s / n END) AS b FROM d{tag} JOIN n{tag} ON h = n{tag}.g GROUP BY 1)"
    )


def _within_sql(label: str) -> str:
    spread = " + ".join(f"var_pop(e[{i + 1}])" for i in range(DIM))
    return f"(SELECT sum(ss) FROM (SELECT count(*) * ({spread}) AS ss FROM v GROUP BY {label}))"


@query(
    "silhouette_exact",
    f"WITH {_V}, {_silhouette_sql('label', '0')} SELECT round(avg((b - a) / greatest(a, b)), 6) AS avg_silwidth, "
    f"round({_within_sql('label')}, 3) AS within_cluster_ss FROM w0",
)
def _(spark, sf_dir):
    result = consistency.consistency(vectors(spark, sf_dir), "vec_id", EMBEDDED, "label")
    return rounded(result).withColumn("within_cluster_ss", F.round("within_cluster_ss", 3))


@query(
    "cluster_compare",
    f"WITH {_V}, {_silhouette_sql('label', '0')}, {_silhouette_sql('vec_id % 3', '1')} "
    f"SELECT 'label' AS methods, round(avg((b - a) / greatest(a, b)), 6) AS avg_silwidth, round({_within_sql('label')}, 3) "
    "AS within_cluster_ss FROM w0 UNION ALL "
    f"SELECT 'third' AS methods, round(avg((b - a) / greatest(a, b)), 6) AS avg_silwidth, round({_within_sql('vec_id % 3')}, 3) "
    "AS within_cluster_ss FROM w1",
)
def _(spark, sf_dir):
    both = vectors(spark, sf_dir).withColumn("third", (F.col("vec_id") % 3).cast("int"))
    result = consistency.compare_methods(both, "vec_id", EMBEDDED, ["label", "third"])
    return rounded(result).withColumn("within_cluster_ss", F.round("within_cluster_ss", 3))


_SPLIT = "l AS MATERIALIZED (SELECT vec_id, label AS g, e FROM v)"


@query(
    "silhouette_squared",
    f"WITH {_V}, {_SPLIT}, d AS (SELECT a.vec_id, a.g, b.g AS h, sum(pow({_D}, 2)) AS s FROM l a, l b GROUP BY 1, 2, 3), "
    "n AS (SELECT g, count(*) AS n FROM l GROUP BY 1), w AS (SELECT vec_id, max(CASE WHEN d.g = h THEN s / (n - 1) END) AS a, "
    "min(CASE WHEN d.g <> h THEN s / n END) AS b FROM d JOIN n ON h = n.g GROUP BY 1) "
    "SELECT round(avg((b - a) / greatest(a, b)), 6) AS avg_silwidth FROM w",
)
def _(spark, sf_dir):
    return rounded(consistency.squared_silhouette(vectors(spark, sf_dir), EMBEDDED, "label"))


@query(
    "fowlkes_mallows",
    "WITH c AS (SELECT label, vec_id % 7 AS o, count(*) AS n FROM embeddings GROUP BY 1, 2), "
    "t AS (SELECT sum(n * (n - 1) / 2) AS t, sum(n) AS n FROM c), "
    "p AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY label)), "
    "q AS (SELECT sum(n * (n - 1) / 2) AS q FROM (SELECT sum(n) AS n FROM c GROUP BY o)) "
    "SELECT round(t / sqrt(p * q), 6) AS fm_index, round(sqrt(p * q) / (n * (n - 1) / 2), 6) AS expected FROM t, p, q",
)
def _(spark, sf_dir):
    both = table(spark, sf_dir, "embeddings").withColumn("other", F.col("vec_id") % 7)
    return rounded(consistency.fowlkes_mallows(both, "label", "other"))


@query("fowlkes_mallows_null")
def _(spark, sf_dir):
    both = table(spark, sf_dir, "embeddings").withColumn("other", F.col("vec_id") % 7)
    return consistency.null_summary(consistency.fowlkes_mallows_null(both, "label", "other"))


# ---- clustering ---------------------------------------------------------------------

_START = np.array([[0.0, 1.0], [4.0, 6.0], [8.0, 3.0], [9.0, 7.0]])


def _lloyd_sql(steps: int) -> str:
    text = "c0 AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i + 1}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(_START.tolist())
    ) + ") t(cluster, cx, cy))"
    for s in range(steps):
        text += (
            f", a{s} AS (SELECT c_custkey, x, y, arg_min(cluster, pow(x - cx, 2) + pow(y - cy, 2)) AS cluster FROM pts, c{s} "
            f"GROUP BY 1, 2, 3), c{s + 1} AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS size FROM a{s} GROUP BY 1)"
        )
    return text


@query(
    "lloyd_3_steps",
    f"WITH {_PLANE}, {_lloyd_sql(3)} SELECT cluster, size, round(cx, 6) AS x, round(cy, 6) AS y FROM c3",
)
def _(spark, sf_dir):
    points, centres = plane(spark, sf_dir), _START
    for _ in range(2):
        found = kmeans.lloyd_step(points, ["x", "y"], centres).orderBy("cluster").collect()
        centres = np.array([[r["x"], r["y"]] for r in found])
    return rounded(kmeans.lloyd_step(points, ["x", "y"], centres).drop("cost"))


@query("kmeans_labels")
def _(spark, sf_dir):
    """Nine clusters of standardised points, as in the main analysis."""
    scaled = moments.standardise(plane(spark, sf_dir), ["x", "y"])
    fit = kmeans.kmeans(scaled, "c_custkey", ["x", "y"], 9)
    return fit.assign(scaled).select("c_custkey", "cluster")


@query("choose_k_silhouette")
def _(spark, sf_dir):
    return kmeans.choose_k(plane(spark, sf_dir), "c_custkey", ["x", "y"], 5, "silhouette", max_iterations=10)


@query("choose_k_elbow")
def _(spark, sf_dir):
    return kmeans.choose_k(plane(spark, sf_dir), "c_custkey", ["x", "y"], 5, "wss", max_iterations=10)


@query("choose_k_gap")
def _(spark, sf_dir):
    return kmeans.choose_k(plane(spark, sf_dir), "c_custkey", ["x", "y"], 3, "gap", references=2, max_iterations=5)


@query(
    "kmedoids_step",
    f"WITH {_PLANE}, {_lloyd_sql(0)} SELECT c_custkey, arg_min(cluster, pow(x - cx, 2) + pow(y - cy, 2)) AS cluster, "
    "round(sqrt(min(pow(x - cx, 2) + pow(y - cy, 2))), 6) AS distance FROM pts, c0 GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(kmedoids.assignment_step(plane(spark, sf_dir), "c_custkey", ["x", "y"], _START))


@query("kmedoids_labels")
def _(spark, sf_dir):
    points = plane(spark, sf_dir)
    return kmedoids.kmedoids(points, "c_custkey", ["x", "y"], 9, max_iterations=5).assign(points).select("c_custkey", "cluster")


@query(
    "kmedoids_swaps",
    f"WITH {_PLANE}, {_lloyd_sql(0)}, "
    "cand AS (SELECT c_nationkey AS candidate, arg_min(c_acctbal, c_custkey) / 1000 AS x, c_nationkey / 3.0::DOUBLE AS y FROM customer GROUP BY c_nationkey), "
    "d AS (SELECT c_custkey, cluster, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM pts, c0), "
    "kept AS (SELECT a.c_custkey, a.cluster AS medoid, (SELECT count(*) FROM c0) AS k, min(b.d) AS d FROM d a JOIN d b USING (c_custkey) WHERE a.cluster <> b.cluster GROUP BY 1, 2), "
    "now AS (SELECT sum(d) AS total FROM (SELECT min(d) AS d FROM d GROUP BY c_custkey)) "
    "SELECT candidate, medoid, round(sum(least(kept.d, sqrt(pow(p.x - cand.x, 2) + pow(p.y - cand.y, 2)))) - any_value(total), 4) + 0.0 AS change "
    "FROM kept JOIN pts p USING (c_custkey), cand, now GROUP BY 1, 2",
)
def _(spark, sf_dir):
    """What it costs to put the first customer of a nation in the place of each medoid, over all customers."""
    first = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_acctbal", "c_custkey").alias("b")).orderBy("c_nationkey")
    nations = first.select("c_nationkey", F.col("b") / 1000, F.col("c_nationkey") / 3.0).collect()  # a row per nation
    candidates = np.array([[float(r[1]), float(r[2])] for r in nations])
    changes = kmedoids.swap_changes(plane(spark, sf_dir), ["x", "y"], np.array(_START, float), candidates)
    name = F.element_at(F.array(*[F.lit(r[0]) for r in nations]), F.col("candidate") + 1)
    return rounded(changes.select(name.alias("candidate"), (F.col("medoid") + 1).alias("medoid"), "change"), 4)


_EPS, _MIN = 0.35, 9


@query(
    "dbscan_grid",
    f"WITH RECURSIVE {_PLANE}, near AS MATERIALIZED (SELECT a.c_custkey AS p, b.c_custkey AS q FROM pts a, pts b "
    f"WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {_EPS}::DOUBLE * {_EPS}::DOUBLE), "
    f"core AS MATERIALIZED (SELECT p AS k FROM near GROUP BY 1 HAVING count(*) >= {_MIN}), "
    "e AS MATERIALIZED (SELECT p, q FROM near WHERE p IN (SELECT k FROM core) AND q IN (SELECT k FROM core)), "
    "reach(k, root) AS (SELECT k, k FROM core UNION SELECT e.q, r.root FROM reach r JOIN e ON e.p = r.k), "
    "comp AS (SELECT k, min(root) AS root FROM reach GROUP BY 1), "
    "num AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster FROM (SELECT DISTINCT root FROM comp)), "
    "lab AS (SELECT k, cluster FROM comp JOIN num USING (root) UNION ALL "
    "SELECT p, min(cluster) FROM near JOIN comp ON q = k JOIN num USING (root) WHERE p NOT IN (SELECT k FROM core) GROUP BY 1) "
    "SELECT c_custkey, CAST(coalesce(cluster, 0) AS INT) AS cluster FROM pts LEFT JOIN lab ON c_custkey = k",
)
def _(spark, sf_dir):
    return dbscan.dbscan(plane(spark, sf_dir), "c_custkey", ["x", "y"], _EPS, _MIN)


@query(
    "ward_total",
    f"WITH {_PLANE} SELECT round(count(*) * (var_pop(x) + var_pop(y)), 3) AS within_ss, count(DISTINCT (x, y)) - 1 AS merges FROM pts",
)
def _(spark, sf_dir):
    """All merges together add the whole sum of squares: half the sum of the squared heights."""
    tree = ward.ward_tree(plane(spark, sf_dir), "c_custkey", ["x", "y"])
    return rounded(tree.agg((F.sum(F.col("height") * F.col("height")) / 2).alias("within_ss"), F.count(F.lit(1)).alias("merges")), 3)


@query("ward_labels")
def _(spark, sf_dir):
    points = moments.standardise(plane(spark, sf_dir), ["x", "y"])
    tree = ward.ward_tree(points, "c_custkey", ["x", "y"])
    return ward.cut_tree(points, "c_custkey", ["x", "y"], tree, 9)


@query("cluster_hulls")
def _(spark, sf_dir):
    points = plane(spark, sf_dir).withColumn("cluster", (F.floor("x") % 3).cast("int"))
    return hull.cluster_hulls(points, "cluster", "x", "y")


@query("divisive_labels")
def _(spark, sf_dir):
    points = moments.standardise(plane(spark, sf_dir), ["x", "y"])
    return kmeans.divisive(points, ["x", "y"], 9).select("c_custkey", "cluster")
