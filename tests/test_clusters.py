import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import blocks, components, consistency, dbscan, hull, kmeans, kmedoids, neighbors, ward
from tallyweave.operators.blocks import as_points, distinct_points


def frame(spark, x, names=("x", "y")):
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(11)
    centres = np.array([[0, 0], [8, 0], [0, 8], [9, 9]])
    return np.vstack([rng.normal(c, 0.7, (60, 2)) for c in centres])


# ---- neighbours ---------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_nearest_points_over_many_blocks(spark, blobs, block_rows, monkeypatch):
    monkeypatch.setattr(blocks.build_blocks, "__defaults__", (17, block_rows, 1024, None))
    merged = distinct_points(frame(spark, blobs), "k", ["x", "y"])
    got = neighbors.nearest_points(as_points(merged, ["x", "y"]), 3).toPandas()
    d = distances(blobs)
    np.fill_diagonal(d, np.inf)
    expected = np.sort(d, axis=1)[:, :3]
    assert np.allclose(got.sort_values(["id", "rank"]).distance.to_numpy().reshape(-1, 3), expected)


def test_pruning_leaves_cells_out(spark, blobs):
    merged = distinct_points(frame(spark, blobs), "k", ["x", "y"])
    data = blocks.build_blocks(as_points(merged, ["x", "y"]), block_rows=8)
    assert blocks.cells_within_reach(data, data, 3).mean() < 0.6


def test_knn_with_a_hot_duplicate_group(spark):
    x = np.vstack([np.zeros((40, 2)), [[1, 0], [0, 2], [3, 3], [3, 3]]])
    got = neighbors.knn(frame(spark, x), "k", ["x", "y"], 3).toPandas()
    d = distances(x)
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:3]
        mine = got[got.k == i].sort_values("rank")
        assert list(mine.neighbour) == [j for _, j in order]
        assert np.allclose(mine.distance, [a for a, _ in order])


def test_gower_with_missing_values(spark):
    df = spark.createDataFrame([(0, 0.0, "a"), (1, 10.0, "a"), (2, None, "b"), (3, 9.0, "b")], "k long, v double, c string")
    got = {r["k"]: (r["neighbour"], r["distance"]) for r in neighbors.gower_nearest(df, "k", ["v"], ["c"]).collect()}
    assert got[2] == (3, 0.0)
    assert got[0][0] == 1 and got[0][1] == pytest.approx(0.5)
    assert got[3] == (2, 0.0)


def test_gower_meets_few_boxes_and_loses_nothing(spark, monkeypatch):
    """Many boxes with missing values: the neighbours of all pairs, from a small part of the pairs."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(4)
    v, c = rng.random(1500).round(4), rng.integers(0, 12, 1500)
    rows = [(i, None if i % 41 == 0 else float(v[i]), None if i % 37 == 0 else f"c{c[i]}") for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, v double, c string")
    seen = []
    meet = blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda q, d, cells, *rest: seen.append(q.count @ cells @ d.count) or meet(q, d, cells, *rest))
    got = {r["k"]: (r["distance"], r["neighbour"]) for r in neighbors.gower_nearest(df, "k", ["v"], ["c"]).collect()}
    x = np.array([np.nan if r[1] is None else r[1] for r in rows])
    codes = np.array([np.nan if r[2] is None else float(r[2][1:]) for r in rows])
    gap, other = np.abs(x[:, None] - x), np.abs(codes[:, None] - codes)
    parts = np.stack([gap / (np.nanmax(x) - np.nanmin(x)), np.where(np.isnan(other), np.nan, (other > 0).astype(float))])
    used = (~np.isnan(parts)).sum(0)
    truth = np.where(used > 0, np.nansum(parts, 0) / np.maximum(used, 1), np.inf)
    np.fill_diagonal(truth, np.inf)
    with_any = [i for i in range(1500) if rows[i][1] is not None or rows[i][2] is not None]
    assert sorted(got) == with_any
    assert np.allclose([got[i][0] for i in with_any], truth[with_any].min(1), atol=1e-12)
    assert len(seen) == 2 and sum(seen) < 0.4 * 1500**2


def test_blocks_of_a_tile_answer_together(spark, blobs):
    """What a point finds leaves once per tile, not once per block, and a sum likewise."""
    labels = np.repeat(np.arange(4), 60).astype(int)
    pdf = pd.DataFrame({"id": np.arange(240), "x": blobs.tolist(), "w": 1.0, "labels": [[int(v)] for v in labels]})
    points = spark.createDataFrame(pdf, "id long, x array<double>, w double, labels array<int>")
    data = blocks.build_blocks(points, block_rows=16)
    everything = blocks.every_cell(data, data)
    assert data.chunks.sum() > 8
    found = blocks.meet(data, data, everything, blocks.nearest_kernel(3), blocks.FOUND, blocks.best_of(3))
    assert found.count() == 240 * 3
    schema = "id long, method int, cluster int, total double"
    sums = blocks.meet(data, data, everything, blocks.cluster_sums_kernel, schema, blocks.added).toPandas()
    assert len(sums) == 240 * 4
    truth = distances(blobs) @ (labels[:, None] == np.arange(4))
    assert np.allclose(sums.total, truth[sums.id, sums.cluster])


def test_tiles_are_sent_once_per_strip_or_range(spark, blobs, monkeypatch):
    """4,000,000 points of 64 numbers are 257 tiles: each went to 257 pairs, it goes to 4 ranges or 16 strips and one."""
    met = np.ones((257, 257), dtype=bool)
    met[5, 250:] = False
    size = 4_000_000 * 536
    sent, visits = blocks._visits(met, size, size)
    assert len(sent[False][0]) <= 257 * 4 and len(sent[True][0]) <= 257 * 16 and visits == 64
    held = {side: [set(tile[visit == v]) for v in range(visits)] for side, (tile, visit) in sent.items()}
    pairs = [(q, d) for a, b in zip(held[False], held[True]) for q in a for d in b if met[q, d]]
    assert len(pairs) == len(set(pairs)) == met.sum()
    grown, _ = blocks._visits(np.ones((1028, 1028), dtype=bool), 4 * size, 4 * size)
    assert max(np.bincount(grown[False][1])) * blocks.TILE_BYTES <= 1.1 * blocks.STRIP_BYTES

    # many strips and ranges of small tiles give what one gives
    merged = distinct_points(frame(spark, blobs), "k", ["x", "y"])
    for name, value in (("BLOCK_ROWS", 16), ("STRIPS", 3), ("RANGES", 2)):
        monkeypatch.setattr(blocks, name, value)
    data = blocks.build_blocks(as_points(merged, ["x", "y"]), block_rows=16)
    everything = blocks.every_cell(data, data)
    raw = blocks.meet(data, data, everything, blocks.nearest_kernel(3), blocks.FOUND, blocks.best_of(3))
    assert raw.count() == 2 * 3 * len(blobs)  # the three nearest of every range
    got = blocks._nearest_of(raw, 3).toPandas().sort_values(["id", "rank"])
    d = distances(blobs)
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got.distance.to_numpy().reshape(-1, 3), np.sort(d, axis=1)[:, :3])
    labelled = distinct_points(frame(spark, blobs).withColumn("c", (F.col("k") / 60).cast("int")), "k", ["x", "y"], ["c"])
    data = blocks.build_blocks(as_points(labelled, ["x", "y"], ["c"]), block_rows=16)
    schema = "id long, method int, cluster int, total double"
    sums = blocks.meet(data, data, blocks.every_cell(data, data), blocks.cluster_sums_kernel, schema, blocks.added)
    sums = sums.groupBy("id", "cluster").agg(F.sum("total").alias("t")).toPandas().pivot(index="id", columns="cluster", values="t")
    assert np.allclose(sums.sort_index().to_numpy(), distances(blobs).reshape(240, 4, 60).sum(2))


def test_squared_distances_where_the_product_cancels():
    rng = np.random.default_rng(3)
    a = np.vstack([rng.normal(0, 1, (200, 16)), np.full((3, 16), 1e4)])
    b = np.vstack([a + 1e-7, rng.normal(0, 1, (300, 16))])
    assert np.allclose(blocks._squared_closely(a, b), blocks._apart(a, b), rtol=1e-9, atol=0)


def _gower_pairs(rows, others, k):
    """(key, neighbours by distance and key) in plain Python; ``others`` None: the rows themselves."""
    data = rows if others is None else others
    spans = [max(v) - min(v) for v in [[r[1] for r in data if r[1] is not None]]]
    found = {}
    for a in rows:
        near = []
        for b in data:
            if others is None and a[0] == b[0]:
                continue
            parts = []
            if a[1] is not None and b[1] is not None:
                parts.append(abs(a[1] - b[1]) / spans[0])
            if a[2] is not None and b[2] is not None:
                parts.append(float(a[2] != b[2]))
            if parts:
                near.append((round(sum(parts) / len(parts), 9), b[0]))
        found[a[0]] = sorted(near)[:k]
    return found


def test_gower_with_equal_rows_and_foreign_keys(spark):
    rng = np.random.default_rng(8)
    def some(n):
        return [
            (i + 1, None if rng.random() < 0.1 else float(rng.integers(0, 5)), None if rng.random() < 0.1 else "abc"[rng.integers(0, 3)]) for i in range(n)
        ]

    rows, new = [*some(60), *[(i + 100, 2.0, "a") for i in range(40)], (500, None, None), (501, None, None)], some(25)
    kind = "k long, v double, c string"
    df, asked = spark.createDataFrame(rows, kind), spark.createDataFrame(new, kind)  # the keys overlap
    for queries, truth in ((None, _gower_pairs(rows, None, 3)), (asked, _gower_pairs(new, rows, 3))):
        got = {}
        for r in neighbors.gower_nearest(df, "k", ["v"], ["c"], 3, queries).orderBy("k", "rank").collect():
            got.setdefault(r["k"], []).append((round(r["distance"], 9), r["neighbour"]))
        assert got == {k: v for k, v in truth.items() if v}


@pytest.mark.parametrize("away", [0.0, 1e7])
def test_knn_far_from_the_origin(spark, away):
    x = np.random.default_rng(9).random((300, 2)) + away
    got = neighbors.knn(frame(spark, x), "k", ["x", "y"], 2).toPandas().sort_values(["k", "rank"])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.array_equal(got.neighbour.to_numpy().reshape(-1, 2), np.argsort(d, axis=1, kind="stable")[:, :2])


def test_silhouette_without_labels_in_a_block(spark):
    x = np.vstack([np.random.default_rng(1).normal(c, 0.2, (60, 2)) for c in (0, 9, 200)])
    df = frame(spark, x).withColumn("m", F.when(F.col("k") < 120, (F.col("k") / 60).cast("int") + 1).otherwise(F.lit(0)))
    got = consistency.consistency(df, "k", ["x", "y"], "m", noise="drop").first()
    assert got["avg_silwidth"] > 0.9


def test_hopkins_separates_uniform_from_clustered(spark, blobs):
    rng = np.random.default_rng(2)
    flat = frame(spark, rng.random((240, 2)))
    assert neighbors.hopkins(flat, "k", ["x", "y"], 40).first()[0] < 0.65
    assert neighbors.hopkins(frame(spark, blobs), "k", ["x", "y"], 40).first()[0] > 0.75


# ---- consistency --------------------------------------------------------------------


def brute_silhouette(x, labels):
    d, out = distances(x), []
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_matches_brute_force(spark, blobs):
    x = np.vstack([blobs.round(0), [[30, 30]]])  # many equal rows and a cluster of one
    labels = np.append(np.arange(len(blobs)) // 60 + 1, 9)
    other = np.arange(len(x)) % 3
    df = frame(spark, x).withColumn("one", F.lit(1))
    df = df.join(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(labels, other))], "k long, cl int, o int"), "k")
    got = {r["methods"]: r for r in consistency.compare_methods(df, "k", ["x", "y"], ["cl", "o", "one"]).collect()}
    assert got["cl"]["avg_silwidth"] == pytest.approx(brute_silhouette(x, labels))
    assert got["o"]["avg_silwidth"] == pytest.approx(brute_silhouette(x, other))
    assert got["one"]["avg_silwidth"] is None
    within = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels))
    assert got["cl"]["within_cluster_ss"] == pytest.approx(within)
    dropped = df.withColumn("cl", F.when(F.col("cl") != 9, F.col("cl")).otherwise(0))
    clean = consistency.consistency(dropped, "k", ["x", "y"], "cl", noise="drop").first()
    assert clean["avg_silwidth"] == pytest.approx(brute_silhouette(x[:-1], labels[:-1]))


def test_fowlkes_mallows_and_its_null(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, 90), rng.integers(0, 4, 90)
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(a, b)], "a int, b int")
    same = (a[:, None] == a) & ~np.eye(90, dtype=bool), (b[:, None] == b) & ~np.eye(90, dtype=bool)
    expected = (same[0] & same[1]).sum() / np.sqrt(same[0].sum() * same[1].sum())
    found = consistency.fowlkes_mallows(df, "a", "b").first()
    assert found["fm_index"] == pytest.approx(expected)
    null = consistency.fowlkes_mallows_null(df, "a", "b", repetitions=400)
    assert null.agg(F.avg("fm_index")).first()[0] == pytest.approx(found["expected"], abs=0.01)


# ---- clustering ---------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 7])
def test_kmeans_finds_blobs_whatever_the_partitioning(spark, blobs, partitions):
    df = frame(spark, blobs).repartition(partitions)
    fits = [kmeans.kmeans(df, "k", ["x", "y"], 4, seed=s) for s in (1, 2, 3, 4)]
    best = min(fits, key=lambda f: f.within_ss)
    assert sorted(best.sizes) == [60, 60, 60, 60]
    assert fits[0].within_ss == pytest.approx(kmeans.kmeans(frame(spark, blobs), "k", ["x", "y"], 4, seed=1).within_ss)


def test_choose_k(spark, blobs):
    df = frame(spark, blobs)
    scores = kmeans.choose_k(df, "k", ["x", "y"], 6, "silhouette", seed=3)
    assert kmeans.best_k(scores) == 4
    elbow = [r["score"] for r in kmeans.choose_k(df, "k", ["x", "y"], 4, "wss", seed=3).orderBy("k").collect()]
    assert elbow == sorted(elbow, reverse=True)


def test_medoids_are_exact(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 1.5, (80, 2)) for c in ([0, 0], [7, 1], [3, 8])]).round(2)
    df = frame(spark, x)
    found = kmedoids.kmedoids(df, "k", ["x", "y"], 3, cells=32)
    labels = found.assign(df).orderBy("k").toPandas().cluster.to_numpy()
    d = distances(x)
    for c in (1, 2, 3):
        inside = np.flatnonzero(labels == c)
        best = d[np.ix_(inside, inside)].sum(0).min()
        medoid = found.ids[c - 1]
        assert d[medoid, inside].sum() == pytest.approx(best)
        assert np.allclose(found.points[c - 1], x[medoid])


def test_no_rows_have_no_neighbours(spark):
    none = frame(spark, np.zeros((2, 2))).limit(0)
    assert neighbors.knn(none, "k", ["x", "y"], 3).count() == 0


def brute_change(x, w, medoids, candidates):
    cost = lambda m: (w * np.sqrt(((x[:, None] - m[None]) ** 2).sum(2)).min(1)).sum()
    now, out = cost(medoids), {}
    for c, p in enumerate(candidates):
        for m in range(len(medoids)):
            out[c, m] = cost(np.vstack([np.delete(medoids, m, 0), p])) - now
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
def test_changes_of_all_swaps(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(300, 2)).round(1)
    df = frame(spark, x).withColumn("w", (F.col("k") % 3 + 1).cast("double")).repartition(5)
    medoids, candidates = x[:k], np.vstack([x[50:57], x[:1]])
    got = {(r["candidate"], r["medoid"]): r["change"] for r in kmedoids.swap_changes(df, ["x", "y"], medoids, candidates).collect()}
    want = brute_change(x, np.arange(300) % 3 + 1.0, medoids, candidates)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    best = kmedoids.best_swap(df, ["x", "y"], medoids, candidates)
    assert best[2] == pytest.approx(min(want.values())) and want[best[:2]] == pytest.approx(best[2])
    assert kmedoids.best_swap(df.limit(0), ["x", "y"], medoids, candidates) in (None, (0, 0, 0.0))


def test_no_pivot_is_worth_a_swap_at_the_end(spark, monkeypatch):
    """A start with two medoids in one group and none in another is left by a swap."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.4, (70, 2)) for c in ([0, 0], [20, 0], [20, 8])]).round(3)
    monkeypatch.setattr(kmedoids, "_build", lambda m, w, k: np.array([[0.0, 0.3], [0.0, -0.3], [20.0, 0.0]]))
    df = frame(spark, x)
    seen = []
    plain = kmedoids.swap_changes
    monkeypatch.setattr(kmedoids, "swap_changes", lambda r, c, m, p: (seen.append((m, p)), plain(r, c, m, p))[1])
    found = kmedoids.kmedoids(df, "k", ["x", "y"], 3, cells=24)
    d = distances(x)
    assert sorted(i // 70 for i in found.ids) == [0, 1, 2]
    assert found.cost == pytest.approx(d[:, found.ids].min(1).sum())
    assert len(seen) >= 2 and all(len(p) == 24 for _, p in seen)
    assert min(brute_change(x, np.ones(len(x)), *seen[-1]).values()) > -1e-6


def brute_dbscan(x, eps, min_points):
    near = distances(x) <= eps
    core = near.sum(1) >= min_points
    labels, cluster = np.zeros(len(x), dtype=int), 0
    for i in range(len(x)):
        if core[i] and labels[i] == 0:
            cluster += 1
            queue = [i]
            while queue:
                p = queue.pop()
                if labels[p] == 0:
                    labels[p] = cluster
                    if core[p]:
                        queue.extend(np.flatnonzero(near[p]))
    return labels


@pytest.mark.parametrize("case,direct", [("blobs", 64), ("hot", 0), ("borders", 64), ("ring", 0)])
def test_dbscan_matches_brute_force(spark, case, direct, monkeypatch):
    monkeypatch.setattr(dbscan, "DIRECT", direct)  # 0 sends every dense pair through the boxes
    rng = np.random.default_rng(7)
    if case == "blobs":
        x = np.vstack([rng.normal(c, 0.3, (80, 2)) for c in ([0, 0], [3, 0], [-2, -2])] + [rng.uniform(-4, 5, (40, 2))])
    elif case == "hot":
        x = np.vstack([np.zeros((100, 2)), rng.normal(0, 0.05, (150, 2)), [[0.5, 0.0], [0.8, 0], [2, 2]]])
    elif case == "borders":
        x = np.array([[i * 0.25, 0.0] for i in range(-8, 9)] + [[0.0, 0.5], [0.0, -0.5], [10, 10]])
    else:
        angle = rng.uniform(0, 2 * np.pi, 300)
        x = np.vstack([np.c_[np.cos(angle), np.sin(angle)] * 3, np.c_[np.cos(angle), np.sin(angle)] * 1.2])
    eps, min_points = 0.4, 4
    got = dbscan.dbscan(frame(spark, x), "k", ["x", "y"], eps, min_points).orderBy("k").toPandas().cluster.to_numpy()
    assert (got == brute_dbscan(x, eps, min_points)).all()


def test_dbscan_does_not_depend_on_partitioning(spark, blobs):
    df = frame(spark, blobs)
    a = dbscan.dbscan(df.repartition(1), "k", ["x", "y"], 0.6, 4).collect()
    b = dbscan.dbscan(df.repartition(7), "k", ["x", "y"], 0.6, 4).collect()
    assert sorted(a) == sorted(b)


def brute_ward(x):
    """Heights of Ward's tree by the Lance-Williams update on squared distances."""
    d = distances(x) ** 2
    np.fill_diagonal(d, np.inf)
    size, alive, heights = np.ones(len(x)), list(range(len(x))), []
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(sub.argmin(), sub.shape)
        a, b = sorted((alive[i], alive[j]))
        heights.append(np.sqrt(d[a, b]))
        for c in alive:
            if c not in (a, b):
                n = size[a] + size[b] + size[c]
                d[a, c] = d[c, a] = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * d[a, b]) / n
        size[a] += size[b]
        alive.remove(b)
    return np.array(heights)


@pytest.mark.parametrize("on_driver", [40, 1000])
def test_ward_heights(spark, blobs, on_driver):
    x = blobs[::3]
    df = frame(spark, x)
    tree = ward.ward_tree(df, "k", ["x", "y"], on_driver=on_driver)
    got = np.sort(tree.toPandas().height.to_numpy())
    assert np.allclose(got, np.sort(brute_ward(x)))
    labels = ward.cut_tree(df, "k", ["x", "y"], tree, 4).orderBy("k").toPandas().cluster.to_numpy()
    assert (labels == np.arange(len(x)) // 20 + 1).all()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "src long, dst long")
    got = dict(components.connected_components(edges).collect())
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50))


def test_hull_contains_every_point(spark, blobs):
    df = frame(spark, blobs).withColumn("cl", F.when(F.col("k") < 120, 1).otherwise(2)).repartition(5)
    for c, part in hull.cluster_hulls(df, "cl", "x", "y").toPandas().groupby("cluster"):
        p = part.sort_values("vertex")[["x", "y"]].to_numpy()
        inside = blobs[:120] if c == 1 else blobs[120:]
        for a, b in zip(p, np.roll(p, -1, axis=0)):
            cross = (b[0] - a[0]) * (inside[:, 1] - a[1]) - (b[1] - a[1]) * (inside[:, 0] - a[0])
            assert (cross >= -1e-9).all()


def test_medoid_update_evaluates_few_rows(spark, monkeypatch):
    """The rows evaluated exactly do not grow with the table, and the medoid stays exact."""
    monkeypatch.setattr(kmedoids, "CHUNK", 32)
    seen, plain = [], kmedoids._exact_costs
    monkeypatch.setattr(kmedoids, "_exact_costs", lambda df, c, chunk: (seen.append(len(chunk)), plain(df, c, chunk))[1])
    x = np.random.default_rng(5).normal(0, 1, (6000, 2)).round(6)
    found = kmedoids.kmedoids(frame(spark, x), "k", ["x", "y"], 1, max_iterations=0, cells=16)
    costs = np.array([np.sqrt(((x - p) ** 2).sum(1)).sum() for p in x])
    assert found.ids == [int(costs.argmin())]
    assert found.cost == pytest.approx(costs.min())
    assert sum(seen) <= 5 * 32


def test_slopes_bound_the_costs_of_all_rows(spark):
    """Every tangent plane lies below the costs, also at repeated rows and rows of one line."""
    x = np.array([[i % 7, 0.0] for i in range(40)] + [[3.0, i] for i in range(5)])
    df = distinct_points(frame(spark, x), "k", ["x", "y"]).withColumn("cluster", F.lit(1))
    rows = df.select("id", "w", "x", "y", "cluster").collect()
    totals, slopes = kmedoids._exact_costs(df.withColumn("w", F.col("w").cast("double")), ["x", "y"], rows)
    y = np.array([[r["x"], r["y"]] for r in rows], float)
    w = np.array([r["w"] for r in rows], float)
    assert np.allclose(totals, [(w * np.sqrt(((y - p) ** 2).sum(1))).sum() for p in y])
    for total, slope, p in zip(totals, slopes, y):
        assert (total + (y - p) @ slope <= totals * (1 + 1e-12)).all()


def test_neighbours_found_bound_what_later_blocks_bring():
    """Once a query has k neighbours, a block brings only nearer ones, not k more; ties and far data included."""
    rng = np.random.default_rng(8)
    for shift, scale in ((0.0, 1.0), (1e7, 1.0), (0.0, 1e-6)):
        x = np.round(rng.normal(0, 1, (6000, 12)), 1) * scale + shift
        x[5000:5010] = x[:10]  # ties at nothing
        ids, k = np.arange(len(x)), 7
        kernel, fold = blocks.nearest_kernel(k), blocks.best_of(k)
        found, brought = None, 0
        for lo in range(0, len(x), 500):
            best = {"best": found} if found else {}
            part = kernel(ids[:500], x[:500], None, ids[lo : lo + 500], x[lo : lo + 500], None, None, **best)
            brought += len(part["id"])
            found = fold([found, part] if found else [part])
        if shift == 0:
            assert brought < 12 * 500 * k / 2  # all of them before
        d = np.sqrt(((x[:500, None, :] - x[None, :, :]) ** 2).sum(2))
        d[np.arange(500), np.arange(500)] = np.inf
        order = np.stack([np.lexsort((ids, row))[:k] for row in d])
        assert (found["neighbour"].reshape(500, k) == order).all()
        assert np.allclose(found["distance"].reshape(500, k), np.take_along_axis(d, order, axis=1), rtol=1e-12)
