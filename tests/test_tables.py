import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.functions.special import beta_cdf, chi_square_tail, exact_binomial_interval
from tallyweave.operators import combine, missing, moments, outlier, profile, weighted
from tallyweave.operators import ranks
from tallyweave.operators.ranks import quantiles, ranked


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one group holds most of them."""
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.8, "hot", "cold")
    x = np.where(rng.random(3000) < 0.33, 5.0, rng.normal(0, 10, 3000).round(3))
    w = rng.integers(1, 9, 3000) * 0.125
    pdf = pd.DataFrame({"k": range(3000), "g": g, "x": x, "w": w})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles_match_numpy(skewed, partitions):
    pdf, df = skewed
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df.repartition(partitions), "x", probabilities, ["g"]).collect()
    for row in got:
        expected = np.quantile(pdf.loc[pdf.g == row["g"], "x"], probabilities)
        assert np.allclose(list(row)[1:], expected)
    overall = quantiles(df, "x", probabilities).first()
    assert np.allclose(list(overall), np.quantile(pdf.x, probabilities))


def test_one_quantile_puts_few_rows_in_order(spark, monkeypatch):
    df = spark.range(60_000).select((F.xxhash64("id") / 1e12).alias("x"), F.floor(F.rand(3) * 9).alias("few"), F.lit(1.5).alias("same"))
    ordered = []
    plain = ranks.ordered_totals
    monkeypatch.setattr(ranks, "ordered_totals", lambda rows, *rest, **more: (ordered.append(rows.count()), plain(rows, *rest, **more))[1])
    x = df.toPandas()
    for p in (0.0, 0.75, 1.0):
        assert ranks.exact_quantile(df, "x", p) == pytest.approx(np.quantile(x.x, p), rel=1e-14)
    assert max(ordered) < 600
    assert ranks.exact_quantile(df, "few", 0.75) == np.quantile(x.few, 0.75) and ranks.exact_quantile(df, "same", 0.75) == 1.5
    assert ranks.exact_quantile(df.limit(0), "x", 0.5) is None
    monkeypatch.setattr(ranks, "SKETCH", 7)  # a sketch that is far off
    assert ranks.exact_quantile(df, "x", 0.75) == pytest.approx(np.quantile(x.x, 0.75), rel=1e-14)


def test_weighted_quantiles(skewed):
    pdf, df = skewed
    for row in quantiles(df, "x", [0.25, 0.5], ["g"], "w").collect():
        part = pdf[pdf.g == row["g"]].sort_values("x")
        share = part.groupby("x").w.sum().cumsum()
        for q, p in ((row["q25"], 0.25), (row["q50"], 0.5)):
            assert q == share.index[np.argmax(share.to_numpy() >= p * share.iloc[-1])]


def test_ranks_are_a_permutation(skewed):
    pdf, df = skewed
    got = ranked(df, "x", ["k"], ["g"]).toPandas()
    expected = pdf.sort_values(["x", "k"]).groupby("g").cumcount()
    assert (got.set_index("k")["rank"].sort_index() == expected.sort_index()).all()


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0)], "g int, x double")
    assert {(r["g"], r["q50"]) for r in quantiles(df, "x", [0.5], ["g"]).collect()} == {(None, 2.0), (1, 2.0)}


def test_bins_cover_every_row(skewed):
    pdf, df = skewed
    for kind in ("quantile", "equal"):
        edges = profile.bin_edges(df, "x", kind=kind)
        counts = profile.bin_counts(df, "x", edges).collect()
        assert sum(r["n"] for r in counts) == len(pdf)
        assert None not in [r["bin"] for r in counts]
    assert profile.sturges(1000) == 11


def test_density_integrates_to_one(skewed):
    _, df = skewed
    for curve in (profile.density_curve(df, "x", ["g"], 256), profile.density_curve(df, "x", (), 256)):
        for _, part in curve.toPandas().groupby("g" if "g" in curve.columns else lambda _: 0):
            part = part.sort_values("x")
            assert abs(np.trapezoid(part.density, part.x) - 1) < 0.01


def test_crosstab_has_empty_cells_and_leaves_out_nulls(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 3.0), (2, "a", 2.0), (None, "a", 9.0), (2, None, 9.0)], "r int, q string, w double"
    )
    got = {(r["row"], r["level"]): (r["weight"], r["pct"]) for r in weighted.crosstab(df, "r", "q", "w").collect()}
    assert got == {(1, "a"): (1.0, 25.0), (1, "b"): (3.0, 75.0), (2, "a"): (2.0, 100.0), (2, "b"): (0.0, 0.0)}
    tested = weighted.chi_square(weighted.crosstabs(df, "r", ["q"], "w")).first()
    assert tested["statistic"] == pytest.approx(3.0) and tested["df"] == 1
    assert tested["p_value"] == pytest.approx(0.0832645, abs=1e-6)


def test_weighted_mean_drops_value_and_weight(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, None, 5.0), (1, 4.0, 3.0), (2, None, 1.0)], "g int, x double, w double")
    got = {r["g"]: r["m"] for r in weighted.weighted_means(df, ["g"], {"m": "x"}, "w").collect()}
    assert got == {1: 3.5, 2: None}


def test_special_functions():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi_square_tail(1.0, 0) is None
    assert beta_cdf(0.3, 2, 5) == pytest.approx(0.579825)
    assert exact_binomial_interval(8, 10) == pytest.approx((0.4439045, 0.9747893), abs=1e-6)


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(50, 5, 400)
    pdf = pd.DataFrame({"k": range(400), "a": a, "b": a + rng.normal(0, 3, 400), "c": rng.integers(0, 2, 400).astype(float)})
    pdf.loc[rng.random(400) < 0.2, "b"] = np.nan
    pdf.loc[pdf.a > 55, "c"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, a double, b double, c double")


@pytest.mark.parametrize("partitions", [1, 5])
def test_pair_sums_match_pandas(gappy, partitions):
    pdf, df = gappy
    sums = moments.pair_sums(df.repartition(partitions), ["a", "b", "c"])
    assert np.allclose(sums.corr, pdf[["a", "b", "c"]].corr())
    assert np.allclose(sums.cov, pdf[["a", "b", "c"]].cov())
    gone = pdf[["a", "b", "c"]].isna().astype(float)
    for j, t in enumerate("abc"):
        for k, p in enumerate("abc"):
            both = pd.concat([gone[t], pdf[p]], axis=1).dropna()
            expected = both.iloc[:, 0].corr(both.iloc[:, 1]) if both.iloc[:, 0].std() > 0 else np.nan
            assert np.isclose(sums.missing_corr[j, k], expected, equal_nan=True)


def test_predictors_see_missingness(gappy):
    _, df = gappy
    chosen = missing.predictor_matrix(moments.pair_sums(df, ["a", "b", "c"]), 0.35)
    assert "a" in chosen["c"] and "a" in chosen["b"] and "c" not in chosen["a"]


def test_flux_definition(gappy):
    pdf, df = gappy
    r = pdf[["a", "b", "c"]].notna().to_numpy().astype(float)
    got = {x["variable"]: x for x in missing.flux(df, ["a", "b", "c"]).collect()}
    for j, name in enumerate("abc"):
        influx = ((1 - r[:, j])[:, None] * r).sum() / r.sum()
        outflux = (r[:, j][:, None] * (1 - r)).sum() / (1 - r).sum()
        assert got[name]["influx"] == pytest.approx(influx)
        assert got[name]["outflux"] == pytest.approx(outflux)


def test_standardise_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = moments.standardise(df, ["a", "b"]).orderBy("a").collect()
    assert rows[0]["a"] == pytest.approx(-1 / math.sqrt(2)) and rows[0]["b"] is None


def test_mahalanobis_properties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k int, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    got = outlier.mahalanobis(df, cols, digits=None).orderBy("k").toPandas()
    centred = x - x.mean(0)
    expected = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(np.cov(x.T)), centred)
    assert np.allclose(got.MD, expected)
    assert got.MD.mean() == pytest.approx(4 * 299 / 300)
    doubled = df.withColumn("e", F.col("a") + F.col("b"))
    singular = outlier.mahalanobis(doubled, [*cols, "e"], digits=None).orderBy("k").toPandas()
    assert np.allclose(singular.MD, expected)


def test_robust_distance_is_not_masked(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    x[:60] = rng.normal(size=(60, 2)) * 0.3 + 12
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double")
    robust = outlier.robust_mahalanobis(df, "k", ["a", "b"], steps=5).toPandas().set_index("k").MD
    classic = outlier.mahalanobis(df, ["a", "b"]).toPandas().set_index("k").MD
    assert robust[:60].min() > 100 > classic[:60].max()


def test_label_everyone_and_merge_suffixes(spark):
    everyone = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    labels = spark.createDataFrame([(1, 3)], "k int, cl int")
    got = {tuple(r) for r in combine.label_everyone(everyone, labels, "k", "cl").select("k", "cl", "outlier").collect()}
    assert got == {(1, 3, 0), (2, 0, 1)}
    assert combine.merge(everyone, everyone, "k", "full").columns == ["k", "v.x", "v.y"]


def test_median_fill(gappy):
    pdf, df = gappy
    got = missing.median_fill(df, ["b", "c"]).orderBy("k").toPandas()
    assert np.allclose(got.b, pdf.b.fillna(pdf.b.median()))
    assert np.allclose(got.c, pdf.c.fillna(pdf.c.median()))


def test_ranks_with_a_third_of_equal_values(spark):
    """Ranks are those of one sort, and no task sorts more than its share of a hot value."""
    from tallyweave.operators.ranks import BUCKETS, _bucketed, ranked

    rows = [(i, 5.0 if i % 3 == 0 else float(i % 997)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r["k"]: (r["rank"], r["size"]) for r in ranked(df, "v", ["k"]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {k: (i, 30_000) for i, (k, _) in enumerate(order)}
    hot = df.where("v = 5").withColumns({"n": F.lit(1), "w": F.lit(0.0)})
    sizes = [r["count"] for r in _bucketed(hot, ["v"], "k", BUCKETS).groupBy("__bucket").count().collect()]
    assert max(sizes) < 4 * sum(sizes) / BUCKETS


def test_histograms_keep_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 5, None), (1.0, 5, None), (10.0, 5, None), (None, 5, None)], "a double, b int, c double")
    rows = {(r["variable"], r["bin"]): (r["x_from"], r["n"], r["density"]) for r in profile.histograms(df, ["a", "b", "c"], 5).collect()}
    assert [rows["a", i][1] for i in range(5)] == [2, 0, 0, 0, 1] and rows["a", 4] == (8.0, 1, 1 / 6)
    assert [rows["b", i][1] for i in range(5)] == [4, 0, 0, 0, 0] and rows["b", 0][2] is None
    assert not any(v == "c" for v, _ in rows)
    assert profile.histogram(df.where("a IS NULL"), "a").count() == 0
