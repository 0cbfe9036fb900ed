"""Registered queries: recoding, filters, joins, descriptive tables, moments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import recode as R
from tallyweave.operators import combine, missing, moments, outlier, profile, weighted
from tallyweave.operators.ranks import quantiles
from tallyweave.plans import survey_sql as S
from tallyweave.plans.codebook import CROSSTAB_QUESTIONS, FEATURES, FLIPPED, KEY, RECODES, WEIGHT, enrich, ordered_rules
from tallyweave.plans.registry import query, rounded, table
from tallyweave.plans.segments import feature_table, inclusion, scored
from tallyweave.session import shared_dir
from tallyweave.sources import tables as io
from tallyweave.sources.demo_survey import demo_survey


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored survey with a planted label for the included group."""
    return scored(demo_survey(spark, sf_dir)).withColumn(
        "cl_pam", F.when(inclusion(), (1 + F.col(KEY) % 9).cast("int"))
    )


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# ---- recoding -----------------------------------------------------------------------

_MAPPED = [c for c in RECODES if c not in ("leeftijdcat6", "leeftijd70eo")]


@query("recode_map", f"WITH {S.ENRICHED} SELECT volgnummer, {', '.join(_MAPPED)} FROM enriched")
def _(spark, sf_dir):
    survey = demo_survey(spark, sf_dir)
    return survey.select(KEY, *[R.recode(RECODES[c][0], RECODES[c][1]).alias(c) for c in _MAPPED])


@query("recode_range_else", f"WITH {S.ENRICHED} SELECT volgnummer, leeftijdcat6, leeftijd70eo FROM enriched")
def _(spark, sf_dir):
    survey = demo_survey(spark, sf_dir)
    return survey.select(KEY, *[R.recode(*RECODES[c]).alias(c) for c in ("leeftijdcat6", "leeftijd70eo")])


@query("recode_ordered_rules", f"WITH {S.ENRICHED} SELECT volgnummer, {', '.join(S.RULES)} FROM enriched")
def _(spark, sf_dir):
    return demo_survey(spark, sf_dir).select(KEY, *[e.alias(n) for n, e in ordered_rules().items()])


@query(
    "polarity_flip",
    f"WITH {S.ENRICHED} SELECT volgnummer, {', '.join(f'{c}_dich' for c in S.FLIPS)} FROM enriched",
)
def _(spark, sf_dir):
    return enrich(demo_survey(spark, sf_dir)).select(KEY, *[f"{c}_dich" for c in FLIPPED])


@query("issue_score", f"WITH {S.SCORED} SELECT volgnummer, score_zw FROM scored")
def _(spark, sf_dir):
    return scored(demo_survey(spark, sf_dir)).select(KEY, "score_zw")


@query("inclusion_filter", f"WITH {S.INCLUDED} SELECT volgnummer, {S.FEATURE_LIST} FROM included")
def _(spark, sf_dir):
    return feature_table(demo_survey(spark, sf_dir))


@query(
    "focal_group",
    f"WITH {S.INCLUDED} SELECT volgnummer, GGADS201 FROM included WHERE NOT GGADS201 > 40",
)
def _(spark, sf_dir):
    """Included respondents without the flagged outliers: an anti-join on their keys."""
    inside = scored(demo_survey(spark, sf_dir)).where(inclusion()).select(KEY, "GGADS201")
    flagged = outlier.flag_outliers(inside, "GGADS201", 40)
    return combine.without(inside, flagged.where(F.col("outlier") == "Yes"), KEY)


@query(
    "optional_filters",
    f"WITH {S.SURVEY} SELECT volgnummer, LFT0109, Gemeentecode FROM survey "
    "WHERE AGOJB201 = 2016 AND LFT0109 > 64 AND Gemeentecode IN (1, 3, 5, 8)",
)
def _(spark, sf_dir):
    survey = demo_survey(spark, sf_dir)
    wanted = (F.col("AGOJB201") == 2016) & (F.col("LFT0109") > 64) & F.col("Gemeentecode").isin(1, 3, 5, 8)
    return survey.where(wanted).select(KEY, "LFT0109", "Gemeentecode")


@query(
    "complete_rows",
    f"WITH {S.INCLUDED} SELECT volgnummer FROM included WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES),
)
def _(spark, sf_dir):
    return feature_table(demo_survey(spark, sf_dir)).na.drop("any", subset=FEATURES).select(KEY)


@query("labelled_rows", f"WITH {S.LABELLED} SELECT volgnummer, cl_pam FROM labelled WHERE cl_pam IS NOT NULL")
def _(spark, sf_dir):
    return labelled(spark, sf_dir).where(F.col("cl_pam").isNotNull()).select(KEY, "cl_pam")


@query(
    "one_cluster",
    f"WITH {S.LABELLED} SELECT volgnummer, 1 AS vulnerable_suspect FROM labelled WHERE cl_pam = 9",
)
def _(spark, sf_dir):
    chosen = labelled(spark, sf_dir).where(F.col("cl_pam") == 9)
    return chosen.withColumn("vulnerable_suspect", F.lit(1)).select(KEY, "vulnerable_suspect")


@query(
    "key_round_trip",
    "SELECT 'x' || CAST(o_orderkey AS VARCHAR) AS respondent_id, CAST(o_orderkey AS VARCHAR) AS restored FROM orders",
)
def _(spark, sf_dir):
    keyed = table(spark, sf_dir, "orders").select(R.prefixed_key("o_orderkey").alias("respondent_id"))
    return keyed.withColumn("restored", R.stripped_key("respondent_id"))


@query(
    "suffix_rename",
    f"WITH {S.ENRICHED} SELECT volgnummer, GGEEB201_dich, CALGA260 AS CALGA260_dich, LGBPS209 AS LGBPS209_dich, "
    "GGEES203 FROM enriched",
)
def _(spark, sf_dir):
    chosen = enrich(demo_survey(spark, sf_dir)).select(KEY, "GGEEB201_dich", "CALGA260", "LGBPS209", "GGEES203")
    return R.rename_unless(chosen, "_dich", "_dich", keep=[KEY, "GGEES203"])


@query(
    "columns_renamed_dropped",
    "SELECT c_custkey, c_acctbal AS tsne_coord_x1, c_nationkey AS tsne_coord_x2 FROM customer",
)
def _(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").drop("c_name", "c_mktsegment")
    return kept.withColumnsRenamed({"c_acctbal": "tsne_coord_x1", "c_nationkey": "tsne_coord_x2"})


@query(
    "text_to_number",
    "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'onbekend' ELSE CAST(o_totalprice AS VARCHAR) END "
    "AS DOUBLE) AS value FROM orders",
)
def _(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "onbekend").otherwise(F.col("o_totalprice").cast("string"))
    return R.to_numeric(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("value")), ["value"])


@query(
    "sentinel_to_null",
    f"WITH {S.LABELLED} SELECT volgnummer, cl_pam, nullif(KLGGA207, 9) AS KLGGA207, nullif(MMVWB201, 9) AS MMVWB201 "
    "FROM labelled",
)
def _(spark, sf_dir):
    chosen = labelled(spark, sf_dir).select(KEY, "cl_pam", "KLGGA207", "MMVWB201")
    return R.sentinel_to_null(chosen, ["KLGGA207", "MMVWB201"])


@query("null_to_level", f"WITH {S.LABELLED} SELECT volgnummer, coalesce(cl_pam, 0) AS cl_pam FROM labelled")
def _(spark, sf_dir):
    return R.null_to_value(labelled(spark, sf_dir).select(KEY, "cl_pam"), ["cl_pam"])


@query("table_shape", f"WITH {S.INCLUDED} SELECT count(*) AS n_rows, {len(FEATURES) + 1} AS n_cols FROM included")
def _(spark, sf_dir):
    return profile.shape(feature_table(demo_survey(spark, sf_dir)))


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, sf_dir):
    return profile.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5)


@query(
    "random_rows",
    "SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 7919 + 104729) % 1000003, o_orderkey LIMIT 1000",
)
def _(spark, sf_dir):
    order = (F.col("o_orderkey") * 7919 + 104729) % 1000003
    return profile.sampled_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000, order)


# ---- flags and row arithmetic -------------------------------------------------------


@query(
    "membership_dummies",
    f"WITH {S.LABELLED} SELECT volgnummer, "
    + ", ".join(f"CAST(cl_pam = {i} AS INT) AS tsne_kmeans_clus{i}" for i in range(1, 10))
    + ", CASE WHEN cl_pam > 0 THEN 1 ELSE 0 END AS vulnerable, CASE WHEN cl_pam IS NULL THEN 1 ELSE 0 END AS outlier "
    "FROM labelled",
)
def _(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        KEY,
        *R.dummies("cl_pam", 9, "tsne_kmeans_clus"),
        R.member_flag("cl_pam").alias("vulnerable"),
        R.noise_flag("cl_pam").alias("outlier"),
    )


@query(
    "threshold_flags",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS outlier, "
    "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS outlier_fac FROM orders",
)
def _(spark, sf_dir):
    flagged = outlier.flag_outliers(table(spark, sf_dir, "orders"), "o_totalprice", 250000)
    return flagged.select("o_orderkey", "outlier", "outlier_fac")


@query("round_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_tax * 12.5, 1) AS rounded FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", R.round_half_even(F.col("l_tax") * 12.5, 1).alias("rounded")
    )


@query(
    "zscore",
    "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) + 0.0 AS z_acctbal "
    "FROM customer",
)
def _(spark, sf_dir):
    scaled = moments.standardise(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return rounded(scaled.withColumnRenamed("c_acctbal", "z_acctbal"))


# ---- sources and sinks --------------------------------------------------------------


@query(
    "csv_round_trip",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
)
def _(spark, sf_dir):
    path = scratch(spark)
    gaps = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment"
    )
    io.write_csv(gaps, path)
    return io.read_csv(spark, path, "c_custkey bigint, c_acctbal double, c_mktsegment string")


@query("snapshot_round_trip", f"WITH {S.INCLUDED} SELECT volgnummer, {S.FEATURE_LIST} FROM included")
def _(spark, sf_dir):
    path, scope = scratch(spark), io.RunScope("south", features=22, k=9, perplexity=40)
    io.save_snapshot(feature_table(demo_survey(spark, sf_dir)), path, scope)
    return io.load_snapshot(spark, path, scope)


@query(
    "report_sink",
    "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
)
def _(spark, sf_dir):
    path = scratch(spark)
    io.write_report(profile.category_counts(table(spark, sf_dir, "customer"), ["c_mktsegment"]), path)
    return spark.read.schema("c_mktsegment string, n bigint").option("header", True).option("sep", " ").csv(path)


# ---- joins --------------------------------------------------------------------------


@query(
    "bind_columns",
    "SELECT o_orderkey, o_totalprice, (o_orderkey * 7919 + 104729) % 10007 AS mark FROM orders",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    marks = orders.select("o_orderkey", ((F.col("o_orderkey") * 7919 + 104729) % 10007).alias("mark"))
    return combine.bind(orders.select("o_orderkey", "o_totalprice"), marks, "o_orderkey")


@query(
    "label_everyone",
    f"WITH {S.LABELLED} SELECT volgnummer, coalesce(cl_pam, 0) AS cl_pam, CASE WHEN cl_pam IS NULL THEN 1 ELSE 0 END "
    "AS outlier FROM labelled",
)
def _(spark, sf_dir):
    everyone = labelled(spark, sf_dir)
    labels = everyone.where(F.col("cl_pam").isNotNull()).select(KEY, "cl_pam")
    return combine.label_everyone(everyone.select(KEY), labels, KEY, "cl_pam")


@query(
    "outer_merge",
    'SELECT coalesce(a.k, b.k) AS k, a.label AS "label.x", b.label AS "label.y", a.price, b.quality FROM '
    "(SELECT doc_id AS k, lang AS label, n_chars AS price FROM documents) a FULL JOIN "
    "(SELECT doc_id + 100 AS k, CAST(toxic AS VARCHAR) AS label, quality FROM labels) b ON a.k = b.k",
)
def _(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("k"), F.col("lang").alias("label"), F.col("n_chars").alias("price")
    )
    right = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 100).alias("k"), F.col("toxic").cast("string").alias("label"), "quality"
    )
    return combine.merge(left, right, "k", "full")


@query(
    "label_merge",
    f"WITH {S.LABELLED} SELECT volgnummer, cl_pam, 1 + LFT0109 % 4 AS other FROM labelled WHERE cl_pam IS NOT NULL",
)
def _(spark, sf_dir):
    everyone = labelled(spark, sf_dir)
    first = everyone.where(F.col("cl_pam").isNotNull()).select(KEY, "cl_pam")
    second = everyone.select(KEY, (1 + F.col("LFT0109") % 4).alias("other"))
    return combine.merge(first, second, KEY, "inner")


@query(
    "left_merge",
    f"WITH {S.LABELLED} SELECT volgnummer, LFT0109, CASE WHEN cl_pam <> 9 THEN cl_pam END AS cl FROM labelled",
)
def _(spark, sf_dir):
    everyone = labelled(spark, sf_dir)
    labels = everyone.where(F.col("cl_pam") != 9).select(KEY, F.col("cl_pam").alias("cl"))
    return combine.merge(everyone.select(KEY, "LFT0109"), labels, KEY, "left")


@query(
    "rows_appended",
    "SELECT c_custkey AS k, c_acctbal AS balance, 'customer' AS side FROM customer UNION ALL "
    "SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier",
)
def _(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("side")
    )
    b = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("side"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k")
    )
    return combine.append(a, b)


# ---- descriptive tables -------------------------------------------------------------


@query(
    "null_profile",
    f"WITH {S.INCLUDED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM included" for c in FEATURES
    ),
)
def _(spark, sf_dir):
    return profile.null_counts(feature_table(demo_survey(spark, sf_dir)), FEATURES)


_PROFILED = ["GGEES203", "GGEEB201", "MMIKB201", "LFT0109", "score_zw", *FEATURES]


@query(
    "column_profile",
    f"WITH {S.SCORED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, round(count({c}) / count(*), 6) AS complete_rate, "
        f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, "
        f"CAST(min({c}) AS DOUBLE) AS q0, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, "
        f"CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75, "
        f"CAST(max({c}) AS DOUBLE) AS q100 FROM scored"
        for c in _PROFILED
    ),
)
def _(spark, sf_dir):
    return rounded(profile.column_profile(scored(demo_survey(spark, sf_dir)), _PROFILED))


@query(
    "missing_pattern",
    f"WITH {S.INCLUDED} SELECT "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS {c}" for c in FEATURES)
    + f", count(*) AS n FROM included GROUP BY {', '.join(str(i + 1) for i in range(len(FEATURES)))}",
)
def _(spark, sf_dir):
    return missing.missing_patterns(feature_table(demo_survey(spark, sf_dir)), FEATURES)


_GAPS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in FEATURES)


@query(
    "flux",
    f"WITH {S.INCLUDED}, g AS (SELECT *, {_GAPS} AS m FROM included) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(count({c}) / count(*), 6) AS pobs, "
        f"round(sum(CASE WHEN {c} IS NULL THEN {len(FEATURES)} - m ELSE 0 END) / sum({len(FEATURES)} - m), 6) AS influx, "
        f"round(sum(CASE WHEN {c} IS NULL THEN 0 ELSE m END) / sum(m), 6) AS outflux FROM g"
        for c in FEATURES
    ),
)
def _(spark, sf_dir):
    return rounded(missing.flux(feature_table(demo_survey(spark, sf_dir)), FEATURES))


@query("category_counts", f"WITH {S.LABELLED} SELECT cl_pam, count(*) AS n FROM labelled GROUP BY 1")
def _(spark, sf_dir):
    return profile.category_counts(labelled(spark, sf_dir), ["cl_pam"])


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def _(spark, sf_dir):
    return profile.distinct_count(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("weights_on", f"WITH {S.SURVEY} SELECT max(ewGGD) > 1 AS weight_on FROM survey")
def _(spark, sf_dir):
    return profile.weights_on(demo_survey(spark, sf_dir), WEIGHT)


@query(
    "weighted_share",
    f"WITH {S.LABELLED} SELECT cl_pam, sum(ewGGD) AS weight, round(100.0 * sum(ewGGD) / (SELECT sum(ewGGD) FROM labelled), 6) "
    "AS pct FROM labelled GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(weighted.weighted_share(labelled(spark, sf_dir), "cl_pam", WEIGHT))


@query(
    "weighted_share_complete",
    f"WITH {S.LABELLED}, l AS (SELECT * FROM labelled WHERE cl_pam IS NOT NULL) SELECT cl_pam, sum(ewGGD) AS weight, "
    "round(100.0 * sum(ewGGD) / (SELECT sum(ewGGD) FROM l), 6) AS pct FROM l GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(weighted.weighted_share(labelled(spark, sf_dir), "cl_pam", WEIGHT, na_rm=True))


_MEANS = {
    "leeftijd_w": "LFT0109",
    "samenloop_w": "score_zw",
    "eenzaam_w": "GGEES203",
    "regie_w": "GGRLS202",
    "depri_w": "GGADS201",
    "rondkomen_w": "MMIKB201",
}


@query(
    "weighted_mean_by_group",
    f"WITH {S.LABELLED} SELECT cl_pam, "
    + ", ".join(
        f"round(sum({c} * ewGGD) / sum(CASE WHEN {c} IS NOT NULL THEN ewGGD END), 6) AS {n}" for n, c in _MEANS.items()
    )
    + " FROM labelled GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(weighted.weighted_means(labelled(spark, sf_dir), ["cl_pam"], _MEANS, WEIGHT))


_CELLS = (
    "cells AS (SELECT c_mktsegment AS r, o_orderpriority AS l, sum(o_totalprice) AS w FROM orders JOIN customer "
    "ON o_custkey = c_custkey GROUP BY 1, 2)"
)


@query(
    "crosstab_rowpct",
    f"WITH {_CELLS} SELECT r AS row, l AS level, round(w, 2) AS weight, round(100.0 * w / sum(w) OVER (PARTITION BY r), 6) "
    "AS pct FROM cells",
)
def _(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    cells = weighted.crosstab(joined, "c_mktsegment", "o_orderpriority", "o_totalprice")
    return rounded(cells).withColumn("weight", F.round("weight", 2))


_LONG = " UNION ALL ".join(
    f"SELECT '{q}' AS question, cl_pam AS r, CAST({q} AS VARCHAR) AS l, ewGGD FROM labelled "
    f"WHERE cl_pam IS NOT NULL AND {q} IS NOT NULL"
    for q in CROSSTAB_QUESTIONS
)
_MANY = (
    f"{S.LABELLED}, long AS ({_LONG}), cells AS (SELECT question, r, l, sum(ewGGD) AS w FROM long GROUP BY 1, 2, 3), "
    "frame AS (SELECT a.question, a.r, b.l FROM (SELECT DISTINCT question, r FROM cells) a JOIN "
    "(SELECT DISTINCT question, l FROM cells) b ON a.question = b.question), "
    "full_cells AS (SELECT f.question, f.r, f.l, coalesce(c.w, 0.0) AS w FROM frame f LEFT JOIN cells c "
    "ON f.question = c.question AND f.r = c.r AND f.l = c.l)"
)


@query(
    "crosstab_many",
    f"WITH {_MANY} SELECT question, r AS row, l AS level, w AS weight, "
    "round(100.0 * w / sum(w) OVER (PARTITION BY question, r), 6) AS pct FROM full_cells",
)
def _(spark, sf_dir):
    return rounded(weighted.crosstabs(labelled(spark, sf_dir), "cl_pam", CROSSTAB_QUESTIONS, WEIGHT))


@query(
    "crosstab_chisq",
    f"WITH {_MANY}, e AS (SELECT *, sum(w) OVER (PARTITION BY question, r) * sum(w) OVER (PARTITION BY question, l) / "
    "sum(w) OVER (PARTITION BY question) AS e FROM full_cells) SELECT question, round(sum((w - e) * (w - e) / e), 6) AS "
    "statistic, (count(DISTINCT r) - 1) * (count(DISTINCT l) - 1) AS df, sum(w) AS total FROM e GROUP BY 1",
)
def _(spark, sf_dir):
    cells = weighted.crosstabs(labelled(spark, sf_dir), "cl_pam", CROSSTAB_QUESTIONS, WEIGHT)
    return rounded(weighted.chi_square(cells, p_value=False))


_VULNERABLE = (
    f"{S.LABELLED}, flagged AS (SELECT *, CASE WHEN cl_pam > 0 THEN 1 ELSE 0 END AS vulnerable FROM labelled), "
    "cells AS (SELECT Gemeentecode AS r, CAST(vulnerable AS VARCHAR) AS l, sum(ewGGD) AS w FROM flagged GROUP BY 1, 2), "
    "frame AS (SELECT a.r, b.l FROM (SELECT DISTINCT r FROM cells) a, (SELECT DISTINCT l FROM cells) b), "
    "full_cells AS (SELECT f.r, f.l, coalesce(c.w, 0.0) AS w FROM frame f LEFT JOIN cells c ON f.r = c.r AND f.l = c.l)"
)


@query(
    "vulnerable_by_municipality",
    f"WITH {_VULNERABLE} SELECT r AS Gemeentecode, l AS vulnerable, w AS weight, "
    "round(100.0 * w / sum(w) OVER (PARTITION BY r), 6) AS pct FROM full_cells",
)
def vulnerable_by_municipality(spark, sf_dir):
    """Weighted share of vulnerable respondents per municipality."""
    flagged = scored(demo_survey(spark, sf_dir)).withColumn("vulnerable", inclusion().cast("int"))
    flagged = flagged.withColumn("vulnerable", F.coalesce("vulnerable", F.lit(0)))
    cells = weighted.crosstab(flagged, "Gemeentecode", "vulnerable", WEIGHT)
    return rounded(cells.withColumnsRenamed({"row": "Gemeentecode", "level": "vulnerable"}))


def _box_sql(source: str, by: str, value: str) -> str:
    return (
        f"WITH q AS (SELECT {by} AS g, quantile_cont({value}, 0.25) AS q25, quantile_cont({value}, 0.5) AS q50, "
        f"quantile_cont({value}, 0.75) AS q75 FROM {source} GROUP BY 1), "
        f"p AS (SELECT q.*, {value} AS v, {value} BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside "
        f"FROM {source} JOIN q ON {by} = g) "
        f"SELECT g AS {by}, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, "
        "round(min(CASE WHEN inside THEN v END), 6) AS whisker_low, round(max(CASE WHEN inside THEN v END), 6) AS whisker_high, "
        "CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers, count(*) AS n FROM p GROUP BY g, q25, q50, q75"
    )


@query("boxplot", _box_sql("events", "event_type", "value"))
def _(spark, sf_dir):
    return rounded(profile.boxplot(table(spark, sf_dir, "events"), "value", ["event_type"]))


_CUMULATED = (
    f"{S.LABELLED}, v AS (SELECT cl_pam, LFT0109 AS x, sum(ewGGD) AS w, count(*) AS n FROM labelled "
    "WHERE LFT0109 IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY cl_pam ORDER BY x) AS cum, "
    "sum(w) OVER (PARTITION BY cl_pam) AS total FROM v), q AS (SELECT cl_pam, "
    "min(CASE WHEN cum >= 0.25 * total THEN x END) AS q25, min(CASE WHEN cum >= 0.5 * total THEN x END) AS q50, "
    "min(CASE WHEN cum >= 0.75 * total THEN x END) AS q75 FROM c GROUP BY 1)"
)


@query(
    "weighted_boxplot",
    f"WITH {_CUMULATED}, p AS (SELECT q.*, x, v.n, x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside "
    "FROM v JOIN q ON v.cl_pam IS NOT DISTINCT FROM q.cl_pam) SELECT cl_pam, CAST(q25 AS DOUBLE) AS q25, "
    "CAST(q50 AS DOUBLE) AS q50, CAST(q75 AS DOUBLE) AS q75, CAST(min(CASE WHEN inside THEN x END) AS DOUBLE) AS whisker_low, "
    "CAST(max(CASE WHEN inside THEN x END) AS DOUBLE) AS whisker_high, "
    "CAST(sum(CASE WHEN inside THEN 0 ELSE n END) AS BIGINT) AS n_outliers, CAST(sum(n) AS BIGINT) AS n "
    "FROM p GROUP BY cl_pam, q25, q50, q75",
)
def _(spark, sf_dir):
    return rounded(profile.boxplot(labelled(spark, sf_dir), "LFT0109", ["cl_pam"], WEIGHT))


@query(
    "boxplot_with_means",
    f"WITH {_CUMULATED}, m AS (SELECT cl_pam, round(sum(LFT0109 * ewGGD) / sum(ewGGD), 6) AS mean_w FROM labelled GROUP BY 1) "
    "SELECT q.cl_pam, CAST(q25 AS DOUBLE) AS q25, CAST(q50 AS DOUBLE) AS q50, CAST(q75 AS DOUBLE) AS q75, mean_w "
    "FROM q JOIN m ON q.cl_pam IS NOT DISTINCT FROM m.cl_pam",
)
def _(spark, sf_dir):
    survey = labelled(spark, sf_dir)
    boxes = quantiles(survey, "LFT0109", [0.25, 0.5, 0.75], ["cl_pam"], WEIGHT)
    means = weighted.weighted_means(survey, ["cl_pam"], {"mean_w": "LFT0109"}, WEIGHT)
    return rounded(combine.beside(boxes, means, "cl_pam"))


@query(
    "histogram_density",
    "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n FROM lineitem), "
    "b AS (SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, lo, hi, e.n AS total "
    "FROM lineitem, e WHERE l_quantity IS NOT NULL) SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS x_from, "
    "count(*) AS n, round(count(*) / (total * ((hi - lo) / 30)), 6) AS density FROM b GROUP BY bin, lo, hi, total",
)
def _(spark, sf_dir):
    return rounded(profile.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 30))


def _bins_sql(column: str, source: str, bins: int) -> str:
    return (
        f"SELECT '{column}' AS variable, CAST(b.bin AS INT) AS bin, round(lo + b.bin * ((hi - lo) / {bins}), 6) AS x_from, coalesce(c.n, 0) AS n, "
        f"round(coalesce(c.n, 0) / (total * ((hi - lo) / {bins})), 6) AS density "
        f"FROM (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi, count({column}) AS total FROM {source}) e "
        f"CROSS JOIN (SELECT unnest(range({bins})) AS bin) b LEFT JOIN (SELECT least(floor(({column} - l) / ((h - l) / {bins})), {bins - 1}) AS bin, count(*) AS n "
        f"FROM {source}, (SELECT CAST(min({column}) AS DOUBLE) AS l, CAST(max({column}) AS DOUBLE) AS h FROM {source}) WHERE {column} IS NOT NULL GROUP BY 1) c ON c.bin = b.bin"
    )


_BINNED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("column_histograms", " UNION ALL ".join(_bins_sql(c, "lineitem", 40) for c in _BINNED))
def _(spark, sf_dir):
    """Histograms of all number columns in two scans, bins without rows included."""
    return rounded(profile.histograms(table(spark, sf_dir, "lineitem"), _BINNED, 40))


@query(
    "sorted_sink",
    "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS line FROM orders GROUP BY 1",
)
def _(spark, sf_dir):
    """Rows written in order and read back: their places in the files are their ranks."""
    path = scratch(spark)
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    io.write_csv(sums.withColumn("down", -F.col("n")), path, sort_by=["down", "o_custkey"])
    stored = io.read_csv(spark, path, "o_custkey bigint, n bigint, total double, down bigint")
    placed = stored.withColumns({"file": F.col("_metadata.file_name"), "at": F.col("_metadata.file_block_start"), "row": F.monotonically_increasing_id()})
    sizes = placed.groupBy("file", "at").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("first"))
    before = Window.partitionBy(F.lit(0)).orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of a file
    offsets = sizes.select("file", "at", "first", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), ["file", "at"]).select("o_custkey", "n", "total", (F.col("offset") + F.col("row") - F.col("first")).alias("line"))


@query("declared_schema", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(NULL AS DOUBLE) AS s_rating FROM supplier")
def _(spark, sf_dir):
    """A declared schema picks columns; one that the files lack is null."""
    kind = table(spark, sf_dir, "supplier").schema
    wanted = T.StructType([kind["s_suppkey"], kind["s_name"], T.StructField("s_rating", T.DoubleType())])
    return io.read_table(spark, f"{sf_dir}/supplier.parquet", wanted).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query(
    "kde_curve",
    "WITH s AS (SELECT event_type AS g, count(value) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx, "
    "quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1), "
    "t AS (SELECT *, 0.9 * least(sd, coalesce(nullif(iqr / 1.34, 0.0), sd)) * pow(n, -0.2) AS bw FROM s), "
    "u AS (SELECT *, mn - 3 * bw AS lo, (mx - mn + 6 * bw) / 127 AS step FROM t), "
    "p AS (SELECT u.*, (value - lo) / step AS pos FROM events JOIN u ON event_type = g WHERE value IS NOT NULL), "
    "c AS (SELECT g, CAST(floor(pos) AS BIGINT) AS i, 1 - (pos - floor(pos)) AS m FROM p UNION ALL "
    "SELECT g, CAST(floor(pos) AS BIGINT) + 1, pos - floor(pos) FROM p), "
    "b AS (SELECT g, i, sum(m) AS m FROM c GROUP BY 1, 2), "
    "pts AS (SELECT CAST(range AS INT) AS point FROM range(128)) "
    "SELECT u.g AS event_type, pts.point, round(any_value(u.lo + pts.point * u.step), 6) AS x, "
    "round(sum(b.m * exp(-0.5 * pow((pts.point - b.i) * u.step / u.bw, 2.0))) / (any_value(u.n * u.bw) * sqrt(2 * pi())), 6) "
    "AS density FROM u JOIN b ON u.g = b.g, pts GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return rounded(profile.density_curve(table(spark, sf_dir, "events"), "value", ["event_type"], points=128))


@query(
    "share_of_total",
    "SELECT c_mktsegment, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1",
)
def _(spark, sf_dir):
    counts = profile.category_counts(table(spark, sf_dir, "customer"), ["c_mktsegment"])
    return rounded(profile.share_of_total(counts, "n").drop("n"))


@query(
    "stacked_shares",
    f"WITH {_CELLS}, p AS (SELECT r AS row, l AS level, 100.0 * w / sum(w) OVER (PARTITION BY r) AS pct FROM cells) "
    "SELECT row, level, round(sum(pct) OVER (PARTITION BY row ORDER BY level), 6) AS stack_to FROM p",
)
def _(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    cells = weighted.crosstab(joined, "c_mktsegment", "o_orderpriority", "o_totalprice")
    return rounded(profile.stacked_shares(cells, "row", "level", "pct").select("row", "level", "stack_to"))


def _bins_sql(bins: int) -> str:
    probabilities = ", ".join(f"{i / bins!r}" for i in range(bins + 1))
    return (
        f"WITH e AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [{probabilities}]))) AS edges FROM customer), "
        "b AS (SELECT CAST(greatest(1, len(list_filter(edges, lambda x: x < c_acctbal))) AS INT) AS bin, edges FROM customer, e) "
        "SELECT bin, count(*) AS n, round(edges[bin], 6) AS x_from, round(edges[bin + 1], 6) AS x_to FROM b GROUP BY bin, edges"
    )


@query("quantile_bins", _bins_sql(8))
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return rounded(profile.bin_counts(customers, "c_acctbal", profile.bin_edges(customers, "c_acctbal", 8)))


@query(
    "equal_bins",
    f"WITH {S.SCORED}, e AS (SELECT min(GGADS201) AS lo, max(GGADS201) AS hi, ceil(log2(count(GGADS201))) + 1 AS k FROM scored), "
    "b AS (SELECT CAST(greatest(1, ceil((GGADS201 - lo) * k / (hi - lo))) AS INT) AS bin, lo, hi, k FROM scored, e) "
    "SELECT bin, count(*) AS n, round(lo + (hi - lo) * (bin - 1) / k, 6) AS x_from, round(lo + (hi - lo) * bin / k, 6) AS x_to "
    "FROM b GROUP BY bin, lo, hi, k",
)
def _(spark, sf_dir):
    survey = scored(demo_survey(spark, sf_dir)).select("GGADS201")
    return rounded(profile.bin_counts(survey, "GGADS201", profile.bin_edges(survey, "GGADS201", kind="equal")))


@query(
    "last_bin_threshold",
    "WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) "
    "SELECT round(lo + (hi - lo) * 9 / 10, 6) AS threshold FROM e",
)
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    edges = profile.bin_edges(customers, "c_acctbal", 10, kind="equal")
    return rounded(profile.last_bin_threshold(profile.bin_counts(customers, "c_acctbal", edges)))


# ---- moments ------------------------------------------------------------------------

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row, '{b}' AS column, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem" for a in _LINE for b in _LINE
    ),
)
def _(spark, sf_dir):
    return rounded(moments.correlation_matrix(table(spark, sf_dir, "lineitem"), _LINE))


@query(
    "cov_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row, '{b}' AS column, round(covar_samp({a}, {b}), 3) + 0.0 AS cov FROM lineitem" for a in _LINE for b in _LINE
    ),
)
def _(spark, sf_dir):
    return rounded(moments.covariance_matrix(table(spark, sf_dir, "lineitem"), _LINE), 3)


@query(
    "mean_vector",
    " UNION ALL ".join(f"SELECT '{a}' AS variable, round(avg({a}), 6) AS mean FROM lineitem" for a in _LINE),
)
def _(spark, sf_dir):
    return rounded(moments.mean_vector(table(spark, sf_dir, "lineitem"), _LINE))


_MISSED = FEATURES


_PREDICTORS = (
    f"WITH {S.INCLUDED}, m AS MATERIALIZED (SELECT "
    + ", ".join(
        f"greatest(coalesce(abs(corr({a}, {b})), 0), coalesce(abs(corr(CASE WHEN {a} IS NULL THEN 1 ELSE 0 END, {b})), 0)) "
        f"AS s_{i}_{j}"
        for i, a in enumerate(FEATURES)
        for j, b in enumerate(FEATURES)
        if i != j
    )
    + " FROM included), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS target, '{b}' AS predictor, s_{i}_{j} AS strength FROM m"
        for i, a in enumerate(FEATURES)
        for j, b in enumerate(FEATURES)
        if i != j
    )
    + ") SELECT target, predictor FROM c WHERE strength >= 0.2"
)


@query("predictor_select", _PREDICTORS)
def _(spark, sf_dir):
    return missing.select_predictors(feature_table(demo_survey(spark, sf_dir)), FEATURES, mincor=0.2)


@query("predictor_store", _PREDICTORS)
def _(spark, sf_dir):
    path = scratch(spark)
    io.save_predictors(missing.select_predictors(feature_table(demo_survey(spark, sf_dir)), FEATURES, mincor=0.2), path)
    return io.load_predictors(spark, path)


@query(
    "median_fill",
    f"WITH {S.INCLUDED}, m AS MATERIALIZED (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _MISSED)
    + " FROM included) SELECT volgnummer, "
    + ", ".join(f"CAST(coalesce(i.{c}, m.{c}) AS DOUBLE) AS {c}" for c in _MISSED)
    + " FROM included i, m",
)
def _(spark, sf_dir):
    chosen = feature_table(demo_survey(spark, sf_dir)).select(KEY, *_MISSED)
    return missing.median_fill(chosen, _MISSED)


def _bartlett_sql(columns: list[str], source: str) -> str:
    k = len(columns)
    moments_ = ", ".join(f"CAST(count({c}) - 1 AS DOUBLE) AS f{i}, var_samp({c}) AS v{i}" for i, c in enumerate(columns))
    total = " + ".join(f"f{i}" for i in range(k))
    pooled = "(" + " + ".join(f"f{i} * v{i}" for i in range(k)) + f") / ({total})"
    logs = " + ".join(f"f{i} * ln(v{i})" for i in range(k))
    inverse = " + ".join(f"1 / f{i}" for i in range(k))
    return (
        f"m AS (SELECT {moments_} FROM {source}) SELECT round((({total}) * ln({pooled}) - ({logs})) / "
        f"(1 + ({inverse} - 1 / ({total})) / (3 * {k - 1})), 6) AS statistic, {k - 1} AS df FROM m"
    )


@query("bartlett", f"WITH {S.INCLUDED}, {_bartlett_sql(FEATURES, 'included')}")
def _(spark, sf_dir):
    return rounded(moments.variance_homogeneity(feature_table(demo_survey(spark, sf_dir)), FEATURES, p_value=False))


@query(
    "sphericity",
    "WITH r AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c, "
    "count(*) AS n FROM lineitem) SELECT round(-(n - 1 - 11.0 / 6) * ln(1 + 2 * a * b * c - a * a - b * b - c * c), 6) AS "
    "statistic, 3 AS df FROM r",
)
def _(spark, sf_dir):
    tested = moments.sphericity(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(tested.drop("p_value"))


_INVERSE = (
    "WITH s AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, var_samp(l_quantity) AS a, "
    "covar_samp(l_quantity, l_discount) AS b, covar_samp(l_quantity, l_tax) AS c, var_samp(l_discount) AS d, "
    "covar_samp(l_discount, l_tax) AS e, var_samp(l_tax) AS f FROM lineitem), "
    "i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s), "
    "x AS (SELECT l_orderkey, l_linenumber, l_quantity - m1 AS x, l_discount - m2 AS y, l_tax - m3 AS z, i.* FROM lineitem, i) "
    "SELECT l_orderkey, l_linenumber, round(((d * f - e * e) * x * x + (a * f - c * c) * y * y + (a * d - b * b) * z * z "
    "+ 2 * ((c * e - b * f) * x * y + (b * e - c * d) * x * z + (b * c - a * e) * y * z)) / det, 6) AS \"MD\" FROM x"
)


@query("mahalanobis_3", _INVERSE)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    placed = outlier.mahalanobis(lines, ["l_quantity", "l_discount", "l_tax"], digits=6)
    return placed.select("l_orderkey", "l_linenumber", "MD")


@query("mahalanobis_outliers")
def _(spark, sf_dir):
    """Distance of the complete included respondents over all features, with the flag."""
    complete = feature_table(demo_survey(spark, sf_dir)).na.drop("any", subset=FEATURES)
    placed = outlier.mahalanobis(complete, FEATURES)
    return outlier.flag_outliers(placed, "MD", 49.3).select(KEY, "MD", "outlier", "outlier_fac")


@query("robust_mahalanobis")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_extendedprice", "l_discount"
    )
    chosen = ["l_quantity", "l_extendedprice", "l_discount"]
    return outlier.robust_mahalanobis(lines, "k", chosen, starts=1, steps=3).select("k", "MD")


@query(
    "partition_summary",
    "WITH x AS (SELECT o_orderpriority AS g, o_totalprice / 1000 AS x, o_custkey / 100.0 AS y FROM orders), "
    "c AS (SELECT g, count(*) AS size, avg(x) AS mx, avg(y) AS my, var_pop(x) + var_pop(y) AS v FROM x GROUP BY 1), "
    "t AS (SELECT avg(x) AS gx, avg(y) AS gy FROM x) "
    "SELECT round(sum(size * v + size * (pow(mx - gx, 2) + pow(my - gy, 2))), 2) AS total_ss, round(sum(size * v), 2) AS within_ss, "
    "round(sum(size * (pow(mx - gx, 2) + pow(my - gy, 2))), 2) AS between_ss, count(*) AS k, CAST(sum(size) AS BIGINT) AS n FROM c, t",
)
def _(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") / 100.0).alias("y")
    )
    return rounded(moments.fit_summary(moments.partition_summary(points, ["x", "y"], "g")), 2)
