"""Cube-method mixing: exact targets, totals close to them, reruns that agree."""

import random
import re

import pytest
from pyspark.sql import functions as F

import tallyweave.llm.cube_mixing as m
from tests.llm.test_native import WORD


def check(rows, given):
    """``given`` are (key, text, source)."""
    sizes = {}
    for _, t, s in given:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, m.shares([sizes[s] for s in order], [m.CYCLE[i % 3] for i in range(len(order))])))
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken.setdefault(r["source"], []).append(r)
    for s, rs in taken.items():
        largest = max(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - targets[s]) <= largest
        ratio = targets[s] / sizes[s] if sizes[s] else 0
        assert abs(sum(r["copies"] for r in rs if r["size"]) - ratio * sum(1 for r in rs if r["size"])) <= 3 + sum(1 for r in rs if not r["size"])
    return taken


def test_shares_stop_at_three_times_the_size():
    assert m.shares([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert m.shares([10, 1000], [5, 2]) == pytest.approx([30, 980])
    assert m.shares([0, 5], [5, 1]) == pytest.approx([0, 5])
    assert m.shares([], []) == []


def test_documents(spark, docs):
    first = m.mix(docs, keep=["doc_id", "source"])
    rows = first.collect()
    assert len(rows) == docs.count()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    again = {r["doc_id"]: r["taken"] for r in m.mix(docs.repartition(5), keep=["doc_id", "source"]).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


@pytest.mark.parametrize("per_task", [40, 100_000])
def test_skewed_sources_odd_rows_and_levels(spark, monkeypatch, per_task):
    monkeypatch.setattr(m, "ROWS_PER_TASK", per_task)
    monkeypatch.setattr(m, "LANDING_ROWS", 60)
    rng = random.Random(5)
    given = [(i, "w " * int(rng.paretovariate(1.2)), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(6)])) for i in range(1500)]
    given += [(None, None, None), (1, "", None), (2, "a b", None), (3, "same", "dup"), (3, "same", "dup"), (4, "x " * 30000, "long"), (5, " ", "empty")]
    frame = spark.createDataFrame(given, "doc_id long, text string, source string").withColumn("taken", F.lit("x")).withColumn("id", F.lit(1))
    rows = m.mix(frame, keep=["doc_id", "source", "id"]).collect()
    assert len(rows) == len(given) and "id" in rows[0].asDict()
    check(rows, given)


def test_rows_are_repeated(spark):
    given = [(i, "a b c", "s%d" % (i % 4)) for i in range(80)]
    frame = spark.createDataFrame(given, "doc_id long, text string, source string")
    out = m.mixed_rows(frame)
    assert out.columns == frame.columns
    copies = {r["doc_id"]: r["copies"] for r in m.mix(frame).collect()}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: c for k, c in copies.items() if c}
    assert m.mix(frame.limit(0)).count() == 0 and m.mixed_rows(frame.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    import pandas as pd

    rng = random.Random(7)
    units = pd.DataFrame([(i, 0, rng.randint(1, 500), rng.random(), 0.3) for i in range(1000)], columns=["id", "grp", "size", "dice", "p"])
    out = pd.concat(list(m._flight(iter([units]))))
    assert len(out) == 1000 and abs(out["p"].sum() - 300) < 1e-6
    assert abs((out["p"].astype(float) * out["size"].astype(float)).sum() - 0.3 * units["size"].sum()) < 1e-3
    assert sum(0 < p < 1 for p in out["p"]) <= 2
    assert re.fullmatch("[01.]+", "".join(str(int(p)) for p in out["p"] if p in (0, 1)))


def test_more_sources_than_landing_rows(spark, monkeypatch):
    """Every source keeps an undecided row or two, more in all than fit into one small task."""
    monkeypatch.setattr(m, "LANDING_ROWS", 60)
    rng = random.Random(9)
    given = [(i, "w " * rng.randint(1, 40), "host%d" % rng.randrange(700)) for i in range(3000)]
    given += [(5000 + i, "w " * 2000, "big") for i in range(20)] + [(6000, "a", None), (6001, "", "host~empty")]
    frame = spark.createDataFrame(given, "doc_id long, text string, source string")
    rows = m.mix(frame, keep=["doc_id", "source"]).collect()
    assert len(rows) == len(given)
    taken = check(rows, given)
    assert len(taken) == len({s for _, _, s in given}) > 600 and sum(len(rs) for rs in taken.values()) == len(given)


def test_sources_beyond_the_former_limit(spark):
    frame = spark.range(240_000).selectExpr("id doc_id", "repeat('w ', int(1 + id % 7)) text", "concat('host', id % 120000) source")
    got = m.mix(frame, keep=["doc_id", "source"])
    sums = got.agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.sum("size").alias("all"), F.max(F.abs(F.col("copies") * F.col("source_size") - F.col("target")) / F.col("source_size")).alias("off")).first()
    assert (sums["n"], sums["s"]) == (240_000, 120_000) and sums["off"] < 1 + 1e-9
    targets = got.select("source", "target").distinct().agg(F.sum("target")).first()[0]
    assert abs(targets - sums["all"]) < 1e-6 * sums["all"]
