"""A survey-shaped table derived from ``orders`` and ``customer``.

The text is plain SQL that Spark and DuckDB both run, with integer arithmetic and dyadic
weights, so that both give the same rows at every size. It plants nine groups of
respondents (key modulo 9), nulls and unknown codes. Products are reduced modulo 10007
before they are multiplied, so that keys of any size stay within 64 bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyweave.session import shared_dir

_PRIME = 10007


def _noise(a: int) -> str:
    return f"h{a}"


def _noise_columns() -> str:
    """The pseudo-random columns, computed once each below the CASE expressions."""
    used = [*range(31, 50), 74, 90, 92, 98, 102, 104, 110, 114, 120, 128, 132, 134, 138, 140, 144, 158, 162, 168]
    return ", ".join(f"(kk * {a} + kp * {7919 + 2 * (a - 31)}) % {_PRIME} AS h{a}" for a in used)


def _item(a: int, shift: int, issue: str, other: str, missing: str = "NULL") -> str:
    h = _noise(a)
    cut = f"(CASE WHEN (g * 3 + {shift}) % 9 < 3 THEN 7000 ELSE 1200 END)"
    return (
        f"CASE WHEN {h} % 37 = 0 THEN {missing} WHEN {h} < {cut} THEN {issue.format(h=h)} "
        f"ELSE {other.format(h=h)} END"
    )


def _spread(a: int, low: int, n: int) -> str:
    return f"{low} + (({_noise(a)} % 7 + g) % {n})"


def _columns() -> dict[str, str]:
    columns = {
        "LFT0109": "18 + (k * 7) % 75",
        "Lftklassen": "CASE WHEN k % 101 = 0 THEN 99 ELSE 1 + (k * 5) % 14 END",
        "KwintielInk": "1 + (k % 5)",
        "MMWSA205": "CASE WHEN k % 41 = 0 THEN 9 WHEN (k * 13) % 10 < 6 THEN 1 ELSE 0 END",
        "MMWSA211": "CASE WHEN k % 41 = 0 THEN 9 WHEN (k * 17) % 10 < 1 THEN 1 ELSE 0 END",
        "MMVWB201": "CASE WHEN k % 43 = 0 THEN 9 WHEN (k * 19) % 10 < 3 THEN 1 ELSE 0 END",
        "MCMZGS203": "CASE WHEN k % 47 = 0 THEN 9 WHEN (k * 23) % 10 < 2 THEN 1 ELSE 0 END",
        "GGEES203": "(g * 2 + (k * 29) % 4) % 12",
        "GGRLS202": "35 - (g * 3 + (k * 31) % 7) % 29",
        "GGADS201": "10 + (g * 4 + (k * 37) % 11) % 41",
        "KLGGA207": "CASE WHEN k % 53 = 0 THEN 9 ELSE 1 + (g + (k * 41) % 3) % 3 END",
    }
    three = ("3", "1 + {h} % 2")
    one_of_three = ("1", "2 + {h} % 2")
    yes_no = ("1", "0")
    four = ("4", "1 + {h} % 3")
    one_of_five = ("1", "2 + {h} % 4")
    low_of_five = ("1 + {h} % 2", "3 + {h} % 3")
    items = [
        ("GGEEB201", three), ("GGEEB203", one_of_three), ("GGEEB204", three), ("GGEEB207", three),
        ("GGEEB208", three), ("CALGA260", yes_no), ("CALGA261", yes_no), ("LGBPS209", yes_no),
        ("MMIKB201", four), ("GGRLB201", one_of_five), ("GGRLB202", one_of_five), ("GGRLB204", one_of_five),
        ("GGADB207", low_of_five), ("GGADB210", low_of_five), ("GGADB201", low_of_five),
        ("GGADB202", low_of_five), ("GGADB204", low_of_five), ("GGRLB206", one_of_five),
        ("MCMZOS304", yes_no),
    ]
    for i, (name, (issue, other)) in enumerate(items):
        columns[name] = _item(31 + i, 5 * i, issue, other, "9" if name == "MCMZOS304" else "NULL")
    for name, a, unknown, low, n in [
        ("GGEEB202", 74, "k % 59 = 19", 1, 3),
        ("GGEEB206", 90, "k % 61 = 20", 1, 3),
        ("GGEEB209", 92, "k % 67 = 22", 1, 3),
        ("GGEEB210", 98, None, 1, 3),
        ("GGEEB211", 102, None, 1, 3),
        ("GGRLS203", 104, "k % 71 = 23", 0, 2),
        ("GGEES208", 110, None, 0, 4),
        ("GGADA202", 120, "k % 83 = 27", 0, 2),
        ("CALGB260", 128, "k % 89 = 29", 1, 2),
        ("Opleiding_samind", 132, "k % 97 = 32", 1, 4),
        ("LGBPS205", 134, None, 0, 2),
        ("AGGWS205", 138, None, 0, 2),
        ("MMWSA206", 140, None, 0, 2),
        ("MMWSA207", 144, None, 0, 2),
        ("MMWSA210", 158, None, 0, 2),
        ("AGHHS201", 162, None, 0, 2),
        ("KLGGB201", 168, None, 1, 5),
    ]:
        value = _spread(a, low, n)
        columns[name] = value if unknown is None else f"CASE WHEN {unknown} THEN 9 ELSE {value} END"
    columns["GGEES209"] = f"CASE WHEN k % 73 = 0 THEN 9 WHEN k % 79 = 0 THEN 8 ELSE {_spread(114, 0, 2)} END"
    columns["AGOJB201"] = "CASE WHEN k % 3 = 0 THEN 2012 ELSE 2016 END"
    return columns


def survey_sql(orders: str = "orders", customer: str = "customer") -> str:
    """The survey as a SELECT over the two tables."""
    listed = ",\n ".join(f"CAST({expression} AS INT) AS {name}" for name, expression in _columns().items())
    return (
        "SELECT k AS volgnummer, muni AS Gemeentecode,\n"
        " CAST(0.5 AS DOUBLE) + (k % 16) * CAST(0.125 AS DOUBLE) AS ewGGD,\n"
        f" {listed}\n"
        f"FROM (SELECT k, muni, g, {_noise_columns()}\n"
        f"      FROM (SELECT o_orderkey AS k, c_nationkey AS muni, CAST(o_orderkey % 9 AS INT) AS g,\n"
        f"                   o_orderkey % {_PRIME} AS kp, (o_orderkey % {_PRIME}) * (o_orderkey % {_PRIME}) % {_PRIME} AS kk\n"
        f"            FROM {orders} JOIN {customer} ON o_custkey = c_custkey) a) b"
    )


_STORED: dict[tuple[str, str], str] = {}


def demo_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey over the parquet tables of a folder, as a stored table.

    A survey arrives as a file. The derived one is therefore written once per application
    to the shared folder; queries then scan only the columns they use.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _STORED:
        path = f"{shared_dir(spark)}/survey-{uuid.uuid4().hex}"
        derived = spark.sql(
            survey_sql("{orders}", "{customer}"),
            orders=spark.read.parquet(f"{sf_dir}/orders.parquet"),
            customer=spark.read.parquet(f"{sf_dir}/customer.parquet"),
        )
        derived.write.parquet(path)
        _STORED[known] = path
    return spark.read.parquet(_STORED[known])
