import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyweave.functions import recode as R


def _apply(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    "spec,values,expected",
    [
        ("3=1; 1=0; 2=0; 9=NA", [1, 2, 3, 9, 7, None], [0, 0, 1, None, 7, None]),
        ("1=1; 2:4=2; 99=NA", [1, 2, 3, 4, 5, 99, None], [1, 2, 2, 2, 5, None, None]),
        ("11=1; 12=1; 99=NA; else=0", [11, 12, 13, 99, None], [1, 1, 0, None, 0]),
        ("1=0; 0=1;", [0, 1, 5, None], [1, 0, 5, None]),
        ("1=5; 1=6", [1], [5]),
        ("c(1,2)=7; NA=3", [1, 2, 3, None], [7, 7, 3, 3]),
    ],
)
def test_recode(spark, spec, values, expected):
    assert _apply(spark, values, R.recode("v", spec)) == expected


def test_strict_recode_fails_on_an_unlisted_code(spark):
    assert _apply(spark, [1, None], R.recode("v", "1=0", strict=True)) == [0, None]
    with pytest.raises(PySparkException):
        _apply(spark, [1, 4], R.recode("v", "1=0", strict=True))


def test_later_rule_wins_and_null_condition_leaves_the_value(spark):
    rules = [("v > 2", 1), ("v = 9", None)]
    assert _apply(spark, [1, 3, 9, None], R.assign_rules(rules, default=0)) == [0, 1, None, 0]
    assert _apply(spark, [1, 3], R.assign_rules([("v = 3", 1)])) == [None, 1]


def test_row_helpers(spark):
    df = spark.createDataFrame([(1, 1, None, 0), (2, None, None, 2)], "k int, a int, b int, cl int")
    row = df.select(
        R.row_sum(["a", "b"]).alias("s"), R.noise_flag("cl").alias("n"), R.member_flag("cl").alias("m"), *R.dummies("cl", 2, "c")
    ).collect()
    assert [tuple(r) for r in row] == [(1, 1, 0, 0, 0), (0, 0, 1, 0, 1)]


def test_rename_unless_and_sentinel(spark):
    df = spark.createDataFrame([(9, 9, 9)], "k int, a int, b_dich int")
    assert R.rename_unless(df, "_dich", "_dich", keep=["k"]).columns == ["k", "a_dich", "b_dich"]
    assert tuple(R.sentinel_to_null(df, ["a"]).first()) == (9, None, 9)


def test_uniform_does_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("u", R.uniform("id", 1, 2))
    again = spark.range(500).repartition(7).withColumn("u", R.uniform("id", 1, 2))
    assert sorted(df.collect()) == sorted(again.collect())
    assert abs(df.agg(F.avg("u")).first()[0] - 0.5) < 0.05
