"""Column expressions that turn survey codes into features. All stay inside codegen."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"-?\d+(?:\.\d+)?"


def _value(text: str) -> str:
    text = text.strip()
    if text == "NA":
        return "NULL"
    if not re.fullmatch(_NUMBER, text):
        raise ValueError(f"not a code: {text!r}")
    return text


def _condition(column: str, text: str) -> str:
    text = text.strip()
    span = re.fullmatch(rf"({_NUMBER})\s*:\s*({_NUMBER})", text)
    if span:
        return f"{column} BETWEEN {span[1]} AND {span[2]}"
    values = re.fullmatch(r"c\((.*)\)", text)
    if values:
        return f"{column} IN ({', '.join(_value(v) for v in values[1].split(','))})"
    if text == "NA":
        return f"{column} IS NULL"
    return f"{column} = {_value(text)}"


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def recode(column: str, spec: str, strict: bool = False) -> Column:
    """Map codes by a list such as ``"1=1; 2:4=2; c(7,8)=0; 9=NA; else=0"``.

    The first matching entry wins. Without ``else`` unlisted values (and null) pass
    through unchanged; with ``else`` everything unlisted, null included, takes its
    value. ``strict=True`` fails on an unlisted non-null code instead.
    """
    name = quoted(column)
    branches: list[tuple[list[str], str]] = []
    fallback = name
    if strict:
        fallback = f"if({name} IS NULL, NULL, raise_error(concat('unlisted code in {column}: ', {name})))"
    for entry in filter(None, (e.strip() for e in spec.split(";"))):
        left, right = entry.split("=")
        value = _value(right)
        if left.strip() == "else":
            fallback = value
        elif branches and branches[-1][1] == value:
            branches[-1][0].append(_condition(name, left))
        else:
            branches.append(([_condition(name, left)], value))
    if not branches:
        return F.expr(f"CAST({fallback} AS INT)")
    whens = " ".join(f"WHEN {' OR '.join(conditions)} THEN {value}" for conditions, value in branches)
    return F.expr(f"CAST(CASE {whens} ELSE {fallback} END AS INT)")


def assign_rules(rules: Sequence[tuple[str, int | None]], default: int | None = None) -> Column:
    """Ordered conditional assignment of (SQL condition, value): every rule overwrites the
    ones before it, a null condition leaves the value alone. Hence a CASE in reverse order."""

    def text(value: int | None) -> str:
        return "NULL" if value is None else str(value)

    whens = " ".join(f"WHEN {condition} THEN {text(value)}" for condition, value in reversed(rules))
    return F.expr(f"CAST(CASE {whens} ELSE {text(default)} END AS INT)")


def flip(column: str) -> Column:
    """Turn 0 into 1 and 1 into 0; anything else passes."""
    return recode(column, "1=0; 0=1;")


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns of one row, nulls counted as zero."""
    return F.expr(" + ".join(f"coalesce({quoted(c)}, 0)" for c in columns))


def any_of(conditions: Sequence[Column]) -> Column:
    """OR of the conditions; as a filter a null result drops the row."""
    return reduce(lambda a, b: a | b, conditions)


def threshold_text(column: Column | str, threshold: float) -> Column:
    return F.when(_col(column) > threshold, F.lit("Yes")).otherwise(F.lit("No"))


def threshold_flag(column: Column | str, threshold: float) -> Column:
    return F.when(_col(column) > threshold, F.lit(1)).otherwise(F.lit(0))


def noise_flag(cluster: Column | str) -> Column:
    """1 where a row has no cluster (label 0 or null)."""
    return (F.coalesce(_col(cluster), F.lit(0)) == 0).cast("int")


def member_flag(cluster: Column | str) -> Column:
    """1 where a row belongs to some cluster, 0 otherwise (null included)."""
    return F.coalesce((_col(cluster) > 0).cast("int"), F.lit(0))


def dummies(cluster: str, k: int, prefix: str) -> list[Column]:
    """One 0/1/null column per cluster 1..k."""
    return [(F.col(cluster) == i).cast("int").alias(f"{prefix}{i}") for i in range(1, k + 1)]


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0))


def round_half_even(column: Column | str, digits: int) -> Column:
    return F.bround(_col(column), digits)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


# ---- whole-table column edits -------------------------------------------------------


def prefixed_key(column: str, prefix: str = "x") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def stripped_key(column: str, prefix: str = "x") -> Column:
    return F.regexp_replace(F.col(column), prefix, "")


def rename_unless(df: DataFrame, marker: str, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Append ``suffix`` to every column whose name does not contain ``marker``."""
    return df.toDF(*[c if marker in c or c in keep else c + suffix for c in df.columns])


def to_numeric(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Text to numbers; what is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in columns})


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: int = 9) -> DataFrame:
    """Blank the unknown code in the listed columns only, never in a label column."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def null_to_value(df: DataFrame, columns: Sequence[str], value: int = 0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def hash_order(key: Column | str, seed: int) -> Column:
    """A reproducible pseudo-random integer of the key alone: the same for every
    partitioning of the data."""
    return F.xxhash64(_col(key), F.lit(seed))


def uniform(key: Column | str, *salt: object) -> Column:
    """A uniform number in (0, 1) from the key and salt, independent of partitioning."""
    bits = F.xxhash64(_col(key), *[s if isinstance(s, Column) else F.lit(s) for s in salt])
    return (F.shiftrightunsigned(bits, 11).cast("double") + 0.5) / F.lit(float(2**53))
