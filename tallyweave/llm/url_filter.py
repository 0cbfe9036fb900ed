"""URL verdicts: longest host and path rule, else a list behind a blocked Bloom filter.

The list may be large. A split-block Bloom filter (one 256-bit block per key, eight bits set
in it) is built as a table of blocks; every url looks up its one block, and only urls whose
eight bits are all set go on to the hash join with the listed urls, which removes false
positives. The filter is broadcast while its computed size stays under ``broadcast_bytes``
and joined by a shuffle on the block number beyond that; the verdicts are the same.

Defined results: a null url, or one without ``://``, has empty host and path and is never
listed. Repeated rows each get their verdict. An empty list blocks nothing, an empty table
gives no rows. Columns of the input other than the url are kept; those named like an output
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import ascii_lower

BITS_PER_KEY = 24
BLOCK_BITS = 256
WORDS = 4
BROADCAST_BYTES = 32 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a url, each empty where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    asked = F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)
    return host, path, asked


def canonical(url: Column) -> Column:
    """The form under which urls are listed: no scheme, port 80 or 443, leading ``www.``,
    trailing slash, fragment or tracking parameter; the other parameters in order. Null where
    there is no host."""
    host, path, asked = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)\z", ""), r"\Awww\.", "")
    path = F.regexp_replace(path, r"/+\z", "")
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: ~p.rlike(r"\A(utm_[^=]*|ref)(=|\z)") & (p != "")))
    joined = F.array_join(kept, "&")
    return F.when(host != "", F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose
    path the url's starts with; null where none fits. Of equally long rules the longer host wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _masks(key: Column) -> list[Column]:
    """Eight bits of a block as four longs, two in each, from one more hash of the key."""
    second = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    shifted = [F.shiftrightunsigned(second, 5 * i).bitwiseAND(F.lit(31).cast("long")).cast("int") for i in range(2 * WORDS)]
    return [
        F.call_function("shiftleft", one, shifted[2 * i]).bitwiseOR(F.call_function("shiftleft", one, shifted[2 * i + 1] + 32))
        for i in range(WORDS)
    ]


def block_count(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _w0 .. _w3): the filter as a table of its non-empty blocks."""
    masks = [m.alias(f"_w{i}") for i, m in enumerate(_masks(F.col(key)))]
    return (
        keys.select(_block(F.col(key), blocks).alias("_block"), *masks)
        .groupBy("_block")
        .agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])
    )


def with_bloom_hit(rows: DataFrame, key: str, blooms: DataFrame, blocks: int, broadcast_bytes: int, name: str) -> DataFrame:
    """Add boolean ``name``: false only for keys that are surely not in the filter."""
    small = blocks * 8 * (WORDS + 2) <= broadcast_bytes
    probe = rows.withColumn("_probe", F.coalesce(_block(F.col(key), blocks), F.lit(-1).cast("long")))
    joined = probe.join(F.broadcast(blooms) if small else blooms, F.col("_probe") == F.col("_block"), "left")
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) == m)
    hit = F.col("_block").isNotNull() & F.col(key).isNotNull() & hit
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_probe", "_block", *[f"_w{i}" for i in range(WORDS)])


def judge_urls(
    rows: DataFrame,
    url: str,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``rows`` with host, path, rule, listed and verdict.

    ``listed`` has one string column of listed urls in any spelling. A url that no rule fits
    is blocked if its canonical form is that of a listed url, else allowed.
    """
    names = ["host", "path", "rule", "listed", "verdict"]
    keys = (
        listed.select(canonical(F.col(f"`{listed.columns[0]}`")).alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    )
    blocks = block_count(keys.count())
    host, path, _ = host_and_path(F.col(f"`{url}`"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    kept = [c for c in rows.columns if c not in names]
    # the columns travel in a struct, so that theirs and the working names cannot clash
    parsed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_doc"),
        canonical(F.col(f"`{url}`")).alias("_key"),
        host.alias("host"),
        path.alias("path"),
    ).withColumns({"rule": rule, "_rule_verdict": verdict})
    probed = with_bloom_hit(parsed, "_key", bloom_blocks(keys, "_listed", blocks), blocks, broadcast_bytes, "_hit")
    possible = probed.where("_hit").join(keys, F.col("_key") == F.col("_listed"), "left").withColumn(
        "listed", F.col("_listed").isNotNull()
    )
    others = probed.where("NOT _hit").withColumn("listed", F.lit(False))
    both = possible.drop("_listed").unionByName(others)
    return both.withColumn(
        "verdict", F.coalesce("_rule_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    ).select(*[F.col("_doc").getField(c).alias(c) for c in kept], *names)
