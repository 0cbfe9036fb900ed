"""Merkle manifest of a table: a root over all rows, and for every row the digests that prove it.

Rows are leaves of one tree per group (a language, say), in ascending key order; the roots of the
trees, in the order of the groups, are the leaves of a last tree. Nothing is sorted. Every group has
a bitmap of its keys, kept as the 64-bit words that are not zero, and a directory of popcounts above
them: of the words in a chunk of 2^16 keys, of the chunks in 2^32 keys, and so on. A key's rank, the
coordinate of its leaf, is the sum of the counts before it at every step and of the bits below it in
its word. The coordinate's upper bits name a block, its lower ten a slot; a block is one row that
holds the array of its slots, and is reduced ten levels at a time. Block roots are the slots of the
next blocks.

Groups of every step are bounded: 64 rows to a word, 1,024 words to a chunk, 65,536 children in the
directory, 1,024 slots to a block. A hot group only has more of them.

Defined results: null fields are written ``-``. A null group is a group of its own, the first. Null
keys come first in their group. Rows that share a key within a group lie next to one another by the
first 52 bits of their leaf, then by their place in the input, which only equal leaves share; they
are ranked in buckets, so one key may hold any number of rows. Empty texts and very long ones are
hashed as a whole. An empty table gives no rows. Only the named columns are read, so others cannot
clash. The groups themselves, one row each, are numbered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.ranks import ranked
from tallyweave.session import cut_lineage, drop_step

SLOT_BITS = 10  # levels reduced inside a block
STEPS = (6, 16, 32, 48)  # key bits below a word, a chunk and the directories above


# ---------------------------------------------------------------- digests
def field_text(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_levels(leaves: Sequence[str], height: int) -> list[list[str]]:
    """The nodes of ``height`` levels above ``leaves``; a node without a neighbour is hashed alone."""
    levels = [list(leaves)]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def sibling_steps(levels: list[list[str]], slot: int) -> list[str]:
    """What a slot meets on its way up: ``l`` or ``r`` and the neighbour's digest, or ``n`` for none."""
    steps = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        steps.append("n" if other >= len(nodes) else ("l" if other < slot else "r") + nodes[other])
        slot >>= 1
    return steps


@F.pandas_udf(T.StringType())
def _block_root(slots: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([tree_levels(s, h)[-1][0] for s, h in zip(slots, height)], dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _block_steps(slots: pd.Series, height: pd.Series) -> pd.Series:
    found = []
    for s, h in zip(slots, height):
        levels = tree_levels(s, h)
        found.append([sibling_steps(levels, i) for i in range(len(s))])
    return pd.Series(found, dtype=object)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of a proof lead to."""

    def up(node: Column, step: Column) -> Column:
        other = F.substring(step, 2, 64)
        return F.sha2(F.when(step.startswith("l"), F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the neighbours of a proof, from the leaf upwards."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.substring(step, 2, 64))), 256)


# ---------------------------------------------------------------- ranks by bitmap
def key_bitmap(leaves: DataFrame) -> DataFrame:
    """(tree, word, bits, n): the words of the key bitmaps that are not zero, and their rows."""
    one = F.expr("shiftleft(1L, cast(key & 63 as int))")
    return (
        leaves.where("key IS NOT NULL")
        .groupBy("tree", F.shiftright("key", STEPS[0]).alias("word"))
        .agg(F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("n"))
    )


def rank_directory(words: DataFrame, nulls: DataFrame) -> DataFrame:
    """``words`` with ``before``, the rows of smaller keys in the tree, from popcounts step by step.

    ``nulls`` (tree, n_null) are the rows without key, which come before all others."""
    levels = [words.select("tree", F.col("word").alias("at"), "n")]
    for low, high in zip(STEPS, STEPS[1:]):
        levels.append(levels[-1].groupBy("tree", F.shiftright("at", high - low).alias("at")).agg(F.sum("n").alias("n")))
    above = nulls.select("tree", F.col("n_null").alias("base"))
    on_top: list[str] = []
    for step in range(len(STEPS) - 1, -1, -1):
        rows = levels[step]
        if step < len(STEPS) - 1:
            rows = rows.withColumn("parent", F.shiftright("at", STEPS[step + 1] - STEPS[step]))
            on_top = ["parent"]
        earlier = Window.partitionBy("tree", *on_top).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inside = rows.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        joined = inside.join(above, ["tree", *on_top], "left")
        placed = joined.select("tree", "at", (F.col("inside") + F.coalesce("base", F.lit(0))).alias("base"))
        above = placed.withColumnRenamed("at", "parent")
    return words.join(placed.withColumnsRenamed({"at": "word", "base": "before"}), ["tree", "word"])


def leaf_places(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, key, row, leaf, ...) with ``place``, the coordinate in the tree."""
    nulls = leaves.where("key IS NULL").groupBy("tree").agg(F.count(F.lit(1)).alias("n_null"))
    words = cut_lineage(rank_directory(key_bitmap(leaves), nulls))
    columns = leaves.columns
    keyed = leaves.withColumn("word", F.shiftright("key", STEPS[0])).join(words, ["tree", "word"], "left")
    lower = F.expr("bits & ~shiftleft(-1L, cast(key & 63 as int))")
    shared = F.col("key").isNull() | (F.col("n") > F.bit_count("bits"))
    alone = keyed.where(~shared).select(*columns, (F.col("before") + F.bit_count(lower)).alias("place"))
    # words in which keys repeat, and rows without a key
    copies = keyed.where(shared)
    if copies.isEmpty():
        return alone
    counted = copies.where("key IS NOT NULL").groupBy("tree", "word", "key").agg(F.count(F.lit(1)).alias("copies"))
    inside = Window.partitionBy("tree", "word").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("tree", "key", F.coalesce(F.sum("copies").over(inside), F.lit(0)).alias("first"))
    number = F.conv(F.substring("leaf", 1, 13), 16, 10).cast("long")
    ranks = ranked(copies.select(*columns, "before", number.alias("number")), "number", ["row"], by=["tree", "key"])
    placed = ranks.join(firsts, ["tree", "key"], "left")
    place = F.coalesce("before", F.lit(0)) + F.coalesce("first", F.lit(0)) + F.col("rank")
    return alone.unionByName(placed.select(*columns, place.cast("long").alias("place")))


# ---------------------------------------------------------------- reduction
def _height(total: Column) -> Column:
    """Levels above ``total`` leaves: the bits of the last coordinate."""
    return F.when(total <= 1, 0).otherwise(F.length(F.bin(total - 1))).cast("int")


def _blocks(nodes: DataFrame, level: int, carried: Sequence[str] = ()) -> DataFrame:
    """(tree, block, height, leaves): the slots of every block in order."""
    slot = F.struct(F.col("place").bitwiseAND((1 << SLOT_BITS) - 1).alias("slot"), "digest", *carried)
    grouped = nodes.groupBy("tree", "height", F.shiftright("place", SLOT_BITS).alias("block")).agg(F.array_sort(F.collect_list(slot)).alias("leaves"))
    rounds = F.greatest(F.lit(0), F.least(F.lit(SLOT_BITS), F.col("height") - level * SLOT_BITS))
    return grouped.withColumn("rounds", rounds)


def _reduced(nodes: DataFrame, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every level and the roots (tree, root) of ``nodes`` (tree, height, place, digest)."""
    levels = [cut_lineage(_blocks(nodes, 0, carried))]
    while True:
        roots = levels[-1].select("tree", "height", F.col("block").alias("place"), _block_root("leaves.digest", "rounds").alias("digest"))
        step = cut_lineage(roots)
        if step.where("place > 0").isEmpty():
            return levels, step.select("tree", F.col("digest").alias("root"))
        levels.append(cut_lineage(_blocks(step, len(levels)), replaces=step))


def _proofs(levels: list[DataFrame]) -> DataFrame:
    """(tree, slot struct, proof) of the leaves, from the uppermost blocks down."""
    upper = None
    for blocks in reversed(levels):
        opened = blocks.select("tree", "block", "leaves", _block_steps("leaves.digest", "rounds").alias("steps"))
        if upper is not None:
            opened = opened.join(upper, ["tree", "block"])
        tail = F.col("above") if upper is not None else F.array().cast("array<string>")
        each = opened.select("tree", "block", tail.alias("above"), F.explode(F.arrays_zip("leaves", "steps")).alias("s"))
        proved = each.select("tree", "block", F.col("s.leaves").alias("leaf"), F.concat("s.steps", "above").alias("above"))
        upper = proved.select("tree", (F.shiftleft("block", SLOT_BITS) + F.col("leaf.slot")).alias("block"), "above")
    return proved.select("tree", "leaf", F.col("above").alias("proof"))


def prove(docs: DataFrame, key: str, group: str, fields: Sequence[str], carried: dict[str, Column] | None = None) -> DataFrame:
    """(key, the carried columns, leaf, subroot, root, proof) of every row of ``docs``.

    ``carried`` are more columns of the result by name; they do not enter the leaf."""
    carried = carried or {}
    column = lambda c: F.col(f"`{c}`")
    leaves = cut_lineage(
        docs.select(
            F.concat(F.lit("="), column(group).cast("string")).alias("tree"),
            column(key).cast("long").alias("key"),
            leaf_digest([column(f) for f in fields]).alias("leaf"),
            F.struct(*[c.alias(n) for n, c in carried.items()], F.lit(0).alias("_")).alias("more"),
        )
        .fillna("", ["tree"])
        .withColumn("row", F.monotonically_increasing_id())
    )
    totals = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    sized = leaf_places(leaves).join(F.broadcast(totals) if totals.count() < 10_000 else totals, "tree")
    nodes = sized.select("tree", _height(F.col("total")).alias("height"), "place", F.col("leaf").alias("digest"), F.struct("key", "more").alias("row"))
    levels, subroots = _reduced(nodes, ["row"])
    subroots = cut_lineage(subroots)
    trees = subroots.count()
    order = Window.partitionBy(F.lit("")).orderBy("group")  # one row per group
    tops = subroots.select(F.col("tree").alias("group"), F.col("root").alias("digest"))
    tops = tops.select("group", "digest", (F.row_number().over(order) - 1).cast("long").alias("place"))
    tops = tops.select(F.lit("").alias("tree"), F.lit(max(0, trees - 1).bit_length()).alias("height"), "place", "digest", "group")
    top_levels, roots = _reduced(tops, ["group"])
    first = roots.first()
    root = F.lit(first["root"] if first else None).cast("string")
    above = _proofs(top_levels).select(F.col("leaf.group").alias("tree"), F.col("leaf.digest").alias("subroot"), F.col("proof").alias("top"))
    below = _proofs(levels)
    proved = below.join(cut_lineage(above), "tree").select(
        F.col("leaf.row.key").cast(docs.schema[key].dataType).alias(key),
        *[F.col("leaf.row.more").getField(n).alias(n) for n in carried],
        F.col("leaf.digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.concat("proof", "top").alias("proof"),
    )
    drop_step(leaves)
    return proved


def verify_rows(proved: DataFrame, seen: Column) -> DataFrame:
    """``proved`` with proof_sha256, folded_root and verified, for leaves ``seen`` now."""
    folded = proved.withColumns({"proof_sha256": proof_digest(F.col("proof")), "folded_root": fold(seen, F.col("proof"))})
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(key: str, fields: Sequence[str], changed: str, divisor: int) -> Column:
    """The leaf of a row in which ``changed`` is one more, where ``divisor`` divides the key's crc32;
    null for all other rows and for a null key."""
    hit = F.pmod(F.crc32(F.encode(F.col(f"`{key}`").cast("string"), "UTF-8")), F.lit(divisor)) == 0
    columns = [F.try_add(F.col(f"`{f}`"), F.lit(1)) if f == changed else F.col(f"`{f}`") for f in fields]
    return F.when(hit, leaf_digest(columns))
