"""Mixing sources to target weights by balanced sampling (the cube method).

Targets: the words of all documents are shared among the sources by weight; a source takes at
most ``MOST`` times its own words, and what it cannot take goes to the others by weight until
none is above. A source with target / size = q + p then takes every document q times and draws
one more copy of each with probability p.

The draw is a cube flight. Every row starts at its probability; three rows at a time are moved
along a direction in the null space of the constraints (number of documents, number of words),
until one of them is 0 or 1 and the next row takes its place. So both totals stay exact while
rows are decided. A task works through its rows as a stream and holds at most three undecided
rows per source; the two left are dealt out by source. Where a source could still have more than
``LANDING_ROWS`` of them it is first cut into parts, twenty times fewer each round. Once all of a
source meet in one task, sorted by source, the two that remain of it land on the corner that misses
the word total least. The number of rounds follows from the number of tasks alone.

Sources are rows as well: they are ranked by name over sorted partitions, the level of the targets
is found by a few sums, and the targets are joined to the rows. Their number is not bounded.

Randomness is replaced by the order of a hash of key and size, so reruns agree; the number of
tasks in the flight follows from the number of rows alone.

Defined results: a null text has size 0; null is a source of its own, ordered last; a source
without words has target 0. Rows of size 0 take 0 words. Repeated rows are separate rows. An
empty table gives no rows. Extra columns stay, except those named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import WORD
from tallyweave.session import cut_lineage

MOST = 3
CYCLE = (5, 2, 1)
ROWS_PER_TASK = 200_000
LANDING_ROWS = 20_000
FEWER = 20  # parts of a source that meet in one of the next round
EPS = 1e-9


def shares(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets that add up to the sum of the sizes, none above ``most`` times its size."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def source_targets(sized: DataFrame, cycle: tuple[float, ...] = CYCLE, most: float = MOST) -> DataFrame:
    """(name, source_size, target, grp) with the weights of ``cycle`` in the order of the names,
    null last; ``grp`` is the place in that order.

    Only sums and one number per partition of the sorted names reach the driver.
    """
    found = sized.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size"))
    placed = cut_lineage(found.orderBy(F.col("name").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    before, at = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        before += [F.lit(r["part"]), F.lit(at)]
        at += r["count"]
    if not before:
        return placed.select("name", "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("grp"))
    grp = (F.element_at(F.create_map(*before), part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.col("grp"), F.lit(len(cycle))) + 1).cast("int"))
    weighed = placed.withColumn("grp", grp).withColumn("_w", weight)
    # the targets are least(rate * weight, most * size); the rate rises until they add up, as in shares()
    rate, full_before = 0.0, -1
    while True:
        full = F.lit(rate) * F.col("_w") > F.lit(float(most)) * F.col("source_size")
        sums = weighed.where("source_size > 0").agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)).alias("w"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not sums["w"] or sums["n"] == full_before:  # nothing is open, or nothing more became full
            break
        rate, full_before = (sums["all"] - most * sums["full"]) / sums["w"], sums["n"]
    target = F.when(F.col("source_size") > 0, F.least(F.lit(rate) * F.col("_w"), F.lit(float(most)) * F.col("source_size"))).otherwise(F.lit(0.0))
    return cut_lineage(weighed.select("name", "source_size", target.alias("target"), "grp"), replaces=placed)


def _move(units: list[list[float]]) -> None:
    """Move three [probability, size, ...] along the null space until one is 0 or 1."""
    (pa, xa, *_), (pb, xb, *_), (pc, xc, *_) = units
    # orthogonal to (1, 1, 1) and to the sizes
    u = (xb - xc, xc - xa, xa - xb)
    if not any(u):
        u = (1.0, -1.0, 0.0)
    ps = (pa, pb, pc)
    forth = min((1 - p) / v if v > 0 else p / -v for p, v in zip(ps, u) if v)
    back = min(p / v if v > 0 else (1 - p) / -v for p, v in zip(ps, u) if v)
    # the side is drawn from the rows themselves, with the odds that keep the expectation
    step = forth if units[0][2] * (forth + back) < back else -back
    for unit, p, v in zip(units, ps, u):
        unit[0] = min(1.0, max(0.0, p + step * v))


def _settled(p: float) -> bool:
    return p < EPS or p > 1 - EPS


def _flight(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, group, size, dice, p) with p moved; a p between 0 and 1 is undecided."""
    pending: dict[int, list[list]] = {}
    for batch in batches:
        done: list[tuple] = []
        for id_, group, size, dice, p in zip(batch["id"], batch["grp"], batch["size"], batch["dice"], batch["p"]):
            if _settled(p):
                done.append((id_, group, size, dice, round(p)))
                continue
            units = pending.setdefault(group, [])
            units.append([p, float(size), dice, id_, size])
            if len(units) == 3:
                _move(units)
                for u in units:
                    if _settled(u[0]):
                        done.append((u[3], group, u[4], u[2], float(round(u[0]))))
                pending[group] = [u for u in units if not _settled(u[0])]
        yield pd.DataFrame(done, columns=["id", "grp", "size", "dice", "p"])
    left = [(u[3], g, u[4], u[2], u[0]) for g, units in pending.items() for u in units]
    yield pd.DataFrame(left, columns=["id", "grp", "size", "dice", "p"])


def _flight_by_part(land: bool):
    """The flight over rows sorted by (grp, part): what is left of a part is handed on, or lands."""

    def fly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, units = None, []

        def left() -> list[tuple]:
            settled = _land([{"id": u[3], "size": u[4], "p": u[0]} for u in units]) if land else {}
            return [(u[3], now[0], u[4], u[2], settled.get(u[3], u[0])) for u in units]

        for batch in batches:
            done: list[tuple] = []
            for id_, group, size, dice, p, part in zip(batch["id"], batch["grp"], batch["size"], batch["dice"], batch["p"], batch["part"]):
                if (group, part) != now:
                    done += left()
                    now, units = (group, part), []
                units.append([p, float(size), dice, id_, size])
                if len(units) == 3:
                    _move(units)
                    done += [(u[3], group, u[4], u[2], float(round(u[0]))) for u in units if _settled(u[0])]
                    units = [u for u in units if not _settled(u[0])]
            yield pd.DataFrame(done, columns=["id", "grp", "size", "dice", "p"])
        yield pd.DataFrame(left(), columns=["id", "grp", "size", "dice", "p"])

    return fly


def _land(rows: list) -> dict[int, float]:
    """The corner for the last rows of one source that misses the word total least."""
    wanted = sum(r["p"] * r["size"] for r in rows)
    number = sum(r["p"] for r in rows)
    best = None
    for corner in range(1 << len(rows)):
        taken = [corner >> i & 1 for i in range(len(rows))]
        miss = (abs(sum(t * r["size"] for t, r in zip(taken, rows)) - wanted), abs(sum(taken) - number), corner)
        if best is None or miss < best[0]:
            best = (miss, taken)
    return {r["id"]: float(t) for r, t in zip(rows, best[1])}


_UNITS = "id long, grp long, size long, dice double, p double"


def balanced_draw(units: DataFrame) -> DataFrame:
    """(id, taken 0 or 1) of rows (id, grp, size, dice, p), balanced within every ``grp``."""
    tasks = max(1, -(-units.count() // ROWS_PER_TASK))
    order = [F.xxhash64("dice"), "size", "id"]  # the order must tell nothing of the dice
    flown = cut_lineage(units.repartition(tasks, "dice").sortWithinPartitions(*order).mapInPandas(_flight, _UNITS))
    open_ = f"p >= {EPS} AND p <= {1 - EPS}"
    decided, parts = [flown.where(f"NOT ({open_})")], tasks
    while True:
        # at most two rows of a source are left in every task or part
        parts = -(-parts // FEWER) if 2 * parts > LANDING_ROWS else 1
        part = F.pmod(F.xxhash64("dice", "id"), F.lit(parts)).cast("int")
        level = flown.where(open_).withColumn("part", part).repartition("grp", "part").sortWithinPartitions("grp", "part", *order)
        flown = cut_lineage(level.mapInPandas(_flight_by_part(parts == 1), _UNITS))
        if parts == 1:
            break
        decided.append(flown.where(f"NOT ({open_})"))
    drawn = flown
    for d in decided:
        drawn = drawn.unionByName(d)
    return drawn.select("id", F.round("p").cast("int").alias("taken"))


OUTPUTS = ["size", "source_size", "target", "copies", "taken"]


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: list[str] | None = None,
    cycle: tuple[float, ...] = CYCLE,
) -> DataFrame:
    """The columns ``keep`` (default: the key) of every row with size, target and copies taken."""
    keep = [key] if keep is None else keep
    stored = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("id"),
            F.col(f"`{source}`").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD + "+")), F.lit(0)).cast("long").alias("size"),
            F.col(f"`{key}`").cast("string").alias("key"),
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        )
    )
    rows = stored.select("id", "source", "size", "key")
    plan = source_targets(rows, cycle)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(ratio + EPS)
    planned = plan.withColumns({"base": base.cast("int"), "p": F.greatest(F.lit(0.0), ratio - base)})
    joined = rows.join(planned, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # 53 bits of a hash of the row as a number from 0 to 1
    dice = F.shiftrightunsigned(F.xxhash64("key", "size"), 11) / F.lit(float(1 << 53))
    drawn = balanced_draw(joined.select("id", "grp", "size", dice.alias("dice"), "p"))
    settled = joined.select("id", "source_size", "target", "base").join(drawn, "id")
    copies = (F.col("base") + F.col("taken")).cast("int")
    facts = settled.select("id", "source_size", "target", copies.alias("copies"))
    kept = [c for c in keep if c not in OUTPUTS]
    return stored.join(facts, "id").select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    columns = docs.columns
    packed = docs.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{source}`").alias("s"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")
    )
    taken = mix(packed, "k", "t", "s", ["doc"])
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).select("doc.*")
