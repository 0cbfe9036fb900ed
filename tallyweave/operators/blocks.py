"""Pairwise work over blocks of points: exact, pruned, and without emitting pairs.

Points are cut into cells around pivots and each cell into blocks of bounded size by a
hash, so a hot cell is many blocks. A block travels as one row of packed arrays. Which
cells have to meet is decided from cell radii by the triangle inequality, or from boxes.
Blocks travel in tiles of some megabytes. A task holds a strip of query tiles, lets a range of data
tiles pass it one after the other, works through their blocks as dense arrays and returns only
what the kernel keeps of them together (the k nearest, or one sum per cluster). So a point is sent once
per strip, not once per pair of tiles. Identical points should be merged into one
weighted point first (:func:`distinct_points`): without that a third of the rows being
equal would mean a quadratic number of zero distances.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.recode import hash_order
from tallyweave.session import cut_lineage

BLOCK_ROWS = 1024
MAX_CELLS = 4096
TILE_BYTES = 1 << 23  # of a tile that travels
TILES = 16  # tiles at least, if that leaves BLOCK_ROWS rows in each
STRIPS, STRIP_BYTES = 16, 1 << 27  # strips of query tiles at least, and what a task holds of one
RANGES, RANGE_BYTES = 4, 1 << 29  # ranges of data tiles at least, and what passes a strip
TASK_PAIRS = 20_000_000  # pairs of points that are worth a task


def distinct_points(df: DataFrame, key: str, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One weighted point per distinct combination of values: ``id`` (the smallest key),
    the columns, ``w`` (number of rows). Rows with a null among the columns are left out."""
    return (
        df.na.drop("any", subset=list(columns))
        .groupBy(*columns, *extra)
        .agg(F.min(key).cast("long").alias("id"), F.count(F.lit(1)).cast("double").alias("w"))
    )


def as_points(df: DataFrame, columns: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """``id``, ``x``, ``w``, ``labels`` from a table with ``id``, ``w`` and the columns."""
    return df.select(
        "id",
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
        "w",
        F.array(*[F.col(c).cast("int") for c in labels]).cast("array<int>").alias("labels"),
    )


@dataclass(frozen=True)
class Tree:
    """Cuts of a space: rows whose value on ``axis`` is at most ``cut`` go left. A leaf has axis -1
    and its number in ``left``."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := self.axis[node] >= 0).any():
            at = node[inner]
            goes = x[rows[inner], self.axis[at]] <= self.cut[at]
            node[inner] = np.where(goes, self.left[at], self.right[at])
        return self.left[node]


@dataclass(frozen=True)
class Blocks:
    """Packed blocks and what is known of their cells."""

    rows: DataFrame  # cell, chunk, ids, xs, ws, labels (flat arrays)
    dim: int
    pivots: np.ndarray  # one per cell
    radius: np.ndarray
    count: np.ndarray
    chunks: np.ndarray
    w_min: np.ndarray
    w_max: np.ndarray
    places: DataFrame  # id, cell
    tree: Tree | None = None  # how boxes were cut; their ends and whether a value is missing, per cell and column
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    lacks: np.ndarray | None = None

    @property
    def n(self) -> int:
        return int(self.count.sum())


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product form, about the middle of ``b``: quick, and off by
    rounding (see :func:`_rounding`) where the distances are small against the spread."""
    middle = b.mean(axis=0) if len(b) else 0.0
    a, b = a - middle, b - middle
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _rounding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far, at most, each row of :func:`_squared` is from the truth."""
    middle = b.mean(axis=0)
    reach = ((a - middle) ** 2).sum(1) + ((b - middle) ** 2).sum(1).max()
    return 1e-14 * (a.shape[1] + 4) * reach


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by differences, exact to the last places."""
    total, gap = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for j in range(a.shape[1]):
        np.subtract.outer(a[:, j], b[:, j], out=gap)
        gap *= gap
        total += gap
    return total


def _squared_closely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances good to nine places: by the product form where they are not small
    against the spread, by differences where the product would cancel."""
    if a.shape[1] <= 4:
        return _apart(a, b)
    middle = b.mean(axis=0)
    d = _squared(a, b)
    reach = ((a - middle) ** 2).sum(1) + ((b - middle) ** 2).sum(1).max()
    r, c = np.nonzero(d < 1e-3 * reach[:, None])
    if len(r) > d.size // 8:
        return _apart(a, b)
    d[r, c] = ((a[r] - b[c]) ** 2).sum(1)
    return d


def build_blocks(
    points: DataFrame,
    seed: int = 17,
    block_rows: int = BLOCK_ROWS,
    max_cells: int = MAX_CELLS,
    pivots: np.ndarray | None = None,
) -> Blocks:
    """Cut points (id, x, w, labels) into blocks. Pivots are the points with the smallest
    hashes: a bounded number of vectors on the driver, the same for any partitioning."""
    head = points.select("x").first()
    dim = len(head[0]) if head else 1  # without points there is one empty cell
    if pivots is None:
        n = points.count()
        wanted = int(min(max_cells, max(1, n // block_rows)))
        chosen = points.orderBy(hash_order("id", seed), "id").limit(wanted).select("x").collect()
        pivots = np.unique(np.nan_to_num(np.array([r[0] for r in chosen], dtype=float)), axis=0) if chosen else np.zeros((1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.nan_to_num(_values(batch.column("x")).reshape(batch.num_rows, dim))
            cell, reach = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                d = _squared(part, pivots)
                cell[lo : lo + 4096] = d.argmin(1)
                reach[lo : lo + 4096] = np.sqrt(((part - pivots[cell[lo : lo + 4096]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(reach)], names=[*batch.schema.names, "cell", "reach"]
            )

    fields = "id long, x array<double>, w double, labels array<int>"
    placed = points.select("id", "x", "w", "labels").mapInArrow(assign, fields + ", cell int, reach double")
    placed = cut_lineage(placed)
    meta = (
        placed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r"), F.min("w").alias("lo"), F.max("w").alias("hi"))
        .collect()
    )
    c = len(pivots)
    count, radius, w_min, w_max = np.zeros(c), np.zeros(c), np.ones(c), np.ones(c)
    for row in meta:
        count[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
        w_min[row["cell"]], w_max[row["cell"]] = row["lo"], row["hi"]
    rows, chunks = _packed(placed, count, block_rows)
    return Blocks(rows, dim, pivots, radius, count, chunks, w_min, w_max, placed.select("id", "cell"))


def _packed(placed: DataFrame, count: np.ndarray, block_rows: int) -> tuple[DataFrame, np.ndarray]:
    """The blocks of points that have a cell, and the chunks of every cell."""
    chunks = np.maximum(np.ceil(count / block_rows), 1).astype(int)
    split = [(i, int(n)) for i, n in enumerate(chunks) if n > 1]
    parts = placed.sparkSession.createDataFrame(split, "cell int, chunks int")
    member = F.sort_array(F.collect_list(F.struct("id", "x", "w", "labels")))
    rows = (
        placed.join(F.broadcast(parts), "cell", "left")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int"))
        .groupBy("cell", "chunk")
        .agg(member.alias("m"))
        .select(
            "cell",
            "chunk",
            F.col("m.id").alias("ids"),
            F.flatten("m.x").alias("xs"),
            F.col("m.w").alias("ws"),
            F.flatten("m.labels").alias("labels"),
        )
    )
    return cut_lineage(rows), chunks


def _grow(sample: np.ndarray, spans: Sequence[float | None], leaf_rows: int) -> Tree:
    """Halve the sample until ``leaf_rows`` remain: missing values apart first, then codes, then
    the number with the widest range."""
    axis, cut, left, right, leaves = [], [], [], [], 0

    def spread(values: np.ndarray, span: float | None) -> float:
        lowest, highest = values.min(), values.max()
        if lowest == highest:
            return 0.0
        if lowest == -np.inf:
            return 3.0
        return 2.0 if span is None else (highest - lowest) / span if span > 0 else 0.0

    waiting = [(np.arange(len(sample)), -1, False)]
    while waiting:
        rows, parent, on_right = waiting.pop()
        node = len(axis)
        if parent >= 0:
            (right if on_right else left)[parent] = node
        widths = [spread(sample[rows, j], span) for j, span in enumerate(spans)] if len(rows) > leaf_rows else [0.0]
        j = int(np.argmax(widths))
        if widths[j] <= 0:
            axis.append(-1), cut.append(0.0), left.append(leaves), right.append(0)
            leaves += 1
            continue
        values = np.sort(sample[rows, j])
        at = values[(len(values) - 1) // 2] if widths[j] != 3.0 else -np.inf
        if at == values[-1]:
            at = values[values < at].max()
        axis.append(j), cut.append(at), left.append(-1), right.append(-1)
        goes = sample[rows, j] <= at
        waiting += [(rows[~goes], node, True), (rows[goes], node, False)]
    return Tree(np.array(axis), np.array(cut), np.array(left), np.array(right), leaves)


def build_boxes(
    points: DataFrame, spans: Sequence[float | None], tree: Tree | None = None, seed: int = 17, sampled: int = 16
) -> Blocks:
    """Cut points with missing values, numbers (a range is given) and codes (none) into boxes. The cuts
    are medians of a sample of ``sampled`` rows a box, of bounded size; every point is placed and
    every box measured over all its points."""
    dim = len(spans)
    if tree is None:
        wanted = int(min(MAX_CELLS, max(1, points.count() // BLOCK_ROWS)))
        chosen = points.orderBy(hash_order("id", seed), "id").limit(wanted * sampled).select("x").collect()
        sample = np.array([[-np.inf if v is None else v for v in r[0]] for r in chosen], dtype=float).reshape(-1, dim)
        tree = _grow(sample, spans, sampled) if len(sample) else Tree(*[np.array([v]) for v in (-1, 0.0, 0, 0)], 1)
    cuts = tree

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _values(batch.column("x")).reshape(batch.num_rows, dim)
                cell = cuts.leaf(np.where(np.isnan(x), -np.inf, x)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    fields = "id long, x array<double>, w double, labels array<int>"
    placed = cut_lineage(points.select("id", "x", "w", "labels").mapInArrow(assign, fields + ", cell int"))
    value = [F.get("x", F.lit(j)) for j in range(dim)]
    measured = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(v) for v in value]).alias("low"),
        F.array(*[F.max(v) for v in value]).alias("high"),
        F.array(*[F.max(v.isNull()) for v in value]).alias("lacks"),
    )
    c = tree.leaves
    count, low, high, lacks = np.zeros(c), np.zeros((c, dim)), np.zeros((c, dim)), np.ones((c, dim), dtype=bool)
    for row in measured.collect():
        at = row["cell"]
        count[at], lacks[at] = row["n"], row["lacks"]
        low[at] = [0.0 if v is None else v for v in row["low"]]
        high[at] = [0.0 if v is None else v for v in row["high"]]
    rows, chunks = _packed(placed, count, BLOCK_ROWS)
    none = np.zeros((c, 0))
    return Blocks(rows, dim, none, np.zeros(c), count, chunks, np.ones(c), np.ones(c), placed.select("id", "cell"), tree, low, high, lacks)


def box_bounds(queries: Blocks, data: Blocks, spans: Sequence[float | None]) -> Iterator[tuple[slice, np.ndarray]]:
    """Least Gower distance of points of the boxes: a column counts where no point of either lacks it."""
    for lo in range(0, len(queries.count), 256):
        at = slice(lo, lo + 256)
        total = np.zeros((len(queries.count[at]), len(data.count)))
        for j, span in enumerate(spans):
            gap = np.maximum(data.low[None, :, j] - queries.high[at, None, j], queries.low[at, None, j] - data.high[None, :, j])
            part = (gap > 0).astype(float) if span is None else np.maximum(gap, 0.0) / span if span > 0 else np.zeros_like(gap)
            total += np.where(queries.lacks[at, None, j] | data.lacks[None, :, j], 0.0, part)
        yield at, total / len(spans)


def _values(column: pa.Array) -> np.ndarray:
    """Flat values of a list column, nulls as nan."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float)


# ---- which cells meet ---------------------------------------------------------------


def every_cell(queries: Blocks, data: Blocks) -> np.ndarray:
    return np.ones((len(queries.count), len(data.count)), dtype=bool)


def _ward_factor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 * a[:, None] * b[None, :] / (a[:, None] + b[None, :]))


def cells_within_reach(queries: Blocks, data: Blocks, k: int, ward: bool = False) -> np.ndarray:
    """Cells that can hold one of the k nearest points of some query in a cell.

    Any point of cell j is at most D + Rq + Rj away from any query of cell i; the
    smallest such bound that covers k points caps the k-th distance, and cells whose
    lower bound D - Rq - Rj exceeds the cap cannot contribute.
    """
    live = np.zeros((len(queries.count), len(data.count)), dtype=bool)
    for at, lower, upper in cell_bounds(queries, data, ward):
        upper = np.where(data.count[None, :] > 0, upper, np.inf)
        order = np.argsort(upper, axis=1, kind="stable")
        covered = np.cumsum(data.count[order], axis=1)
        position = np.minimum((covered < k).sum(1), covered.shape[1] - 1)
        sorted_upper = np.take_along_axis(upper, order, axis=1)
        cap = np.where(covered[:, -1] >= k, sorted_upper[np.arange(len(order)), position], np.inf)
        live[at] = _reaches(lower, cap)
    return live


def cell_bounds(queries: Blocks, data: Blocks, ward: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Least and largest distance of points of the cells, for some query cells at a time."""
    for lo in range(0, len(queries.count), 256):
        at = slice(lo, lo + 256)
        centre = np.sqrt(_apart(queries.pivots[at], data.pivots))
        slack = queries.radius[at, None] + data.radius[None, :]
        upper, lower = centre + slack, np.maximum(centre - slack, 0.0)
        if ward:
            upper = upper * _ward_factor(queries.w_max[at], data.w_max)
            lower = lower * _ward_factor(queries.w_min[at], data.w_min)
        yield at, lower, upper


def _reaches(lower: np.ndarray, cap: np.ndarray) -> np.ndarray:
    return lower <= cap[:, None] * (1 + 1e-9) + 1e-12


def search(blocks: Blocks, data: Blocks, kernel: Kernel, k: int, bounds: Callable[[], Iterator[tuple]]) -> DataFrame:
    """k nearest (id, neighbour, distance, rank) of every point of ``blocks`` in ``data``, both cut alike.

    Every point is held against its own cell first. The largest k-th distance found in a cell
    caps what its points still need, so other cells meet only where ``bounds`` (query cells,
    least distances to all cells, ...) stay below the cap."""
    own = np.eye(len(blocks.count), len(data.count), dtype=bool)
    first = cut_lineage(_nearest_of(meet(blocks, data, own, kernel, FOUND, best_of(k)), k))
    worst = first.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("d"))
    caps = (
        blocks.places.join(worst, "id", "left").groupBy("cell").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("cap")).collect()
    )
    cap = np.full(len(blocks.count), -1.0)
    for row in caps:
        cap[row["cell"]] = row["cap"]
    live = np.zeros_like(own)
    for at, lower in bounds():
        live[at] = _reaches(lower, cap[at])
    live &= ~own
    more = meet(blocks, data, live, kernel, FOUND, best_of(k))
    return _nearest_of(first.drop("rank").unionByName(more), k)


def _nearest_of(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates per id; the rank limit is applied before the shuffle too."""
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "id long, neighbour long, distance double"
Kernel = Callable[..., dict[str, np.ndarray]]


Fold = Callable[[list[dict[str, np.ndarray]]], dict[str, np.ndarray]]


def _tiled(blocks: Blocks) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Blocks packed into tiles (tile, cells, sizes, ids, xs, ws, labels), the tile of the first
    and of the last chunk of every cell. Cells that follow each other share a tile."""
    wanted = max(BLOCK_ROWS, min(TILE_BYTES // (8 * blocks.dim + 24), -(-blocks.n // TILES)))
    cell = np.repeat(np.arange(len(blocks.count)), blocks.chunks)
    chunk = np.arange(len(cell)) - np.repeat(np.cumsum(blocks.chunks) - blocks.chunks, blocks.chunks)
    rows = (blocks.count / blocks.chunks)[cell]
    tile = ((np.cumsum(rows) - rows) // wanted).astype("int32")
    spark = blocks.rows.sparkSession
    places = spark.createDataFrame(pd.DataFrame({"cell": cell.astype("int32"), "chunk": chunk.astype("int32"), "tile": tile}))
    packed = blocks.rows.join(F.broadcast(places), ["cell", "chunk"]).groupBy("tile").agg(
        F.sort_array(F.collect_list(F.struct("cell", "chunk", "ids", "xs", "ws", "labels"))).alias("m")
    )
    wide = packed.select(
        "tile",
        F.col("m.cell").alias("cells"),
        F.transform("m", lambda b: F.size(b["ids"])).alias("sizes"),
        *[F.flatten(f"m.{c}").alias(c) for c in ("ids", "xs", "ws", "labels")],
    )
    ends = np.cumsum(blocks.chunks)
    return wide, tile[ends - blocks.chunks], tile[ends - 1]


def meet(queries: Blocks, data: Blocks, cells: np.ndarray, kernel: Kernel, schema: str, fold: Fold) -> DataFrame:
    """Run ``kernel(qids, qx, qw, ids, x, w, labels)`` on the blocks of the cells that meet, and
    return the rows that ``fold`` makes of what it finds for one query block in one range of tiles;
    ``fold`` takes its own results again."""
    spark = queries.rows.sparkSession
    live = cells & (queries.count[:, None] > 0) & (data.count[None, :] > 0)
    qtiles, qfirst, qlast = _tiled(queries)
    dtiles, dfirst, dlast = (qtiles, qfirst, qlast) if data is queries else _tiled(data)
    q, d = np.nonzero(live)
    met = np.zeros((int(qlast.max()) + 1, int(dlast.max()) + 1), dtype=bool)
    for i in range(int((qlast - qfirst).max()) + 1):
        for j in range(int((dlast - dfirst).max()) + 1):
            at = (qfirst[q] + i <= qlast[q]) & (dfirst[d] + j <= dlast[d])
            met[qfirst[q[at]] + i, dfirst[d[at]] + j] = True
    sent, visits = _visits(met, _bytes(queries), _bytes(data))
    work_pairs = float(queries.count[q] @ data.count[d]) if len(q) else 0.0
    tasks = int(max(1, min(visits, work_pairs // TASK_PAIRS)))

    def side(tiles: DataFrame, is_data: bool) -> DataFrame:
        tile, visit = sent[is_data]
        to = spark.createDataFrame(pd.DataFrame({"tile": tile.astype("int32"), "visit": visit.astype("int32")}), "tile int, visit int")
        labels = F.col("labels") if is_data else F.array().cast("array<int>").alias("labels")
        return tiles.join(F.broadcast(to), "tile").select("visit", F.lit(is_data).alias("data"), "tile", "cells", "sizes", "ids", "xs", "ws", labels)

    both = side(qtiles, False).unionByName(side(dtiles, True))
    rows = both.repartitionById(tasks, F.col("visit") % F.lit(tasks)).sortWithinPartitions("visit", "data", "tile")
    dim, packed, width = queries.dim, np.packbits(live, axis=1), live.shape[1]
    most = getattr(kernel, "keeps", 0)  # neighbours of a query that the kernel keeps, if it takes those found before

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit, strip, found = None, [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("visit")[i].as_py() != visit:
                    yield from (pa.RecordBatch.from_pydict(fold(parts)) for parts in found.values())
                    visit, strip, found = batch.column("visit")[i].as_py(), [], {}
                row = {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("cells", "sizes", "ids", "xs", "ws", "labels")}
                x = row["xs"].astype(float).reshape(-1, dim)
                if not batch.column("data")[i].as_py():
                    ends = np.cumsum(row["sizes"])
                    ids, ws = row["ids"].copy(), row["ws"].copy()  # the batch goes
                    strip += [(c, ids[lo:hi], x[lo:hi], ws[lo:hi]) for c, lo, hi in zip(row["cells"], ends - row["sizes"], ends)]
                    continue
                labels = row["labels"].astype(float).reshape(len(x), -1) if len(x) else np.zeros((0, 0))
                order = np.argsort(row["ids"], kind="stable")
                of = np.repeat(row["cells"], row["sizes"])[order]
                for block, (cell, qids, qx, qw) in enumerate(strip):
                    mine = order[np.unpackbits(packed[cell], count=width).astype(bool)[of]]
                    parts = found.get(block, [])
                    for at in range(0, len(mine), BLOCK_ROWS):
                        some = mine[at : at + BLOCK_ROWS]
                        best = {"best": parts[0]} if most and parts else {}
                        parts.append(kernel(qids, qx, qw, row["ids"][some], x[some], row["ws"][some], labels[some].ravel(), **best))
                        # the k-th distance bounds what follows: put in order as soon as as many came again
                        if most and sum(len(p["id"]) for p in parts[1:]) >= most * len(qids):
                            parts = [fold(parts)]
                    if parts:
                        found[block] = parts if most else [fold(parts)]
        yield from (pa.RecordBatch.from_pydict(fold(parts)) for parts in found.values())

    return rows.mapInArrow(work, schema)


def _bytes(blocks: Blocks) -> int:
    return blocks.n * (8 * blocks.dim + 24)


def _visits(met: np.ndarray, query_bytes: int, data_bytes: int) -> tuple[dict[bool, tuple[np.ndarray, np.ndarray]], int]:
    """(tile, visit) of the query tiles (False) and of the data tiles (True), and the number of visits.

    A visit is a strip of query tiles, which a task holds, and a range of data tiles, which pass it one
    by one. So data are sent once per strip, and what is found comes back once per range. While strips
    are below ``STRIP_BYTES`` and ranges below ``RANGE_BYTES`` their numbers do not grow with the points."""

    def bands(tiles: int, size: int, most: int, least: int) -> np.ndarray:
        return np.arange(tiles) * max(min(tiles, least), min(tiles, -(-size // most))) // tiles

    strip = bands(met.shape[0], query_bytes, STRIP_BYTES, STRIPS)
    span = bands(met.shape[1], data_bytes, RANGE_BYTES, RANGES)
    q, d = np.nonzero(met)
    names, visit = np.unique(strip[q] * (span[-1] + 1) + span[d], return_inverse=True)
    sent = {side: tuple(np.unique(np.stack([tile, visit]), axis=1)) for side, tile in ((False, q), (True, d))}
    return sent, len(names)


def best_of(k: int) -> Fold:
    """The k nearest of every query among what was found in several blocks."""

    def fold(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        ids, neighbours, distance = (np.concatenate([p[c] for p in parts]) for c in ("id", "neighbour", "distance"))
        order = np.lexsort((neighbours, distance, ids))
        ids = ids[order]
        keep = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
        order = order[keep]
        return {"id": ids[keep], "neighbour": neighbours[order], "distance": distance[order]}

    return fold


def added(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One sum of every query, labelling and cluster over several blocks."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    ids = parts[0]["id"][:0]
    for part in parts:
        if not len(part["id"]):
            continue
        found = int((part["id"] == part["id"][0]).sum())
        ids = part["id"][::found]
        sums = part["total"].reshape(-1, found)
        for j, name in enumerate(zip(part["method"][:found].tolist(), part["cluster"][:found].tolist())):
            totals[name] = totals[name] + sums[:, j] if name in totals else sums[:, j]
    return {
        "id": np.repeat(ids, len(totals)),
        "method": np.tile(np.array([m for m, _ in totals], np.int32), len(ids)),
        "cluster": np.tile(np.array([c for _, c in totals], np.int32), len(ids)),
        "total": np.stack(list(totals.values()), axis=1).ravel() if totals else np.zeros(0),
    }


# ---- kernels ------------------------------------------------------------------------


def _select(qids: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int, itself: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(query, data) positions of the k smallest distances per query, ties by id. With
    ``itself`` the ids name the same rows, and a row is no neighbour of itself. ``ids`` are
    sorted."""
    if itself:
        distance = np.where(qids[:, None] == ids[None, :], np.inf, distance)
    kk = min(k, distance.shape[1])
    cut = np.partition(distance, kk - 1, axis=1)[:, kk - 1 : kk]
    r, c = np.nonzero((distance <= cut) & np.isfinite(distance))
    r, c, _ = _first(r, c, distance[r, c], len(qids), kk)
    return r, c


def _first(r: np.ndarray, c: np.ndarray, distance: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, ...]:
    """The first k (row, column, distance) of every row by distance, ties by column."""
    order = np.lexsort((c, distance, r))
    r, c, distance = r[order], c[order], distance[order]
    first = np.searchsorted(r, np.arange(rows))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep], distance[keep]


def _nearest(qids, qx, ids, x, k: int, itself: bool, scale=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, data, distance) of the k nearest. The product form only narrows the choice:
    whatever lies within its rounding of the k-th is compared by differences."""
    d, slack = _squared(qx, x), _rounding(qx, x)[:, None]
    if scale is not None:
        d, slack = d * scale, slack * scale.max(axis=1, keepdims=True)
    if itself:
        d[qids[:, None] == ids[None, :]] = np.inf
    kk = min(k, d.shape[1])
    cut = np.partition(d, kk - 1, axis=1)[:, kk - 1 : kk]
    r, c = np.nonzero((d <= cut + 2 * slack) & np.isfinite(d))
    exact = np.empty(len(r))
    for lo in range(0, len(r), 1 << 16):
        i, j = r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
        exact[lo : lo + (1 << 16)] = ((qx[i] - x[j]) ** 2).sum(1) * (1.0 if scale is None else scale[i, j])
    r, c, distance = _first(r, c, exact, len(qids), kk)
    return r, c, np.sqrt(distance)


def _nearer(qids, qx, ids, x, cap: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(query, data, distance) of all that is no further than ``cap`` of its query. Single precision
    narrows the choice, with its own rounding; None where that leaves too many."""
    middle = x.mean(axis=0)
    a, b = qx - middle, x - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    slack = 2.0**-23 * (a.shape[1] + 8) * (aa + bb.max())
    if not np.isfinite(slack).all() or slack.max() > 1e30 or slack.max() < 1e-30:
        return None
    left = np.column_stack([-2 * a, np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([b, bb]).astype(np.float32)
    at = np.flatnonzero(left @ right.T <= (cap * cap * (1 + 1e-12) - aa + 2 * slack).astype(np.float32)[:, None])
    if len(at) > len(qx) * len(x) // 16:
        return None
    r, c = np.divmod(at, len(x))
    exact = np.empty(len(r))
    for lo in range(0, len(r), 1 << 12):
        i, j = r[lo : lo + (1 << 12)], c[lo : lo + (1 << 12)]
        exact[lo : lo + (1 << 12)] = ((qx[i] - x[j]) ** 2).sum(1)
    distance = np.sqrt(exact)
    keep = distance <= cap[r]
    if itself:
        keep &= qids[r] != ids[c]
    return r[keep], c[keep], distance[keep]


def nearest_kernel(k: int, itself: bool = True) -> Kernel:
    """With ``best``, what was found before for these queries, only what is as near as their k-th."""

    def kernel(qids, qx, qw, ids, x, w, labels, best=None):
        cap = None if best is None else _farthest(qids, best, k)
        near = None if cap is None else _nearer(qids, qx, ids, x, cap, itself)
        r, c, distance = _nearest(qids, qx, ids, x, k, itself) if near is None else near
        return {"id": qids[r], "neighbour": ids[c], "distance": distance}

    kernel.keeps = k
    return kernel


def _farthest(qids: np.ndarray, best: dict[str, np.ndarray], k: int) -> np.ndarray | None:
    """The k-th distance of every query in ``best``, which has them in order; None while one has fewer."""
    if len(best["id"]) != k * len(qids) or not (np.diff(qids) > 0).all() or not np.array_equal(best["id"][::k], qids):
        return None
    return best["distance"][k - 1 :: k]


def ward_kernel(qids, qx, qw, ids, x, w, labels):
    """Nearest cluster in terms of Ward's criterion, centroids and sizes given."""
    scale = 2.0 * qw[:, None] * w[None, :] / (qw[:, None] + w[None, :])
    r, c, distance = _nearest(qids, qx, ids, x, 1, True, scale)
    return {"id": qids[r], "neighbour": ids[c], "distance": distance}


def gower_kernel(k: int, ranges: Sequence[float | None], itself: bool = True) -> Kernel:
    """Mean over the columns both rows have: range-scaled difference for numbers (a range
    is given), mismatch for codes (no range)."""

    def kernel(qids, qx, qw, ids, x, w, labels):
        total = np.zeros((len(qx), len(x)))
        used = np.zeros((len(qx), len(x)))
        for j, span in enumerate(ranges):
            gap = np.abs(qx[:, j][:, None] - x[:, j][None, :])
            both = ~np.isnan(gap)
            part = (gap != 0).astype(float) if span is None else gap / span if span > 0 else np.zeros_like(gap)
            total += np.where(both, part, 0.0)
            used += both
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(used > 0, total / used, np.inf)
        r, c = _select(qids, ids, distance, k, itself)
        return {"id": qids[r], "neighbour": ids[c], "distance": distance[r, c]}

    return kernel


def cluster_sums_kernel(qids, qx, qw, ids, x, w, labels):
    """Weighted sum of distances from every query to each cluster present in the block,
    for every labelling the points carry (a gap in the labels means not clustered)."""
    labels = labels.reshape(len(ids), -1)
    found, hot = [], []
    for method in range(labels.shape[1]):
        here = labels[:, method]
        for c in np.unique(here[~np.isnan(here)]):
            found.append((method, int(c)))
            hot.append((here == c) * w)
    if not found:  # no row of the block is clustered
        none = np.zeros(0, np.int32)
        return {"id": qids[:0], "method": none, "cluster": none, "total": np.zeros(0)}
    weights = np.array(hot).T
    sums = np.zeros((len(qx), len(found)))
    for lo in range(0, len(qx), 64):  # what stays in the cache of a core
        d = _squared_closely(qx[lo : lo + 64], x)
        sums[lo : lo + 64] = np.sqrt(d, out=d) @ weights
    return {
        "id": np.repeat(qids, len(found)),
        "method": np.tile(np.array([m for m, _ in found], dtype=np.int32), len(qids)),
        "cluster": np.tile(np.array([c for _, c in found], dtype=np.int32), len(qids)),
        "total": sums.ravel(),
    }
