"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints: 64 bits, each set if it is set in over half of the XXH64 hashes of the text's
four-word shingles. Two fingerprints are linked at ``RADIUS`` = 4 or fewer differing bits.

Search. A fingerprint is mapped to 32 bit counts, one per two-bit segment. One differing bit
moves one count by one, so the Manhattan distance of two embeddings never exceeds the number of
differing bits: pairs farther apart than the radius are no links. The range join runs on a grid
over the embedding: the 32 counts form 8 groups of 4, and a Manhattan distance of 4 or less
changes 4 groups at most, so two linked fingerprints agree in at least 4 whole groups. Every
fingerprint is put into the 70 cells given by four of its groups; pairs of a cell are tested
by the Manhattan bound and then by their exact distance.

Cells are sorted runs, read as a stream. A run of up to ``RUN`` fingerprints is compared inside;
the members of longer runs are linked exactly and without pairs through midpoints: two
fingerprints differ in at most 4 bits just if some 64-bit number differs from both in at most 2.
Each member is listed under the 2,081 numbers around it and neighbours in such a list are
linked; no list is longer than 2,081.

Only different fingerprints are searched, so copies cost nothing however many there are.

Defined results: a null text has no words; no words give fingerprint zero, linked like any other;
fewer than four words are one shingle. A document linked to none is its own component. Of
repeated keys every row is returned. A component of rows with null keys only has a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from tallyweave.operators.components import connected_components
from tallyweave.session import cut_lineage

SHINGLE = 4
SEED = 42
RADIUS = 4
GROUPS = 8  # of one byte each: four counts of two bits
RUN = 256  # longer runs take the way by midpoints; the links found are the same
HASHES_AT_ONCE = 1 << 16

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_EVEN = 0x5555555555555555


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The XXH64 hashes of all shingles of ``size`` words; of all words if there are fewer."""
    words = _WORDS.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def fingerprint_of(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = _WORDS.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES_AT_ONCE):
        cut = slice(at, at + HASHES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[cut].tolist(), ends[cut].tolist())], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of unsigned 64-bit hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


@F.pandas_udf(LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint as a signed long."""
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def embedding(fingerprint: Column) -> Column:
    """The 32 bit counts of the two-bit segments, packed into one long."""
    even, upper = F.lit(_EVEN), F.shiftrightunsigned(fingerprint, 1)
    both = F.shiftleft(fingerprint.bitwiseAND(upper).bitwiseAND(even), 1)
    return both.bitwiseOR(fingerprint.bitwiseXOR(upper).bitwiseAND(even))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cell_masks() -> list[int]:
    """Masks of all choices of GROUPS - RADIUS groups of the embedding."""
    chosen = combinations(range(GROUPS), GROUPS - RADIUS)
    return [_signed(sum(0xFF << (8 * g) for g in c)) for c in chosen]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: counts 0, 1, 2 in two bits each."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for j in range(0, 64, 8):  # one byte, four counts, at a time through a table
        total += _BYTE_DISTANCE[((a >> np.uint64(j)) & np.uint64(255)).astype(np.int64), ((b >> np.uint64(j)) & np.uint64(255)).astype(np.int64)]
    return total


def _byte_distances() -> np.ndarray:
    counts = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    return np.abs(counts[:, None, :] - counts[None, :, :]).sum(axis=2)


_BYTE_DISTANCE = _byte_distances()


def _embedded(fps: np.ndarray) -> np.ndarray:
    even = np.uint64(_EVEN)
    return (fps & even) + ((fps >> np.uint64(1)) & even)


def _tested(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are links: first the bound, then the exact distance."""
    near = manhattan(_embedded(a), _embedded(b)) <= RADIUS
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= RADIUS
    return near


def _links_of_short_runs(fps: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of the same run; ``runs`` are run numbers in ascending order."""
    left, right = [], []
    lag = 1
    while lag < len(fps):
        same = np.flatnonzero(runs[lag:] == runs[:-lag])
        if not len(same):
            break
        for at in range(0, len(same), 1 << 18):
            i = same[at : at + (1 << 18)]
            hit = i[_tested(fps[i], fps[i + lag])]
            left.append(fps[hit])
            right.append(fps[hit + lag])
        lag += 1
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node with the smallest one it hangs on."""
    if not len(left):
        return left, right
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


_RUN_SCHEMA = "src long, dst long"


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, key): links of short runs, and members of long ones with no partner."""

    def out(src, dst) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(src.view(np.int64)), pa.array(None if dst is None else dst.view(np.int64)) if dst is not None else pa.nulls(len(src), pa.int64())],
            names=["src", "dst"],
        )

    held = None  # the rows of the run that the last batch broke off
    long_run = None  # the key of a long run being passed on
    for batch in batches:
        cell = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        fps = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if held is not None:
            cell, key, fps = (np.concatenate(x) for x in zip(held, (cell, key, fps)))
            held = None
        if not len(cell):
            continue
        if long_run is not None:
            more = (cell == long_run[0]) & (key == long_run[1])
            if more.any():
                yield out(fps[more], None)
            if more.all():
                continue
            cell, key, fps = cell[~more], key[~more], fps[~more]
            long_run = None
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])])
        runs = np.cumsum(new) - 1
        size = np.bincount(runs)
        last = runs == runs[-1]
        if size[-1] > RUN:
            long_run = (cell[-1], key[-1])
        else:
            held = (cell[last], key[last], fps[last])
        over = size[runs] > RUN
        if over.any():
            yield out(fps[over], None)
        short = ~over & ~last if long_run is None else ~over
        src, dst = _forest(*_links_of_short_runs(fps[short], runs[short]))
        if len(src):
            yield out(src, dst)
    if held is not None:
        src, dst = _forest(*_links_of_short_runs(held[2], np.zeros(len(held[2]), np.int64)))
        if len(src):
            yield out(src, dst)


def _midpoints() -> list[int]:
    ones = [1 << i for i in range(64)]
    return [_signed(m) for m in [0, *ones, *(a | b for a, b in combinations(ones, 2))]]


def links_by_midpoints(members: DataFrame) -> DataFrame:
    """(src, dst) that connect just what links of the fingerprints ``fp`` connect."""
    offsets = F.split(F.lit(",".join(map(str, _midpoints()))), ",").cast("array<bigint>")
    around = members.select("fp", F.explode(offsets).alias("_mask")).select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("_mid"))
    order = Window.partitionBy("_mid").orderBy("fp")
    return around.select("fp", F.lag("fp").over(order).alias("dst")).where("dst IS NOT NULL").select(F.col("fp").alias("src"), "dst").distinct()


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """(src, dst): edges whose components are those of all links between the distinct ``fp``."""
    masks = F.array(*[F.lit(m).cast("long") for m in cell_masks()])
    cells = (
        fingerprints.select("fp", embedding(F.col("fp")).alias("_counts"), F.posexplode(masks).alias("cell", "_mask"))
        .select("cell", F.col("_counts").bitwiseAND(F.col("_mask")).alias("key"), "fp")
        .repartition("cell", "key")
        .sortWithinPartitions("cell", "key")
    )
    scanned = cut_lineage(cells.mapInArrow(_scan_runs, _RUN_SCHEMA).distinct())
    found = scanned.where("dst IS NOT NULL")
    rest = scanned.where("dst IS NULL").select(F.col("src").alias("fp"))
    return found.unionByName(links_by_midpoints(rest))


def components_of(fingerprinted: DataFrame, key: str, fp: str) -> DataFrame:
    """(fp, first): every distinct fingerprint with the smallest key of its component."""
    distinct = cut_lineage(
        fingerprinted.groupBy(F.col(f"`{fp}`").alias("fp")).agg(F.min(F.col(f"`{key}`")).alias("first"))
    )
    nodes = connected_components(fingerprint_links(distinct.select("fp")))
    joined = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = joined.groupBy("component").agg(F.min("first").alias("lowest"))
    return joined.join(lowest, "component").select("fp", F.col("lowest").alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row."""
    hashed = cut_lineage(docs.select(F.col(f"`{key}`").alias("_key"), simhash(F.col(f"`{text}`")).alias("_fp")))
    parts = components_of(hashed, "_key", "_fp")
    return hashed.join(parts, F.col("_fp") == F.col("fp"), "left").select(
        F.col("_key").alias(key), as_hex(F.col("_fp")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest key, and of rows
    that share it the one with the smallest text."""
    columns = docs.columns
    packed = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{key}`").alias("_key"),
        F.xxhash64(F.col(f"`{text}`")).alias("_text_hash"),
        simhash(F.col(f"`{text}`")).alias("_fp"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"),
    )
    stored = cut_lineage(packed)
    small = stored.select(F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_text_hash").alias("t"), F.col("_row").alias("r")).alias("_rank"), "_fp")
    parts = components_of(small, "_rank", "_fp")
    chosen = parts.select(F.col("first.r").alias("_row")).distinct()
    return stored.join(chosen, "_row", "left_semi").select(*[F.col("_doc").getField(c).alias(c) for c in columns])
