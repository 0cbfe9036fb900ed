"""Periodic runs of words by Baier's grouping and Lyndon roots, and texts with the repeats taken out.

A run is a maximal stretch of words with smallest period q and a length of at least ``LEAST`` and
``EXPONENT`` times q. For one of the two orders of the words, the plain one and its reverse, every run
holds a Lyndon word of length q that is the longest one at its start. Those lengths, the Lyndon array,
are what the first phase of Baier's suffix sorter leaves: it groups the suffixes by their longest
Lyndon prefix, from the greatest group to the smallest, without sorting inside a group. Every start
whose Lyndon word is followed by others of its length is then extended to both sides by the longest common
extension of the text with itself q words on; the results are the runs.

Words of a run occur at least ``EXPONENT`` times in it, one in every period. So words that occur less
often in a text end every run, and the text falls into stretches in which the same holds again. The
grouping works on the stretches that are left; a text of frequent words alone is one stretch.

Texts are worked on row by row inside Spark tasks, whole, whatever their length; memory is some
hundred bytes a word of the longest text.

Defined results: a null or empty text has no words and no runs. A null key is never planted. Rows are
treated one by one, so repeated rows give repeated results; ties for the greatest exponent go to the
smallest start, then the smallest period. An empty table gives no rows. Only key and text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPONENT = 4
LEAST = 6


# ---------------------------------------------------------------- Lyndon array
def lyndon_array(codes: list[int]) -> list[int]:
    """The length of the longest Lyndon word at every position, by grouping suffixes.

    Groups lie in ``place`` one after the other, at first one per letter. The greatest group that is
    not done is taken; the nearest position to the left of each member that lies in a smaller group
    takes the member's Lyndon word behind its own, and positions that took more words go to a
    greater group. Done positions are skipped by pointers that are shortened on the way.
    """
    n = len(codes)
    place = sorted(range(n), key=codes.__getitem__)
    at = [0] * n  # where a position lies in ``place``
    group = [0] * n  # where its group begins
    size = [0] * n  # of the group that begins here
    first = 0
    for i, p in enumerate(place):
        at[p] = i
        if i and codes[p] != codes[place[i - 1]]:
            first = i
        group[p] = first
        size[first] += 1
    length = [1] * n
    left = list(range(n))  # the nearest position to the left, or here, that is not done; shifted by one below
    left.append(n)
    end = n
    while end:
        first = group[place[end - 1]]
        members = place[first:end]
        end = first
        word = length[members[0]]
        for p in members:
            left[p + 1] = p  # done: go on with the position before
        took: dict[int, int] = {}
        for p in members:
            root = p
            while left[root] != root:
                root = left[root]
            while left[p] != root:
                left[p], p = root, left[p]
            if root:
                took[root - 1] = took.get(root - 1, 0) + 1
        if not took:
            continue
        if len(took) == 1:
            ((p, times),) = took.items()
            rounds = [(times, [p])]
        else:
            by_times: dict[int, list[int]] = {}
            for p, times in took.items():
                by_times.setdefault(times, []).append(p)
            rounds = sorted(by_times.items(), reverse=True)
        for times, moved in rounds:
            more = times * word
            old = []
            for p in moved:
                g = group[p]
                size[g] -= 1
                last = g + size[g]
                other = place[last]
                i = at[p]
                place[i], at[other] = other, i
                place[last], at[p] = p, last
                length[p] += more
                old.append(g)
            for p, g in zip(moved, old):
                start = g + size[g]
                group[p] = start
                if start != g:
                    size[start] += 1
            for g in set(old):
                if not size[g]:  # the whole group took as much: it stays where it is
                    size[g] = sum(1 for h in old if h == g)
    return length


def _extension(codes: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``start`` in which words ``period`` apart are equal, as (first, end)."""
    n, step = len(codes), 64
    end = start
    while end + period < n:
        some = codes[end : end + step]
        ahead = codes[end + period : end + period + step]
        differ = np.flatnonzero(some[: len(ahead)] != ahead)
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + len(ahead), 2 * step
    first, step = start, 64
    while first:
        low = max(0, first - step)
        differ = np.flatnonzero(codes[low:first] != codes[low + period : first + period])
        if len(differ):
            first = low + int(differ[-1]) + 1
            break
        first, step = low, 2 * step
    return first, end + period


def runs_of(codes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of non-negative codes, by start and period."""
    n = len(codes)
    if n < max(least, exponent):
        return []
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    found = set()
    for order in (codes, codes.max() - codes):
        length = np.array(lyndon_array(order.tolist()), np.int64)
        start = np.arange(n)
        for times in range(1, exponent - 1):  # a run holds so many more Lyndon words after the first whole one
            start = start[start + times * length[start] < n]
            start = start[length[start + times * length[start]] == length[start]]
        reached: dict[int, int] = {}  # by period, the end of the last stretch looked at
        for s, period in zip(start.tolist(), length[start].tolist()):
            if s + period < reached.get(period, 0):
                continue  # another word of the same stretch
            first, end = _extension(codes, s, period)
            reached[period] = end
            if end - first >= max(least, exponent * period):
                found.add((first, end - first, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def frequent_stretches(codes: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches a run can lie in: inside, every code occurs ``times`` times.
    Negative codes belong to no stretch."""
    todo, settled = [(0, len(codes))], []
    alive = codes >= 0
    while todo:
        following = []
        for a, b in todo:
            inside = alive[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
            for first, end in zip((edges[::2] + a).tolist(), (edges[1::2] + a).tolist()):
                if end - first < max(least, times):
                    continue
                part = codes[first:end]
                _, which, counts = np.unique(part, return_inverse=True, return_counts=True)
                rare = counts[which] < times
                if rare.any():
                    alive[first:end] = ~rare
                    following.append((first, end))
                else:
                    settled.append((first, end))
        todo = following
    return sorted(settled)


def text_runs(words: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words."""
    if len(words) < max(exponent, least):
        return []
    code = {w: i for i, w in enumerate(w for w, c in Counter(words).items() if c >= exponent)}
    if not code:
        return []
    codes = np.fromiter(map(code.get, words, repeat(-1)), np.int64, len(words))
    found = []
    for first, end in frequent_stretches(codes, exponent, least):
        found += [(s + first, n, q) for s, n, q in runs_of(codes[first:end], exponent, least)]
    return found


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


# ---------------------------------------------------------------- query
def planted(words: list, key: int | None) -> list:
    """The words with a repetition planted for every tenth key, by its crc32."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    times = -(-(n - a) // p)
    return words[:a] + (root * times)[: n - a]


def _facts(words: list) -> tuple:
    runs = text_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(without_repeats(words, runs))
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), runs,
    )


def detect_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, with_runs: bool = False) -> DataFrame:
    """One row per text: number of runs, the run of greatest exponent (start, length, period,
    exponent_milli), runs_sha256, collapsed_sha256 and, if asked for, all runs. ``plant`` first
    plants a repetition into every tenth text."""
    kind = docs.schema[key].dataType.simpleString()
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"][: 8 if with_runs else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                # bytes are split at the six ASCII white-space characters and nothing else
                words = (batch.column(1)[i].as_py() or "").encode("utf-8").split()
                rows.append(_facts(planted(words, batch.column(0)[i].as_py()) if plant else words))
            columns = list(zip(*rows)) if rows else [[]] * 8
            if with_runs:
                columns[7] = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in columns[7]]
            arrays = [pa.array(list(c), t) for c, t in zip(columns[: len(names)], types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", *names])

    fields = [f"{n} {'string' if n.endswith('sha256') else 'bigint'}" for n in names[:7]]
    fields += ["runs array<struct<start: bigint, length: bigint, period: bigint>>"] if with_runs else []
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, {', '.join(fields)}").withColumnRenamed("key", key)
