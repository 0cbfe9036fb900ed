"""Token ids in shards compressed by a Re-Pair grammar, with random access by document and position.

Rows are put in ascending key order by ranges and sorted inside each; every task encodes its texts
and closes a shard once it holds ``SHARD_IDS`` ids. Inside a shard frequent pairs of symbols are
replaced by new symbols until no pair occurs ``LEAST`` times: a round counts all pairs, takes those
that are at most ``SPREAD`` times rarer than the most frequent one and gives every symbol one side, so
that no two chosen pairs overlap, and replaces them all at once. A symbol paired with itself is
replaced from the left of each run. Pairs never span two documents.

A shard is one byte string: header, terminal ids, ends of the rounds, rules (two symbols each),
expansion lengths, the symbols of the documents, and an Arrow index with key, ids and symbols of
every document. ``read_ids`` finds a position by the expansion lengths and expands only the symbols
that cover it; ``read_shards`` decodes everything. Shards are rows of a Parquet table in the shared
folder, since only Spark reaches every store; ``export_shards`` writes them as files.

Memory: the ids of one shard, and of its last document. Equal keys are told apart by a hash of the
text and the row's place in the input, so a key shared by any number of rows is cut into ranges, too.

Defined results: a null or empty text is the end id alone. A null key comes first and keeps the
null. Rows with equal keys follow one another, repeated rows are all written. An empty table gives
no shards and no rows. Columns other than key and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.chunk_ids import chunk_ids

SHARD_IDS = 1 << 18  # the arrays of a shard fit into a core's cache
LEAST = 64  # how often a pair must occur to become a rule
SPREAD = 64  # pairs this many times rarer than the most frequent one wait for a later round
AT_ONCE = 1024  # rules made in a round
END_ID = 0

_MAGIC = b"RPAIR\x001\x00"
_HEADER = struct.Struct("<8sIIIIQQ")  # magic, symbol width, terminals, rounds, rules, symbols, ids
_END = 0  # the symbol that ends a document


# ---------------------------------------------------------------- grammar
def _pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, valid): neighbours that may be replaced together."""
    left, right = seq[:-1], seq[1:]
    valid = (left != _END) & (right != _END)
    same = np.flatnonzero(left == right)
    if len(same):
        starts = np.flatnonzero(np.r_[True, same[1:] != same[:-1] + 1])
        first = np.repeat(same[starts], np.diff(np.r_[starts, len(same)]))
        valid[same[(same - first) % 2 == 1]] = False
    return left, right, valid


def _frequent(left: np.ndarray, right: np.ndarray, valid: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Frequent pairs by falling count, then by symbols."""
    small = int(max(left.max(), right.max())) < 1 << 16
    key = np.uint32 if small else np.uint64
    bits = key(16 if small else 32)
    packed = np.sort((left.astype(key) << bits | right.astype(key))[valid])
    if not len(packed):
        return []
    starts = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    counts = np.diff(np.r_[starts, len(packed)])
    chosen = np.flatnonzero(counts >= max(least, int(counts.max()) // SPREAD))
    chosen = chosen[np.argsort(-counts[chosen], kind="stable")]
    found = packed[starts[chosen]].astype(np.uint64)
    bits = np.uint64(bits)
    return list(zip((found >> bits).tolist(), (found & np.uint64((1 << int(bits)) - 1)).tolist()))


def _without_overlap(pairs: list[tuple[int, int]], at_once: int) -> list[tuple[int, int]]:
    """The pairs, frequent ones first, in which every symbol keeps to one side."""
    side: dict[int, str] = {}
    taken = []
    for a, b in pairs:
        if a == b:
            if a in side:
                continue
            side[a] = "both"
        elif side.get(a, "left") == "left" and side.get(b, "right") == "right":
            side[a], side[b] = "left", "right"
        else:
            continue
        taken.append((a, b))
        if len(taken) == at_once:
            break
    return taken


def grammar(seq: np.ndarray, terminals: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(symbols, rules, rounds): ``rules[i]`` is what symbol ``terminals + i`` stands for, and
    ``rounds`` the number of rules after each round, whose rules use only symbols of earlier ones."""
    seq = seq.astype(np.uint32)
    rules: list[tuple[int, int]] = []
    rounds: list[int] = []
    while len(seq) > 1:
        left, right, valid = _pairs(seq)
        taken = _without_overlap(_frequent(left, right, valid, least), AT_ONCE)
        if not taken:
            break
        symbols = terminals + len(rules)
        lefts, rights = sorted({a for a, _ in taken}), sorted({b for _, b in taken})
        row, column = np.zeros(symbols, np.int32), np.zeros(symbols, np.int32)
        row[lefts], column[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        made = np.zeros((len(lefts) + 1, len(rights) + 1), np.uint32)
        for i, (a, b) in enumerate(taken):
            made[row[a], column[b]] = symbols + i
        new = made.ravel()[row[left] * (len(rights) + 1) + column[right]]
        new[~valid] = 0
        at = np.flatnonzero(new)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = new[at]
        seq = seq[keep]
        rules += taken
        rounds.append(len(rules))
    return seq, np.array(rules, np.uint32).reshape(-1, 2), rounds


def expansion_lengths(rules: np.ndarray, terminals: int, rounds: list[int]) -> np.ndarray:
    """How many ids every symbol stands for."""
    lengths = np.ones(terminals + len(rules), np.uint64)
    for first, last in zip([0, *rounds], rounds):
        lengths[terminals + first : terminals + last] = lengths[rules[first:last]].sum(axis=1)
    return lengths


def expand(seq: np.ndarray, rules: np.ndarray, terminals: int, rounds: list[int]) -> np.ndarray:
    """The terminals that symbols stand for, undoing round after round."""
    for first in reversed([0, *rounds[:-1]] if rounds else []):
        at = np.flatnonzero(seq >= terminals + first)
        if not len(at):
            continue
        twice = np.ones(len(seq), np.int64)
        twice[at] = 2
        out = np.repeat(seq, twice)
        at += np.arange(len(at))
        pair = rules[out[at].astype(np.int64) - terminals]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


# ---------------------------------------------------------------- file format
def write_shard(keys: pa.Array, documents: list[bytes], least: int = LEAST) -> bytes:
    """A shard of documents given as little-endian 32-bit ids, each with its end id last."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    lengths = np.array([len(d) // 4 for d in documents], np.int64)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(ids), bool)
    inner[ends] = False
    seen = np.flatnonzero(np.bincount(ids[inner])) if inner.any() else np.zeros(0, np.int64)
    terminals = np.r_[ids[ends[:1]], seen].astype("<u4")
    symbol = np.zeros(int(terminals.max()) + 1, np.uint32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    seq = symbol[ids]
    seq[ends] = _END
    seq, rules, rounds = grammar(seq, len(terminals), least)
    kind = "<u2" if len(terminals) + len(rules) <= 1 << 16 else "<u4"
    index = pa.record_batch([keys, pa.array(lengths), pa.array(np.diff(np.r_[-1, np.flatnonzero(seq == _END)]))], names=["key", "ids", "symbols"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_batch(index)
    parts = [
        _HEADER.pack(_MAGIC, np.dtype(kind).itemsize, len(terminals), len(rounds), len(rules), len(seq), len(ids)),
        terminals.tobytes(),
        np.array(rounds, "<u4").tobytes(),
        rules.astype("<u4").tobytes(),
        expansion_lengths(rules, len(terminals), rounds).astype("<u8").tobytes(),
        seq.astype(kind).tobytes(),
        sink.getvalue().to_pybytes(),
    ]
    return b"".join(parts)


class Shard:
    """The sections of a shard, nothing expanded."""

    def __init__(self, data: bytes):
        magic, width, terminals, rounds, rules, symbols, self.n_ids = _HEADER.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = _HEADER.size

        def section(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.terminals = section("<u4", terminals)
        self.rounds = section("<u4", rounds).tolist()
        self.rules = section("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = section("<u8", terminals + rules)
        self.symbols = section(f"<u{width}", symbols)
        index = pa.ipc.open_stream(pa.py_buffer(data)[at:]).read_all().combine_chunks()
        self.keys = index.column("key")
        self.ids, self.spans = index.column("ids").to_numpy(), index.column("symbols").to_numpy()

    def _terminals_of(self, symbols: np.ndarray) -> np.ndarray:
        return self.terminals[expand(symbols.astype(np.uint32), self.rules, len(self.terminals), self.rounds)]

    def all_ids(self) -> np.ndarray:
        """The ids of all documents."""
        return self._terminals_of(self.symbols)

    def read_ids(self, document: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """``length`` ids of a document from ``start`` on; only the symbols that hold them are expanded."""
        total = int(self.ids[document])
        stop = total if length is None else min(total, start + length)
        if start >= stop:
            return self.terminals[:0]
        first = int(self.spans[:document].sum())
        symbols = self.symbols[first : first + int(self.spans[document])]
        ends = np.cumsum(self.lengths[symbols]).astype(np.int64)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skipped = int(ends[a - 1]) if a else 0
        return self._terminals_of(symbols[a : b + 1])[start - skipped : stop - skipped]


# ---------------------------------------------------------------- Spark
def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS, least: int = LEAST
) -> None:
    """Write ``docs`` as shards (part, shard, start, n_docs, n_ids, payload) in ascending key order;
    ``start`` counts the ids before the shard in its part."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("row")]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = chunk_ids(tokenizer_path).of, np.array([end_id], "<u4").tobytes()
        number = start = held = 0
        keys: list[pa.Array] = []
        documents: list[bytes] = []

        def closed() -> pa.RecordBatch:
            taken = pa.concat_arrays(keys)
            values = [[part], [number], [start], [len(documents)], [held], [write_shard(taken, documents, least)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, [pa.int32(), *[pa.int64()] * 4, pa.binary()])], names=["part", "shard", "start", "n_docs", "n_ids", "payload"]
            )

        for batch in batches:
            for at in range(batch.num_rows):
                documents.append(encode(batch.column(1)[at].as_py()) + end)
                keys.append(batch.column(0).slice(at, 1))
                held += len(documents[-1]) // 4
                if held >= shard_ids:
                    yield closed()
                    number, start, held, keys, documents = number + 1, start + held, 0, [], []
        if documents:
            yield closed()

    schema = "part int, shard long, start long, n_docs long, n_ids long, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(path)


def read_shards(shards: DataFrame, key_type: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32 and, if asked for, ids) of all documents of written shards."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a row per task is far smaller than a shard, which would move otherwise
    placed = shards.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("start")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                ids = shard.all_ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.ids)
                cuts = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), shard.ids.tolist())]
                columns = [shard.keys, pa.array(start + ends - shard.ids), pa.array(shard.ids), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                names = ["key", "start", "n_tokens", "ids_crc32"]
                whole = pa.RecordBatch.from_arrays([*columns, *([pa.array(cuts, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])
                for at in range(0, whole.num_rows, 4096):
                    yield whole.slice(at, 4096)

    schema = f"key {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return placed.mapInArrow(run, schema).withColumnRenamed("key", key)


def export_shards(shards: DataFrame, folder: str) -> int:
    """Write the shards as files on this machine, one at a time; how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in shards.select("part", "shard", "payload").toLocalIterator():
        with open(os.path.join(folder, f"{r['part']:06d}-{r['shard']:06d}.rpair"), "wb") as out:
            out.write(r["payload"])
        n += 1
    return n
