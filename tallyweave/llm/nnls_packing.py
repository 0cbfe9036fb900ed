"""Packing tokenised documents into windows by non-negative least squares.

A document's ids are cut into whole windows and one remaining piece. The histogram of those
pieces, in ``BINS`` steps of the window, is all the plan needs: every combination of up to
``DEPTH`` steps that fills a window is enumerated once, and non-negative least squares finds
how often each should be repeated so that the histogram is used up. Every task packs the pieces
of its own partition: it takes its share of the repeats, rounded over all its blocks, as far as
its pieces go.
Pieces are a little longer or shorter than their step; what a window lacks is padding, and what
runs over is cut off and joins the pieces that no combination took. Those are packed greedily:
longest first, cut where a window is full. What is left at the end of a task is cut into powers
of two, which need no padding.

Documents are tokenised once; the ids are stored in the shared folder between the two passes.
Memory holds the pieces of ``BLOCK_TOKENS`` ids at a time, each block packed by itself.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each. A row
whose key is null keeps the null. An empty table gives no rows. Columns other than key and text are
not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut_lineage

WINDOW = 4096
BINS = 64
DEPTH = 6
END_ID = 2
BLOCK_TOKENS = 16_000_000
CACHED_WORDS = 1_000_000  # words a worker keeps

_ENDINGS = ".,;:!?"
_LATIN_END = "\u0250"  # letters below are single code points in every normal form NFC
# how byte-level tokenizers write bytes: printable letters stand for themselves
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _KEPT]
_LETTERS = "".join(chr(256 + _OTHERS.index(b) if b in _OTHERS else b) for b in range(256))


# ---------------------------------------------------------------- tokens
@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _WordIds(dict):
    """Ids of white-space separated words as little-endian 32-bit bytes.

    A tokenizer that works word by word and drops white space gives a text the ids of its words
    one after the other; whether it does is tried out, else whole texts are encoded. A word that
    ends in punctuation is put together from its two parts, as the tokenizer cuts there. Plain
    Latin words go to the tokenizer's model at once, which skips its normalisation; that, too, is
    tried out first.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        probe = ["Onze", "words", "d'été,", "x1.", "ñandú", "ABC's"]
        apart = [i for w in probe for i in ids(w)]
        self.by_words = ids(" ".join(probe)) == ids("\n" + " \t".join(probe) + "  ") == apart
        self.by_words = self.by_words and ids("Été") == ids("été") and ids("word.") == ids("word") + ids(".")
        self.tokenize = self.tokenizer.model.tokenize
        self.stems: dict[str, bytes] = {}
        self.endings = {e: np.array(ids(e), dtype="<u4").tobytes() for e in _ENDINGS}
        self.direct = self.by_words and all(self._direct(w) == np.array(ids(w), "<u4").tobytes() for w in ("onze", "été", "ñandú", "x", "ß"))

    def _direct(self, word: str) -> bytes:
        found = self.tokenize(charmap_decode(word.encode("utf-8"), "strict", _LETTERS)[0])
        return array("I", [t.id for t in found]).tobytes()

    def _stem_ids(self, stem: str) -> bytes | None:
        """Ids of a plain Latin word in any case, None for any other."""
        if not self.direct or not stem.isalpha():
            return None
        if not stem.isascii() and (max(stem) >= _LATIN_END or "\u0130" in stem):
            return None
        low = stem.lower()
        ids = self.stems.get(low)
        if ids is None:
            ids = self.stems[low] = self._direct(low)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            # the words seen first are the frequent ones: keep half of them
            for w in list(self)[CACHED_WORDS // 2 :]:
                del self[w]
            self.stems.clear()
        text = word.decode("utf-8")
        ids = self._stem_ids(text)
        if ids is None and text[-1] in self.endings:
            ids = self._stem_ids(text[:-1])
            if ids is not None:
                ids += self.endings[text[-1]]
        if ids is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = ids
        return ids

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of some texts."""
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(f.ids, dtype="<u4").tobytes() for f in found]
        # bytes are split at the six ASCII white-space characters and nothing else
        return [b"".join(map(self.__getitem__, t.encode("utf-8").split())) if t else b"" for t in texts]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> _WordIds:
    """The cache of this worker, kept from task to task."""
    return _WordIds(path)


def tokenise(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, doc_tokens): the little-endian 32-bit ids of every row, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _word_ids(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                ids = [i + end for i in words.of(cut.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], names=["doc_id", "ids", "doc_tokens"]
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, doc_tokens bigint")


# ---------------------------------------------------------------- plan
def step_of(length: np.ndarray, window: int = WINDOW, bins: int = BINS) -> np.ndarray:
    """The nearest of 1..bins steps to a length of 1..window."""
    return np.clip((length * bins + window // 2) // window, 1, bins)


def combinations_filling(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Every multiset of up to ``depth`` steps with sum ``bins``, one per row as counts by step."""
    found: list[list[int]] = []

    def extend(chosen: list[int], left: int, most: int) -> None:
        if left == 0:
            found.append(chosen)
            return
        slots = depth - len(chosen)
        if slots * most < left:
            return
        for step in range(min(most, left), 0, -1):
            if slots * step < left:
                break
            extend([*chosen, step], left - step, step)

    extend([], bins, bins)
    counts = np.zeros((len(found), bins + 1), np.int16)
    for row, steps in enumerate(found):
        for s in steps:
            counts[row, s] += 1
    return counts


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |columns @ x - target| by the active-set method of Lawson and Hanson."""
    x = np.zeros(columns.shape[1])
    active = np.zeros(columns.shape[1], bool)
    limit = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = columns.T @ (target - columns @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= limit:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            solved = np.linalg.lstsq(columns[:, chosen], target, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[chosen] = solved
                break
            negative = solved <= 0
            ratio = x[chosen][negative] / (x[chosen][negative] - solved[negative])
            step = float(ratio.min()) if len(ratio) else 0.0
            x[chosen] += step * (solved - x[chosen])
            active[chosen[(x[chosen] <= limit) & negative]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_repeats(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeats) with repeats above zero, for a histogram of steps 0..BINS."""
    combos = combinations_filling()
    columns = combos[:, 1:].T.astype(float)
    repeats = non_negative_least_squares(columns, histogram[1:].astype(float))
    used = np.flatnonzero(repeats > 0)
    used = used[np.argsort(-repeats[used], kind="stable")]
    return combos[used], repeats[used]


# ---------------------------------------------------------------- packing
class _Sequences:
    """Pieces laid into numbered windows."""

    def __init__(self, first: int):
        self.next, self.rows = first, []

    def lay(self, pieces: list[tuple[int, int, int]]) -> None:
        """One window of (document, start, length)."""
        offset = 0
        for doc, start, length in pieces:
            self.rows.append((doc, start, length, self.next, offset))
            offset += length
        self.next += 1


def _powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack_block(lengths: list[int], combos: np.ndarray, repeats: np.ndarray, share: float, first: int, window: int = WINDOW, owed: np.ndarray | None = None):
    """[(document, start, length, sequence, offset)] and the next free sequence number.

    ``owed`` are the repeats that the blocks before came short of by rounding; it is brought up to date."""
    owed = np.zeros(len(repeats)) if owed is None else owed
    owed += repeats * share
    out = _Sequences(first)
    shelves: list[list[tuple[int, int, int]]] = [[] for _ in range(BINS + 1)]
    for doc, total in enumerate(lengths):
        start = 0
        while total - start >= window:
            out.lay([(doc, start, window)])
            start += window
        if start < total:
            shelves[int(step_of(np.int64(total - start)))].append((doc, start, total - start))
    loose: list[tuple[int, int, int]] = []
    for which, combo in enumerate(combos):
        steps = np.flatnonzero(combo)
        for _ in range(int(np.rint(owed[which]))):
            if any(len(shelves[s]) < combo[s] for s in steps):
                break
            pieces = [shelves[s].pop() for s in steps[::-1] for _ in range(combo[s])]
            room, laid = window, []
            for doc, start, length in pieces:
                part = min(length, room)
                if part:
                    laid.append((doc, start, part))
                if part < length:
                    loose.append((doc, start + part, length - part))
                room -= part
            out.lay(laid)
            owed[which] -= 1
    loose += [piece for shelf in shelves for piece in shelf]
    loose.sort(key=lambda p: (-p[2], p[0], p[1]))
    room, laid = window, []
    for doc, start, length in loose:
        while length:
            part = min(length, room)
            laid.append((doc, start, part))
            start, length, room = start + part, length - part, room - part
            if not room:
                out.lay(laid)
                room, laid = window, []
    # the last, unfilled window: cut into powers of two
    sizes = _powers(window - room) if laid else []
    for size in sizes:
        some = []
        while size:
            doc, start, length = laid.pop(0)
            part = min(length, size)
            some.append((doc, start, part))
            if part < length:
                laid.insert(0, (doc, start + part, length - part))
            size -= part
        out.lay(some)
    return out.rows, out.next


_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    asked for, ids (little-endian 32-bit)."""
    stored = cut_lineage(tokenise(docs, key, text, tokenizer_path, end_id))
    rest = F.pmod(F.col("doc_tokens"), F.lit(WINDOW))
    step = F.greatest(F.lit(1), F.floor((rest * BINS + WINDOW // 2) / WINDOW)).cast("int")
    counted = stored.where(rest > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = np.zeros(BINS + 1)
    for r in counted:  # one row per step
        histogram[r["step"]] = r["n"]
    combos, repeats = plan_repeats(histogram)
    pieces = max(1.0, float(histogram.sum()))
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40

        # what rounding leaves goes on to the next block; where a task begins is drawn, so that many
        # small tasks take their shares on average, too
        owed = np.random.default_rng(sequence >> 40).uniform(-0.5, 0.5, len(repeats))

        def packed(block: list[pa.RecordBatch], sequence: int):
            whole = pa.Table.from_batches(block)
            ids, keys = whole.column("ids").to_pylist(), whole.column("doc_id")
            lengths = [len(i) // 4 for i in ids]
            share = sum(1 for n in lengths if n % WINDOW) / pieces
            rows, following = pack_block(lengths, combos, repeats, share, sequence, owed=owed)
            return _as_batches(rows, ids, keys, lengths, with_ids), following

        block, held = [], 0
        for batch in batches:
            block.append(batch)
            held += batch.column(1).nbytes // 4
            if held >= BLOCK_TOKENS:
                out, sequence = packed(block, sequence)
                yield from out
                block, held = [], 0
        if block:
            yield from packed(block, sequence)[0]

    return stored.select("doc_id", "ids").mapInArrow(
        run,
        f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in _COLUMNS) + (", ids binary" if with_ids else ""),
    ).withColumnRenamed("doc_id", key)


def _as_batches(
    rows: list[tuple], ids: list[bytes], keys: pa.ChunkedArray, lengths: list[int], with_ids: bool
) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        some = rows[at : at + 4096]
        doc = [r[0] for r in some]
        cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in some]
        taken = keys.take(pa.array(doc, pa.int64()))
        numbers = [
            [r[1] for r in some], [r[2] for r in some], [zlib.crc32(c) for c in cut], [lengths[d] for d in doc], [r[3] for r in some], [r[4] for r in some],
        ]
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        arrays = [taken, *[pa.array(n, pa.int64()) for n in numbers], *([pa.array(cut, pa.binary())] if with_ids else [])]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_COLUMNS, *(["ids"] if with_ids else [])])
