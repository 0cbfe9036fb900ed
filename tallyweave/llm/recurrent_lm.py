"""Scoring documents with a gated recurrent language model.

Tokens are the words of the text with A-Z in lower case, and one end per text. The model
predicts units: the end, the ``UNITS`` most frequent training words, and for all other words one
of ``RARE`` groups chosen by the word's last two letters; within a group a word has its smoothed
share of the group's training tokens. Units are put into classes of about equal sums of
roots of frequencies, and the output is a softmax over classes times a softmax over the units of
the class. The network is a gated recurrent unit in numpy. Its biases start at the training
frequencies, so it begins as a unigram model and learns from there.

Counting covers every training token: tasks send (word, count), which Spark adds up. The network
is fitted in ``ROUNDS`` rounds, which share all training documents by hash: every document is
learned from once. In each round every task runs truncated backpropagation over its documents of
the round, starting from the common weights; the weights are averaged by tokens in a tree of tasks. Documents run side by side in lanes; a document's state is carried
from window to window to its end, in training and in scoring, so the score is that of the
complete text. Counts of words outside the ``KNOWN`` most frequent ones come by a join.

Defined results: a null text is empty and has the end token only. Repeated rows are scored each.
Without training documents all counts are 0 and the base score is 0. A null key is never held
out. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import io
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyweave.llm.common import held_fold
from tallyweave.session import cut_lineage

UNITS = 4096
KNOWN = 131072  # words whose counts go to every task; the others are joined
RARE = 64
CLASSES = 43
STATE = 24
WINDOW = 32
TRAIN_LANES = 128
SCORE_LANES = 192
SCORE_WINDOW = 96  # scores do not depend on it: the state is carried over
ROUNDS = 4
RATE = 0.1
FIRST_SQUARE = 1e-8  # what the sums of squared gradients start at
CLIP = 5.0
LANE_TOKENS = 3_000_000  # tokens worked on at a time
TASK_TOKENS = 2_000_000  # tokens a task learns from in a round, at least; fewer leave lanes idle beside long texts
COUNTED_AT_ONCE = 400_000
FAN_IN = 16

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words_in(text: str | bytes | None) -> list[bytes]:
    """The words in UTF-8; ``bytes.lower`` touches A-Z only."""
    whole = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    return _WORDS.findall(whole.lower())


def rare_group(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


def _rare_group_column(word: Column) -> Column:
    last = F.substring(F.encode(word, "UTF-8"), -2, 2)
    return F.pmod(F.crc32(last), F.lit(RARE)).cast("int")


# ---------------------------------------------------------------- counts and vocabulary
def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (one string column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(words_in(text.as_py()))
                if len(counts) >= COUNTED_AT_ONCE:
                    yield flushed()
        yield flushed()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Units, their classes, and the counts that every task knows."""

    def __init__(self, known: list[tuple[bytes, int]], ends: int, rare: dict[int, tuple[int, int]], tokens: int, types: int, units: int):
        """``known``: the most frequent words with their counts, in that order."""
        self.ends, self.tokens, self.types = ends, tokens, types
        self.rare = [rare.get(g, (0, 0)) for g in range(RARE)]
        named: list[tuple[object, int]] = [(None, ends), *known[:units], *((g, self.rare[g][0]) for g in range(RARE))]
        named.sort(key=lambda x: -x[1])
        place = {name: i for i, (name, _) in enumerate(named)}
        self.end = place[None]
        self.groups = np.array([place[g] for g in range(RARE)], np.int32)
        # by place in ``known``: the unit, and log10 of the smoothed count
        self.rank = {w: i for i, (w, _) in enumerate(known)}
        self.unit_of = np.array([place[w] if i < units else self.groups[rare_group(w)] for i, (w, _) in enumerate(known)], np.int32)
        self.log_of = np.log10(np.array([n for _, n in known], np.float64) + 0.5)
        self.shared = np.arange(len(known)) >= units  # known, but without a unit of their own
        self.counts = np.array([n for _, n in named], np.float64) + 0.5
        # of the root of the frequency every class has about the same, which makes softmaxes smallest
        share = np.sqrt(self.counts)
        share /= share.sum()
        middle = np.cumsum(share) - share / 2
        classes = np.unique((middle * CLASSES).astype(int), return_inverse=True)[1]
        self.narrow = np.int16 if len(named) < 1 << 15 else np.int32  # sorted in linear time
        self.class_of = classes.astype(self.narrow)
        self.first = np.searchsorted(classes, np.arange(classes.max() + 2)).astype(np.int64)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Places in the list of known words, -1 for others."""
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))

    def unit_ids(self, words: list[bytes], ranks: np.ndarray) -> np.ndarray:
        """Units of a text, the end last."""
        ids = np.empty(len(words) + 1, np.int32)
        ids[-1] = self.end
        other = np.flatnonzero(ranks < 0)
        if len(self.unit_of):
            ids[:-1] = self.unit_of[ranks]
        ids[other] = self.groups[[rare_group(words[i]) for i in other.tolist()]]
        return ids

    def rare_log(self, group: int) -> float:
        """log10 of what a smoothed count in the group is divided by."""
        n, v = self.rare[group]
        return math.log10(n + 0.5 * (v + 1))


# ---------------------------------------------------------------- the network
def start_weights(vocabulary: Vocabulary, state: int = STATE, seed: int = 0) -> dict[str, np.ndarray]:
    """``x`` and ``b``: candidate, reset, update; ``u``: reset, update, candidate; the last row of
    ``wc`` and the last column of ``wo`` are the biases."""
    rng = np.random.default_rng(seed)
    units, classes = len(vocabulary.counts), len(vocabulary.first) - 1
    sums = np.add.reduceat(vocabulary.counts, vocabulary.first[:-1])
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    w = {
        "x": small(units, 3 * state),
        "u": small(state, 3 * state),
        "b": np.zeros(3 * state, np.float32),
        "wc": small(state + 1, classes),
        "wo": small(units, state + 1),
    }
    w["wc"][-1] = np.log(sums / sums.sum())
    w["wo"][:, -1] = np.log(vocabulary.counts / sums[vocabulary.class_of])
    return w


def to_bytes(weights: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


class Tape:
    """What the way back needs of every step of a window: the state before it, the reset and update
    gates, the candidate and its recurrent part."""

    def __init__(self, steps: int, lanes: int, size: int):
        self.before, self.inner, self.candidate = (np.empty((steps, lanes, size), np.float32) for _ in range(3))
        self.gates = np.empty((steps, lanes, 2 * size), np.float32)


def _recur(w, x: np.ndarray, keep: np.ndarray, h: np.ndarray, tape: Tape | None) -> tuple[np.ndarray, np.ndarray]:
    """States (T, A, H) after each step of gate inputs x (T, A, 3H), which are overwritten; keep is 0
    where a text begins."""
    size = h.shape[1]
    u = w["u"]
    states = np.empty((*x.shape[:2], size), np.float32)
    begins = (keep == 0).any(axis=1).tolist()
    np.negative(x[:, :, size:], out=x[:, :, size:])
    for t in range(len(x)):
        if begins[t]:
            h = h * keep[t][:, None]
        hu = h @ u
        g = x[t, :, size:]
        g -= hu[:, : 2 * size]
        g = np.exp(g, out=None if tape is None else tape.gates[t])
        g += 1
        np.reciprocal(g, out=g)
        c = np.multiply(g[:, :size], hu[:, 2 * size :], out=None if tape is None else tape.candidate[t])
        c += x[t, :, :size]
        np.tanh(c, out=c)
        if tape is not None:
            tape.before[t], tape.inner[t] = h, hu[:, 2 * size :]
        h = np.subtract(h, c, out=states[t])
        h *= g[:, size:]
        h += c
    return states, h.copy()


def _back(w, tape: Tape, keep: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Gradients (T, A, 4H) of candidate, reset gate, update gate and the candidate's recurrent
    part, from those of the states, which are overwritten."""
    size = outer.shape[2]
    reset, update = tape.gates[:, :, :size], tape.gates[:, :, size:]
    to_candidate = (1 - update) * (1 - tape.candidate * tape.candidate)
    to_reset = tape.inner * reset * (1 - reset)
    to_update = (tape.before - tape.candidate) * update * (1 - update)
    found = np.empty((*outer.shape[:2], 4 * size), np.float32)
    begins = (keep == 0).any(axis=1).tolist()
    turned = np.ascontiguousarray(w["u"].T)
    hidden = np.zeros(outer.shape[1:], np.float32)
    for t in range(len(outer) - 1, -1, -1):
        d, q = outer[t], found[t]
        d += hidden
        dc = np.multiply(d, to_candidate[t], out=q[:, :size])
        np.multiply(dc, to_reset[t], out=q[:, size : 2 * size])
        np.multiply(d, to_update[t], out=q[:, 2 * size : 3 * size])
        np.multiply(dc, reset[t], out=q[:, 3 * size :])
        hidden = q[:, size:] @ turned
        d *= update[t]
        hidden += d
        if begins[t]:
            hidden *= keep[t][:, None]
    return found


def _steep(w) -> bool:
    """Whether exponentials of logits could leave the range of a float; states are within -1 and 1."""
    ones = np.ones(w["wo"].shape[1], np.float32)
    return max((np.abs(w["wo"]) @ ones).max(), (ones @ np.abs(w["wc"])).max()) > 80


def _output(w, vocabulary: Vocabulary, states: np.ndarray, targets: np.ndarray, steep: bool, grads: dict | None):
    """Natural log probabilities of the targets (0 where there is none, -1), from states (N, H);
    with ``grads``, also the gradient of the states."""
    size = states.shape[1]
    real = np.flatnonzero(targets >= 0)
    order = real[np.argsort(vocabulary.class_of[targets[real]], kind="stable")]
    targets = targets[order]
    kinds = vocabulary.class_of[targets]
    inputs = np.empty((len(order), size + 1), np.float32)  # by class, with a one for the bias
    inputs[:, :size], inputs[:, size] = states[order], 1
    rows = np.arange(len(order))
    ones = np.ones(max(w["wc"].shape[1], int(np.diff(vocabulary.first).max())), np.float32)

    logits = inputs @ w["wc"]
    if steep:
        logits -= logits.max(axis=1, keepdims=True)
    logs = logits[rows, kinds].astype(np.float64)
    np.exp(logits, out=logits)
    sums = logits @ ones[: logits.shape[1]]
    logs -= np.log(sums)
    if grads is not None:
        logits /= sums[:, None]
        logits[rows, kinds] -= 1
        grads["wc"] = inputs.T @ logits
        grads["wo"] = np.zeros_like(w["wo"])
        back = logits @ w["wc"][:size].T
    chosen, sums = np.zeros(len(order), np.float32), np.ones(len(order), np.float32)
    edges = np.searchsorted(kinds, np.arange(len(vocabulary.first)))
    at = targets - vocabulary.first[kinds]
    for c in np.flatnonzero((np.diff(edges) > 0) & (np.diff(vocabulary.first) > 1)).tolist():
        part = slice(edges[c], edges[c + 1])
        units = slice(vocabulary.first[c], vocabulary.first[c + 1])
        s, here, n = inputs[part], at[part], rows[: edges[c + 1] - edges[c]]
        logits = s @ w["wo"][units].T
        if steep:
            logits -= logits.max(axis=1, keepdims=True)
        chosen[part] = logits[n, here]
        np.exp(logits, out=logits)
        np.matmul(logits, ones[: logits.shape[1]], out=sums[part])
        if grads is not None:
            logits /= sums[part, None]
            logits[n, here] -= 1
            np.matmul(logits.T, s, out=grads["wo"][units])
            back[part] += logits @ w["wo"][units, :size]
    logs += chosen
    logs -= np.log(sums)
    found = np.zeros(len(states))
    found[order] = logs
    if grads is None:
        return found, None
    outer = np.zeros_like(states)
    outer[order] = back
    return found, outer


def lanes_of(texts: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Numbers of the texts dealt to lanes of about equal length, the longest lane first."""
    heap = [(0, i) for i in range(min(lanes, max(1, len(texts))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for k in sorted(range(len(texts)), key=lambda k: (-len(texts[k]), k)):
        load, lane = heapq.heappop(heap)
        dealt[lane].append(k)
        heapq.heappush(heap, (load + len(texts[k]), lane))
    return sorted(dealt, key=lambda ks: -sum(len(texts[k]) for k in ks))


def windows(texts: list[np.ndarray], end: int, lanes: int, window: int = WINDOW):
    """Yield (inputs, targets, keep, texts' numbers), each (T, lanes still running); targets past
    the end of a lane are -1. The first input of a text is the end unit, with the state cleared."""
    dealt = lanes_of(texts, lanes)
    streams = []
    for ks in dealt:
        targets = np.concatenate([texts[k] for k in ks]) if ks else np.empty(0, np.int32)
        lengths = [len(texts[k]) for k in ks]
        starts = np.cumsum([0, *lengths[:-1]]) if ks else np.empty(0, int)
        inputs = np.concatenate([[end], targets[:-1]]).astype(np.int32) if len(targets) else targets
        keep = np.ones(len(targets), np.float32)
        inputs[starts], keep[starts] = end, 0
        streams.append((inputs, targets, keep, np.repeat(np.array(ks, np.int32), lengths)))
    at = 0
    while True:
        active = [s for s in streams if len(s[1]) > at]
        if not active:
            return
        longest = min(window, max(len(s[1]) for s in active) - at)
        shape = (longest, len(active))
        inputs, targets = np.full(shape, end, np.int32), np.full(shape, -1, np.int32)
        keep, number = np.ones(shape, np.float32), np.zeros(shape, np.int32)
        for j, s in enumerate(active):
            n = min(longest, len(s[1]) - at)
            for into, part in zip((inputs, targets, keep, number), s):
                into[:n, j] = part[at : at + n]
        yield inputs, targets, keep, number
        at += longest


def score_texts(w, vocabulary: Vocabulary, texts: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """log10 probability of the units of every text."""
    size = w["u"].shape[0]
    total = np.zeros(len(texts))
    h = np.zeros((0, size), np.float32)
    gates = w["x"] + w["b"]
    steep = _steep(w)
    for k, (inputs, targets, keep, number) in enumerate(windows(texts, vocabulary.end, lanes, SCORE_WINDOW)):
        h = np.zeros((inputs.shape[1], size), np.float32) if k == 0 else h[: inputs.shape[1]]
        states, h = _recur(w, gates[inputs], keep, h, None)
        found, _ = _output(w, vocabulary, states.reshape(-1, size), targets.reshape(-1), steep, None)
        total += np.bincount(number.reshape(-1), found, minlength=len(texts))
    return total / math.log(10)


def train_texts(w, vocabulary: Vocabulary, texts: list[np.ndarray], rate: float = RATE, lanes: int = TRAIN_LANES, sums=None) -> int:
    """Truncated backpropagation over the texts, changing ``w``; returns the number of tokens.

    Adagrad steps: ``sums`` holds the squared gradients seen so far.
    """
    size = w["u"].shape[0]
    sums = {k: np.full_like(v, FIRST_SQUARE) for k, v in w.items()} if sums is None else sums
    seen = 0
    h = np.zeros((0, size), np.float32)
    for k, (inputs, targets, keep, _) in enumerate(windows(texts, vocabulary.end, lanes)):
        h = np.zeros((inputs.shape[1], size), np.float32) if k == 0 else h[: inputs.shape[1]]
        tape = Tape(*inputs.shape, size)
        x = w["x"][inputs]
        x += w["b"]
        states, h = _recur(w, x, keep, h, tape)
        count = int((targets >= 0).sum())
        seen += count
        grads: dict[str, np.ndarray] = {}
        _, outer = _output(w, vocabulary, states.reshape(-1, size), targets.reshape(-1), _steep(w), grads)
        flat = _back(w, tape, keep, outer.reshape(states.shape)).reshape(-1, 4 * size)
        grads["u"] = tape.before.reshape(-1, size).T @ flat[:, size:]
        order = np.argsort(inputs.reshape(-1).astype(vocabulary.narrow), kind="stable")
        units = inputs.reshape(-1)[order]
        edges = np.flatnonzero(np.diff(units, prepend=-1))
        rows = units[edges]  # those that occur
        grads["x"] = np.add.reduceat(flat[order, : 3 * size], edges, axis=0)
        grads["b"] = grads["x"].sum(axis=0)
        scale = 1 / max(1, count)
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) * scale
        scale *= min(1.0, CLIP / max(norm, 1e-12))
        for name, g in grads.items():
            g *= scale
            squares = g * g
            if name == "x":
                squares += sums[name][rows]
                sums[name][rows] = squares
            else:
                sums[name] += squares
                np.copyto(squares, sums[name])
            np.sqrt(squares, out=squares)
            g /= squares
            g *= rate
            if name == "x":
                w[name][rows] -= g
            else:
                w[name] -= g
    return seen


# ---------------------------------------------------------------- Spark
def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that no more than ``most`` words reach. Counts are grouped by powers of
    two first and one by one inside the power where the limit falls, so little is collected."""
    power = F.floor(F.log2("n")).cast("int")
    by_power = sorted(counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("w")).collect(), reverse=True)
    held, least = 0, None
    for p, w in by_power:
        if held + w > most:
            inside = counts.where(power == p).groupBy("n").agg(F.count(F.lit(1)).alias("w"))
            for n, w in sorted(inside.collect(), reverse=True):
                if held + w > most:
                    return n + 1
                held += w
        held, least = held + w, 1 << p
    return least or 1


def learn_vocabulary(training: DataFrame, text: str, units: int = UNITS, known: int = KNOWN) -> tuple[DataFrame, Vocabulary]:
    """(stored counts of all training words, vocabulary)."""
    counts = cut_lineage(count_words(training.select(F.col(f"`{text}`"))))
    ends = training.count()
    whole = counts.agg(F.sum("n").alias("n"), F.count("word").alias("v")).first()
    least, outside = _least_count(counts, known), F.lit(True)
    found = counts.where(F.col("n") >= least).collect()  # ``known`` rows at most
    top = sorted(((r["word"].encode(), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))
    if top[:units]:
        word, n = top[:units][-1]
        outside = (F.col("n") < n) | ((F.col("n") == n) & (F.encode("word", "UTF-8") > F.lit(word)))
    rest = counts.where(outside)
    grouped = rest.groupBy(_rare_group_column(F.col("word")).alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    rare = {r["g"]: (r["n"], r["v"]) for r in grouped}
    tokens, types = (whole["n"] or 0) + ends, whole["v"] + (1 if ends else 0)
    return counts, Vocabulary(top, ends, rare, tokens, types, units)


def encode_documents(rows: DataFrame, vocabulary: Vocabulary, kind: str) -> DataFrame:
    """Stored table, one row per row of (doc_id, held_out, text): counts, base score without the
    unknown words, what the words' shares of their groups add to a score, the units as bytes, and
    the unknown words. Texts are split and looked up here once, for learning and scoring alike."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    key_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = sent.value
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        divisor = math.log10(v.tokens + 0.5 * (v.types + 1))
        end_log = math.log10(v.ends + 0.5)
        unit_logs = np.zeros(len(v.counts))
        unit_logs[v.groups] = [v.rare_log(g) for g in range(RARE)]
        kinds = [pa.int64(), key_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string())]
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "units", "unknown"]
        out, held = [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = batch.slice(at, 64)
                for doc_id, held_out, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), cut.column(2).cast(pa.binary())):
                    words = words_in(text.as_py())
                    ranks = v.ranks(words)
                    units = v.unit_ids(words, ranks)
                    known = ranks[ranks >= 0]
                    logs = v.log_of[known]
                    base = float(logs.sum()) + end_log - divisor * len(units)
                    # a word without a unit has its share of its group
                    inside = float(logs[v.shared[known]].sum() - unit_logs[units].sum())
                    unknown = [words[j] for j in np.flatnonzero(ranks < 0).tolist()]
                    n_known = len(known) + (1 if v.ends else 0)
                    out.append((row, doc_id, held_out, len(units), n_known, base, inside, units.astype(v.narrow).tobytes(), unknown))
                    row += 1
                    held += len(units)
                    if held >= LANE_TOKENS:
                        yield flushed()
                        out, held = [], 0
        if out:
            yield flushed()

    schema = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, units binary, unknown array<string>"
    return cut_lineage(rows.select("doc_id", "held_out", "text").mapInArrow(run, schema))


def _in_blocks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """(rows, units) of as many texts at a time as ``LANE_TOKENS`` allows; the units are the last column."""
    rows, units, held = [], [], 0
    for batch in batches:
        begun = 0
        for i, found in enumerate(batch.columns[-1]):
            units.append(np.frombuffer(found.as_buffer(), vocabulary.narrow))
            held += len(units[-1])
            if held >= LANE_TOKENS:
                rows.append(batch.slice(begun, i + 1 - begun))
                yield pa.Table.from_batches(rows), units
                rows, units, held, begun = [], [], 0, i + 1
        if begun < batch.num_rows:
            rows.append(batch.slice(begun))
    if units:
        yield pa.Table.from_batches(rows), units


def _averaged(parts: DataFrame) -> tuple[dict[str, np.ndarray] | None, int]:
    """Mean of (weights, tokens) rows, by tokens, through a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                w = from_bytes(row["weights"])
                share = row["tokens"]
                if total is None:
                    total = {k: v.astype(np.float64) * share for k, v in w.items()}
                else:
                    for k, v in w.items():
                        total[k] += v.astype(np.float64) * share
                tokens += share
        if tokens:
            mean = {k: (v / tokens).astype(np.float32) for k, v in total.items()}
            yield pa.RecordBatch.from_arrays([pa.array([to_bytes(mean)], pa.binary()), pa.array([tokens], pa.int64())], names=["weights", "tokens"])

    level = cut_lineage(parts)
    rows = level.count()
    while rows > FAN_IN:
        level = cut_lineage(level.repartition(-(-rows // FAN_IN)).mapInArrow(add, "weights binary, tokens bigint"))
        rows = level.count()
    total, tokens = None, 0
    for r in level.collect():  # FAN_IN rows at most
        w = from_bytes(bytes(r["weights"]))
        if total is None:
            total = {k: np.zeros(v.shape) for k, v in w.items()}
        for k, v in w.items():
            total[k] += v * float(r["tokens"])
        tokens += r["tokens"]
    return (None, 0) if not tokens else ({k: (v / tokens).astype(np.float32) for k, v in total.items()}, tokens)


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = RATE):
    """(weights, tokens learned from) after all rounds over ``encoded`` (doc_id, units)."""
    spark = encoded.sparkSession
    weights, learned = start_weights(vocabulary), 0
    sent = spark.sparkContext.broadcast(vocabulary)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(rounds))
    tasks = max(1, -(-vocabulary.tokens // (rounds * TASK_TOKENS)))
    for k in range(rounds):
        begun = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], begun=begun) -> Iterator[pa.RecordBatch]:
            w, sums, tokens = None, None, 0
            for _, units in _in_blocks(batches, sent.value):
                if w is None:
                    w = {name: v.copy() for name, v in begun.value.items()}
                    sums = {name: np.full_like(v, FIRST_SQUARE) for name, v in w.items()}
                tokens += train_texts(w, sent.value, units, rate, TRAIN_LANES, sums)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([to_bytes(w)], pa.binary()), pa.array([tokens], pa.int64())], names=["weights", "tokens"])

        mean, tokens = _averaged(encoded.where(part == k).select("units").coalesce(tasks).mapInArrow(run, "weights binary, tokens bigint"))
        if tokens:
            weights, learned = mean, learned + tokens
        begun.unpersist()
    return weights, learned


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """Scores of all rows by a model that never saw those whose key falls into ``fold``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), (held_fold(F.col(f"`{key}`"), folds) == fold).alias("held_out"))
    counts, vocabulary = learn_vocabulary(rows.where("NOT held_out"), "text")
    kind = docs.schema[key].dataType.simpleString()
    encoded = encode_documents(rows, vocabulary, kind)
    weights, learned = train(encoded.where("NOT held_out").select("doc_id", "units"), vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = sent.value
        for block, units in _in_blocks(batches, vocabulary):
            scores = pa.array(score_texts(weights, vocabulary, units))
            yield from block.drop_columns(["units"]).append_column("score", scores).combine_chunks().to_batches()

    carried = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside"]
    schema = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, score double"
    scored = cut_lineage(encoded.select(*carried, "units").mapInArrow(run, schema))
    joined = (
        encoded.select("row", F.explode("unknown").alias("w"))
        .join(counts, F.col("w") == F.col("word"), "left")
        .select("row", F.coalesce("n", F.lit(0)).alias("n"))
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 0.5)).alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("more_known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(joined, "row", "left").select(
        F.col("doc_id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + F.col("inside") + more).alias("score"),
        F.lit(learned).cast("long").alias("network_tokens"),
    )
