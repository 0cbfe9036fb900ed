"""The recurrent language model: counts, gradients, probabilities and held-out likelihood."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tallyweave.llm.recurrent_lm as m
from tallyweave.llm import entries
from tests.llm.conftest import SF_DIR


def small_vocabulary(units=12, extra=20):
    known = [(f"w{i:02d}".encode(), 200 - 5 * i) for i in range(units + extra)]
    rare = {}
    for w, n in [*known[units:], (b"zz", 1), (b"qq", 1)]:
        a, b = rare.get(m.rare_group(w), (0, 0))
        rare[m.rare_group(w)] = (a + n, b + 1)
    return m.Vocabulary(known, 30, rare, 30 + sum(n for _, n in known) + 2, 3 + len(known), units), known


def test_probabilities_sum_to_one():
    """Over all units after any history; and over all words and one unseen one in a group."""
    v, known = small_vocabulary()
    w = m.start_weights(v, 5, seed=1)
    prefix = [3, 1, 4]
    total = sum(math.exp(x * math.log(10)) for x in m.score_texts(w, v, [np.array([*prefix, u], np.int32) for u in range(len(v.counts))]))
    before = math.exp(m.score_texts(w, v, [np.array(prefix, np.int32)])[0] * math.log(10))
    assert abs(total / before - 1) < 1e-4
    for g, (n, types) in enumerate(v.rare):
        inside = [c for word, c in [*known[12:], (b"zz", 1), (b"qq", 1)] if m.rare_group(word) == g]
        assert abs(sum((c + 0.5) / 10 ** v.rare_log(g) for c in [*inside, 0]) - 1) < 1e-9
        assert len(inside) == types and sum(inside) == n


def test_lanes_and_windows_do_not_change_scores(monkeypatch):
    v, _ = small_vocabulary()
    w = m.start_weights(v, 5, seed=2)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, len(v.counts), n).astype(np.int32) for n in (1, 200, 3, 33, 32, 31, 64, 1, 90)]
    alone = [m.score_texts(w, v, [t])[0] for t in texts]
    monkeypatch.setattr(m, "SCORE_WINDOW", 16)
    for lanes in (1, 2, 50):
        assert np.allclose(m.score_texts(w, v, texts, lanes), alone, atol=1e-4)
    assert m.score_texts(w, v, []).shape == (0,)


def test_large_weights_are_shifted_before_exponentials():
    v, _ = small_vocabulary()
    w = m.start_weights(v, 5, seed=6)
    texts = [np.arange(len(v.counts), dtype=np.int32)]
    assert not m._steep(w)
    states, targets = np.tanh(np.random.default_rng(0).standard_normal((40, 5))).astype(np.float32), np.arange(40) % len(v.counts)
    plain, back = m._output(w, v, states, targets, False, {})
    shifted, other = m._output(w, v, states, targets, True, {})
    assert np.allclose(plain, shifted, atol=1e-5) and np.allclose(back, other, atol=1e-5)
    w["wo"][:, -1] += 300
    assert m._steep(w) and np.isfinite(m.score_texts(w, v, texts)).all()


def test_gradient_against_differences(monkeypatch):
    v, _ = small_vocabulary()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, len(v.counts), n).astype(np.int32) for n in (7, 5, 9, 1)]
    count = sum(map(len, texts))
    w = {k: x.astype(np.float64) * 3 for k, x in m.start_weights(v, 4, seed=4).items()}
    monkeypatch.setattr(m.np, "float32", np.float64)
    monkeypatch.setattr(m, "CLIP", 1e9)
    monkeypatch.setattr(m, "FIRST_SQUARE", 1e12)  # a step is then rate * gradient / 1e6
    after = {k: x.copy() for k, x in w.items()}
    assert m.train_texts(after, v, texts, rate=1e6, lanes=2) == count
    loss = lambda q: -float(m.score_texts(q, v, texts, 2).sum()) * math.log(10) / count
    for name in w:
        flat = np.ndindex(w[name].shape)
        picked = [i for i in flat]
        for i in [picked[j] for j in rng.choice(len(picked), min(12, len(picked)), replace=False)]:
            up, down = ({k: x.copy() for k, x in w.items()} for _ in "ab")
            up[name][i] += 1e-5
            down[name][i] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert abs(w[name][i] - after[name][i] - slope) < 1e-6 + 1e-4 * abs(slope), (name, i)


def test_documents_counts_and_likelihood(spark):
    sf = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    split = lambda t: m.words_in(t) + [None]
    held = {k for k in docs if zlib.crc32(str(k).encode()) % 5 == 1}
    counts = Counter(w for k, t in docs.items() if k not in held for w in split(t))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in entries.QUERIES["op2_recurrent_lm"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        tokens = split(docs[k])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in held, len(tokens), sum(w in counts for w in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 * len(tokens) and r["score"] < 0
        assert r["network_tokens"] == n  # every training token is learned from
    gain = sum(got[k]["score"] - got[k]["base_score"] for k in held) / sum(got[k]["n_tokens"] for k in held)
    assert gain > 0.3  # log10 a token


ODD = [(1, None), (2, ""), (3, " \n"), (4, "ONE one Öne"), (4, "ONE one Öne"), (5, "w " * 100000), (None, "null key"), (6, "x\x1cy")]


@pytest.mark.parametrize("known", [3, 1000])
def test_odd_rows(spark, monkeypatch, known):
    frame = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("score", F.lit("s"))
    learn = m.learn_vocabulary
    monkeypatch.setattr(m, "learn_vocabulary", lambda t, c: learn(t, c, units=2, known=known))
    got = m.score_documents(frame).collect()
    held = {k for k, _ in ODD if k is not None and zlib.crc32(str(k).encode()) % 5 == 1}
    tokens = [(k, m.words_in(t) + [None]) for k, t in ODD]
    counts = Counter(w for k, ws in tokens if k not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter(
        (k, k in held, len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 3)) for k, ws in tokens
    )
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(math.isfinite(r["score"]) for r in got)


def test_without_training_and_empty(spark):
    only = [k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    frame = spark.createDataFrame([(k, "a b") for k in only], "doc_id long, text string")
    got = m.score_documents(frame).collect()
    assert [(r["n_known"], r["train_tokens"], round(abs(r["base_score"]), 9)) for r in got] == [(0, 0, 0.0)] * 2
    assert m.score_documents(frame.limit(0)).count() == 0
