"""Periodic runs against every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import tallyweave.llm.lyndon_runs as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lyndon(s):
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute_runs(w, exponent=4, least=6):
    codes = np.unique(np.array(list(w), dtype=object).astype(str), return_inverse=True)[1] if len(w) else np.zeros(0, int)
    found = {}
    for q in range(1, len(w) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, codes[:-q] == codes[q:], False].astype(int)))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(key, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *facts, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences(times, rng):
    for t in range(times):
        k, n = rng.choice([1, 2, 3, 5]), rng.randrange(1, 40)
        s = [rng.randrange(k) for _ in range(n)]
        if t % 3 == 0:
            s = (s[: rng.randrange(1, 6)] * 20)[:n] + s[: rng.randrange(5)]
            s = s * rng.choice([1, 1, 3])
        yield s


def test_lyndon_array_by_grouping():
    for s in sequences(800, random.Random(1)):
        assert m.lyndon_array(s) == brute_lyndon(s)
    assert m.lyndon_array([0] * 500) == [1] * 500
    up = list(range(500))
    assert m.lyndon_array(up) == [500 - i for i in up] and m.lyndon_array(up[::-1]) == [1] * 500


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 3), (2, 2)])
def test_runs(exponent, least):
    for s in sequences(600, random.Random(exponent)):
        assert m.runs_of(np.array(s), exponent, least) == brute_runs(s, exponent, least)
        assert m.text_runs(s, exponent, least) == brute_runs(s, exponent, least)


def test_fibonacci_words_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert m.text_runs(b, 3, 3) == brute_runs(b, 3, 3) and m.text_runs(b) == []
    rng = random.Random(2)
    root = [rng.randrange(40) for _ in range(3000)]
    assert m.text_runs(([7] + root * 5)[:14000]) == [(1, 13999, 3000)]


def test_documents(spark, docs):
    got = m.detect_runs(docs, plant=True)
    want = sorted(brute_row(r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[1] for w in want) > 10


def test_odd_rows(spark):
    rows = [
        (None, None), (None, "a a a a a a"), (1, ""), (2, " \n\x0b"), (3, "x " * 50_000), (3, "x " * 50_000), (4, "a b " * 9 + "a"),
        (5, "a b a b a b a b a b a b"), (6, "a\x1cb " * 7), (7, "é è é è é è é è"), (8, "a b c a b c a b c a b"), (27, "one"),
    ] + [(k, "p q r s t u v w x y z " * 3) for k in range(100, 200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("key", F.lit("k"))
    got = m.detect_runs(table, plant=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert m.detect_runs(table.limit(0)).count() == 0
    texts = m.detect_runs(table.withColumn("doc_id", F.col("doc_id").cast("string")), with_runs=True)
    assert [tuple(x) for x in texts.where("doc_id = '4'").first()["runs"]] == [(0, 19, 2)]
