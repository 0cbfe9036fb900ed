"""Near copies against all pairs of exact shingle sets in plain Python."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import tallyweave.llm.near_copies as m
from tests.llm.conftest import SF_DIR
from tests.llm.test_native import WORD


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """The smallest key of every component of (key, text) with similarity >= 0.8."""
    sets = {k: brute_set(t) for k, t in rows}
    todo, kept = set(sets), set()
    while todo:
        stack = group = [min(todo)]
        todo.discard(stack[0])
        while stack:
            a = sets[stack[0]]
            near = [k for k in todo if a == sets[k] or 5 * len(a & sets[k]) >= 4 * len(a | sets[k]) > 0]
            todo -= set(near)
            stack = stack[1:] + near
            group = group + near
        kept.add(min(group))
    return kept


def edited(words, times, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), times):
        words[at] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


def test_stage_drops_edited_copies_and_keeps_others(spark):
    """Copies with 6 of 300 words exchanged have a similarity of about 0.82 and differ in about 9 bits."""
    rng = random.Random(11)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, edited(base, 6, rng)), (10 * g + 2, edited(base, 15, rng))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_kept(rows)
    assert 110 < len(want) < 130
    got = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
    assert {r["text"] for r in got.collect()} == {t for k, t in rows if k in want}


def test_documents_and_odd_rows(spark, docs):
    odd = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE\ttwo"), (9005, "b c d e " * 9000), (9006, "a b c d e"), (9007, "a b c d f")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("_row", F.lit("x"))
    want = brute_kept([(r["doc_id"], r["text"]) for r in both.collect()])
    got = m.one_of_near_copies(both).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want) and {177, 9001, 9002, 9004}.isdisjoint(want) and {1, 9006, 9007} <= want
    assert m.one_of_near_copies(both.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "x"), (None, "x"), (5, "y"), (5, "y"), (5, "z")], "doc_id long, text string")
    assert sorted(r["text"] for r in m.one_of_near_copies(twice).collect()) == ["x", "y", "z"]


def test_pairs_beside_the_smallest_member_of_a_key_are_tested(spark, monkeypatch):
    """All sets in one key: what is linked may not depend on which member is the smallest."""
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"v{g}x{i}" for i in range(200)]
        rows += [(10 * g + i, edited(base, 2 * (i > 0), rng)) for i in range(4)]
    ids = {k: i for i, (k, _) in enumerate(rows)}
    nodes = spark.createDataFrame([(ids[k], len(brute_set(t)), [7]) for k, t in rows], "id long, n int, keys array<long>")
    texts = spark.createDataFrame([(ids[k], t) for k, t in rows], "id long, text string")
    found = {r["node"]: r["component"] for r in m.components_of(nodes, texts).collect()}
    assert {ids[k] for k in brute_kept(rows)} == {found.get(i, i) for i in ids.values()}


def test_a_shared_passage_makes_no_square(spark, monkeypatch):
    """Half of every text is one passage: all meet under one key, few are alike."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for g in range(150):
        own = [f"o{g}x{i}" for i in range(120)]
        rows += [(10 * g, " ".join(passage + own)), (10 * g + 1, edited(passage + own, 3, rng))]
    rows += [(5000 + i, " ".join(passage + [f"t{i}"])) for i in range(30)]  # alike by the passage alone
    ids = {k: i for i, (k, _) in enumerate(rows)}
    nodes = spark.createDataFrame([(ids[k], len(brute_set(t)), [7]) for k, t in rows], "id long, n int, keys array<long>")
    texts = spark.createDataFrame([(ids[k], t) for k, t in rows], "id long, text string")
    tested = []
    plain = m._verified
    monkeypatch.setattr(m, "_verified", lambda pairs, *rest: (tested.append(pairs.count()), plain(pairs, *rest))[1])
    found = {r["node"]: r["component"] for r in m.components_of(nodes, texts).collect()}
    assert {ids[k] for k in brute_kept(rows)} == {found.get(i, i) for i in ids.values()}
    assert sum(tested) < 10 * len(rows)


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """No set has a min-hash key: what differs in few bits is found by the fingerprints, and tested."""
    rng = random.Random(21)
    rows = []
    for g in range(40):
        base = [f"f{g}x{i}" for i in range(400)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, edited(base, 1, rng))]
    rows += [(5000, ""), (5001, "alone")]
    sets = {k: m.shingle_set(t) for k, t in rows}
    fps = {k: m.majority(s) for k, s in sets.items()}
    near = [g for g in range(40) if (fps[10 * g] ^ fps[10 * g + 1]).bit_count() <= 4]
    assert len(near) > 30 and fps[5000] == 0
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(k, len(s), [], signed(fps[k])) for k, s in sets.items()], "id long, n int, keys array<long>, fp long")
    texts = spark.createDataFrame(rows, "id long, text string")
    found = {r["node"]: r["component"] for r in m.components_of(m.with_fingerprint_key(nodes), texts).collect()}
    assert found == {10 * g + i: 10 * g for g in near for i in (0, 1)}

    searched = []
    plain = m.fingerprint_links
    monkeypatch.setattr(m, "fingerprint_links", lambda fps: (searched.append(fps.count()), plain(fps))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000  # whole texts in a worker
    assert got == brute_kept(rows) and searched == [len({f for k, f in fps.items() if k != 5000})]


@pytest.mark.parametrize("s, least", [(0.8, 0.99), (0.9, 0.999)])
def test_keys_find_similar_sets(s, least):
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(2000):
        common, own = int(round(900 * s)), 900 - int(round(900 * s))
        x = rng.integers(0, 1 << 63, common + own, dtype=np.uint64)
        a, b = x[: common + own // 2], np.concatenate([x[:common], x[common + own // 2 :]])
        hit += bool(set(m.band_keys(a)) & set(m.band_keys(b)))
    assert hit >= least * 2000
