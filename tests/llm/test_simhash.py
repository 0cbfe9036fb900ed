"""SimHash near-duplicates against all pairs in plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import tallyweave.llm.simhash_segments as m
from tests.llm.test_native import WORD


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}
    todo = set(fps)
    while todo:
        start = todo.pop()
        stack, seen = [start], [start]
        while stack:
            a = stack.pop()
            near = [b for b in todo if (a ^ b).bit_count() <= 4]
            todo -= set(near)
            stack += near
            seen += near
        for f in seen:
            root[f] = min(seen)
    return root


ODD = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE\ttwo"), (9005, "Ünï A"), (9006, "b c d e " * 40000), (None, "null key here now"), (9007, "a b c d"), (9007, "a b c d")]


def test_documents_match_brute_force(spark, docs):
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("fp", F.lit("x")).withColumn("component", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(set(fps))
    first = {}
    for (k, _), f in zip(rows, fps):
        if k is not None:
            first[root[f]] = min(k, first.get(root[f], k))
    want = sorted((str(k), f"{f:016x}", first.get(root[f])) for (k, _), f in zip(rows, fps))
    got = m.near_duplicates(both).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    kept = m.one_of_each(both).collect()
    assert len(kept) == len(set(root.values())) and set(kept[0].asDict()) == {"doc_id", "text", "fp", "component"}
    assert {r["doc_id"] for r in kept} == set(first.values()) | ({None} if len(first) < len(kept) else set())


@pytest.mark.parametrize("run", [2, 256])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, run):
    """Dense groups of up to hundreds around common centres; short runs and midpoints alike."""
    monkeypatch.setattr(m, "RUN", run)
    scan = m._scan_runs

    def with_run(batches):  # the workers have their own copy of the module
        m.RUN = run
        yield from scan(batches)

    monkeypatch.setattr(m, "_scan_runs", with_run)
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1, 0b1111, 0b11111}
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 7)):
                f ^= 1 << b
            fps.add(f)
    root = brute_components(fps)
    frame = spark.createDataFrame([(m._signed(f),) for f in fps], "fp long")
    got = m.components_of(frame.select("fp", F.col("fp").alias("k")), "k", "fp").collect()
    group = {}
    for r in got:
        group.setdefault(r["first"], set()).add(r["fp"] % (1 << 64))
    truth = {}
    for f, r in root.items():
        truth.setdefault(r, set()).add(f)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, truth.values()))


def test_empty_table(spark, docs):
    assert m.near_duplicates(docs.limit(0)).count() == 0
    assert m.one_of_each(docs.limit(0)).count() == 0


def test_bound_is_below_the_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 2000).astype(np.uint64), rng.integers(0, 2**63, 2000).astype(np.uint64)
    b[:1000] = a[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    assert (m.manhattan(m._embedded(a), m._embedded(b)) <= np.bitwise_count(a ^ b)).all()
