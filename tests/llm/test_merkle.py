"""Merkle proofs against trees built one list at a time."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import tallyweave.llm.merkle_manifest as m
from tallyweave.llm.entries import LEAF_FIELDS

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    d, s, lang, n, t = r
    return h(field(d), field(s), field(lang), field(n if n is None else n + more), field(t))


def climb(nodes):
    """The root of a list of digests and, for each, its siblings as (is left, digest) or None."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            paths[i].append((other < p, nodes[other]) if other < len(nodes) else None)
            at[i] = p // 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in order:
        some = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, int(leaf_of(r)[:13], 16)))
        built[lang] = some, climb([leaf_of(r) for r in some])
    root, tops = climb([built[lang][1][0] for lang in order])
    out = []
    for lang, top in zip(order, tops):
        some, (sub, paths) = built[lang]
        for r, path in zip(some, paths):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf_of(r, int(tampered))
            for step in path:
                now = h(now) if step is None else h(step[1], now) if step[0] else h(now, step[1])
            out.append((r[0], leaf_of(r), sub, root, h(*[s[1] for s in path if s]), now, now == root))
    return out


def ours(docs):
    proved = m.prove(docs, "doc_id", "lang", LEAF_FIELDS, {"changed": m.tampered_leaf("doc_id", LEAF_FIELDS, "n_chars", 7)})
    checked = m.verify_rows(proved, F.coalesce("changed", "leaf"))
    return [tuple(r) for r in checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


def test_documents(spark, docs):
    rows = [tuple(r) for r in docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()]
    assert same(ours(docs), brute(rows))


def test_nulls_repeats_and_far_keys(spark):
    rng = random.Random(4)
    keys = [None, None, 0, -1, -64, 63, 64, 2**63 - 1, -(2**63), 2**40, 2**40 + 1, 7, 7, 7, 7]
    rows = [(k, rng.choice(["s", None]), rng.choice(["en", "", None, "é", "zz"]), rng.choice([1, None, 2**63 - 1]), rng.choice(["", None, "x" * 200_000, "é\n"])) for k in keys * 4]
    rows += [(7, "s", "en", 1, "equal")] * 5 + [(None, None, None, None, None)] * 3
    rows = [r if r[3] != 2**63 - 1 else (*r[:3], 5, r[4]) for r in rows]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("place", F.lit(1)).withColumn("leaf", F.lit("x"))
    assert same(ours(table), brute(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1024, 1025, 3000])
def test_sizes_around_a_block(spark, n):
    rows = [(i * 37, "s", "en", i, f"t{i}") for i in range(n)]
    got = ours(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert same(got, brute(rows) if n else [])


def test_more_trees_than_slots(spark):
    rows = [(i, "s", f"l{i % 1300}", i, "t") for i in range(1500)]
    assert same(ours(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def test_a_hot_key_is_ranked_in_buckets(spark):
    rows = [(5, "s", "en", i % 50, "t") for i in range(900)] + [(i, "s", "en", i, "u") for i in range(300)]
    assert same(ours(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def test_ranks_count_smaller_keys(spark):
    rng = random.Random(9)
    keys = sorted({rng.getrandbits(62) * rng.choice([1, -1]) >> rng.choice([0, 20, 44, 56]) for _ in range(4000)})
    leaves = spark.createDataFrame([(rng.choice(["=a", "=b"]), k, i, h(str(k))) for i, k in enumerate(keys)], "tree string, key long, row long, leaf string")
    got = {(r["tree"], r["key"]): r["place"] for r in m.leaf_places(leaves).collect()}
    seen = {}
    for tree, k in sorted(got):
        assert got[tree, k] == seen.get(tree, 0)
        seen[tree] = seen.get(tree, 0) + 1
    assert len(got) == len(keys)
