"""Re-Pair shards: round trips, random access and ids by the library's own call."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tallyweave.llm.repair_shards as m
from tallyweave.llm.chunk_ids import ChunkIds
from tallyweave.llm.entries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def truth(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def expected(rows):
    """Rows by key, nulls first; equal keys may come in any order."""
    out, start = [], 0
    for (key, text), ids in zip(rows, truth([t for _, t in rows])):
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def written(docs, path, **options):
    m.write_shards(docs, path, PATH, **options)
    return docs.sparkSession.read.parquet(path)


def test_documents(spark, docs, tmp_path):
    shards = written(docs, str(tmp_path / "s"), shard_ids=20_000, least=8)
    got = [tuple(r) for r in m.read_shards(shards, "bigint").orderBy("start").collect()]
    assert got == expected(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    assert shards.count() > 3 and shards.agg(F.sum("n_ids")).first()[0] == sum(r[2] for r in got)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "b"), (3, None), (-5, ""), (1, " \n\n"), (2, "!"), (4, "<|endoftext|> x"), (9, "word " * 60_000), (7, "a\x1c b　c"), (8, "été\n\nÉté.\r\n 12")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("start", F.lit("s"))
    shards = written(table.repartition(3), str(tmp_path / "a"), shard_ids=1000, least=4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = m.read_shards(shards, "bigint", with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == expected(ordered)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == truth([t for _, t in ordered])
    equal = spark.createDataFrame([(5, "x y")] * 40 + [(5, None)] * 3 + [(None, "z")] * 4, "doc_id long, text string")
    again = m.read_shards(written(equal.repartition(4), str(tmp_path / "b"), shard_ids=10), "bigint").orderBy("start").collect()
    assert [r["doc_id"] for r in again] == [None] * 4 + [5] * 43
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(again, again[1:])) and again[0]["start"] == 0
    named = table.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body")).where("name is not null")
    texts = m.read_shards(written(named, str(tmp_path / "c"), key="name", text="body"), "string", "name").orderBy("start").collect()
    assert [r["name"] for r in texts] == sorted(str(k) for k, _ in rows if k is not None)
    none = written(table.limit(0), str(tmp_path / "d"))
    assert none.count() == 0 and m.read_shards(none, "bigint").count() == 0


@pytest.mark.parametrize("least", [2, 5, 50])
@pytest.mark.parametrize("letters", [1, 2, 7, 200])
def test_grammar_gives_back_the_ids(least, letters):
    rng = random.Random(letters * least)
    documents = [np.array([rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 400]))] + [0], "<u4") for _ in range(40)]
    data = m.write_shard(pa.array(range(40)), [d.tobytes() for d in documents], least)
    shard = m.Shard(data)
    assert shard.all_ids().tolist() == np.concatenate(documents).tolist() and shard.keys.to_pylist() == list(range(40))
    for d in range(0, 40, 3):
        want = documents[d].tolist()
        assert shard.read_ids(d).tolist() == want
        for a in range(0, len(want) + 2, 11):
            assert shard.read_ids(d, a, 9).tolist() == want[a : a + 9]
    # a rule stands for as many ids as its two symbols together, and pairs were really replaced
    assert (shard.lengths[len(shard.terminals) :] == shard.lengths[shard.rules].sum(axis=1)).all()
    if letters < 200 and least < 50:
        assert len(shard.symbols) < shard.n_ids


def test_most_frequent_pair_becomes_the_first_rule():
    seq = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 0], np.uint32)
    symbols, rules, rounds = m.grammar(seq, 5, 2)
    assert rules.tolist()[0] == [1, 2] and m.expand(symbols, rules, 5, rounds).tolist() == seq.tolist()
    run, rules, rounds = m.grammar(np.array([1] * 9 + [0], np.uint32), 2, 2)
    assert rules.tolist()[0] == [1, 1] and m.expand(run, rules, 2, rounds).tolist() == [1] * 9 + [0]


def test_wide_symbols():
    documents = [np.r_[np.arange(1, 70_000), 0].astype("<u4"), np.r_[np.arange(1, 70_000), 0].astype("<u4")]
    shard = m.Shard(m.write_shard(pa.array(["a", None]), [d.tobytes() for d in documents], 2))
    assert shard.symbols.dtype.itemsize == 4 and shard.read_ids(1).tolist() == documents[1].tolist() and shard.keys.to_pylist() == ["a", None]


def test_chunks_have_the_ids_of_whole_texts(docs):
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab1.' \n\té　\x1c\x85,") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts = odd + [r["text"] for r in docs.collect()] + ["<|endoftext|>", "a <|endoftext|>b"]
    c = ChunkIds(PATH)
    assert c.by_chunks and c.direct
    assert [np.frombuffer(c.of(t), "<u4").tolist() + [0] for t in texts] == truth(texts)
    other = ChunkIds(tokenizer_path())  # drops white space: whole texts
    t = other.tokenizer
    assert all(np.frombuffer(other.of(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids for x in odd[:300])


def test_files(spark, docs, tmp_path):
    shards = written(docs, str(tmp_path / "s"), shard_ids=50_000)
    n = m.export_shards(shards, str(tmp_path / "files"))
    files = sorted(os.listdir(tmp_path / "files"))
    assert len(files) == n == shards.count()
    with open(tmp_path / "files" / files[0], "rb") as f:
        assert m.Shard(f.read()).keys.to_pylist()[0] == 0
