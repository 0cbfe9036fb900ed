"""Packing: every id in exactly one piece, no gaps, little padding."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import tallyweave.llm.nnls_packing as m
from tallyweave.llm.entries import tokenizer_path


def truth(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check(rows, ids_by_key):
    """``ids_by_key``: key to the list of the ids of its rows. Returns share of padding."""
    by_key, by_sequence = {}, {}
    for r in rows:
        by_key.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
    assert set(by_key) == set(ids_by_key)
    for k, ids in ids_by_key.items():
        pieces = sorted(by_key[k], key=lambda r: r["start"])
        if len(ids) == 1:
            at, joined = 0, b""
            for p in pieces:
                assert p["start"] == at and p["doc_tokens"] == len(ids[0])
                at += p["length"]
                joined += p["ids"]
            assert joined == np.array(ids[0], dtype="<u4").tobytes()
        else:
            assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    padded = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= m.WINDOW
        total += at
        padded += 0 if at & (at - 1) == 0 else m.WINDOW - at
    return padded / max(1, padded + total)


ODD = [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "It's <|endoftext|> don't x\x1cy Å é ΣΑΣ 中文 12"), (9004, "word " * 20000), (9005, "dup"), (9005, "dup"), (None, "null key")]


@pytest.mark.parametrize("block", [20_000, 16_000_000])
def test_documents_and_odd_rows(spark, docs, monkeypatch, block):
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("ids", F.lit(1)).withColumn("offset", F.lit("o"))
    rows = both.collect()
    ids = {}
    for r, i in zip(rows, truth([r["text"] for r in rows])):
        ids.setdefault(r["doc_id"], []).append(i)
    packed = m.pack_block

    monkeypatch.setattr(m, "BLOCK_TOKENS", block)
    assert packed is m.pack_block
    got = m.pack(both.coalesce(1), tokenizer_path()).collect()
    assert check(got, ids) < 0.03


def test_words_of_every_kind():
    """Ids put together from words are those of the whole text, for this and other tokenizers."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [
        "It's <|endoftext|> don't x\x1cy Å é ΣΑΣ. 中文 12", "a\x01b \x01 \x01. c", "...", "they're, it's. he'd! 'tis 'S", "a\xa0b\u2003c\x85d é. x́, ½. ²! ́.",
        "İI. ß, ﬁ. Ŀ ŉ ĳ Ǆ ſ K Ω", "5. 5, ५. Ⅷ; _. -, a_. a-.", "ÉTÉ Été. ñÑ, ÿŸ! Ȁȁ", "", None, " \n ", "x" * 3000, "e\u0301a e\u0301.", "º ª. µ, Á",
    ]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tok, words = Tokenizer.from_file(path), m._WordIds(path)
        assert words.by_words == words.direct == (name == "word_bpe_49k.json")
        for t in texts:
            assert words.of([t])[0] == np.array(tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_empty_table(spark, docs):
    assert m.pack(docs.limit(0), tokenizer_path()).count() == 0
    assert "ids" not in m.pack(docs.limit(0), tokenizer_path(), with_ids=False).columns


def test_combinations_and_least_squares():
    combos = m.combinations_filling(8, 3)
    assert {tuple(np.repeat(np.arange(9), c)) for c in combos} == {(8,), (1, 7), (2, 6), (3, 5), (4, 4), (1, 1, 6), (1, 2, 5), (1, 3, 4), (2, 2, 4), (2, 3, 3)}
    columns = combos[:, 1:].T.astype(float)
    rng = np.random.default_rng(2)
    wanted = columns @ rng.integers(0, 9, len(combos))
    x = m.non_negative_least_squares(columns, wanted)
    assert (x >= 0).all() and np.abs(columns @ x - wanted).max() < 1e-6
    target = np.array([0, 9.0, 0, 0, 1, 0, 0, 0])
    x = m.non_negative_least_squares(columns, target)
    gradient = columns.T @ (columns @ x - target)
    assert (gradient > -1e-6).all() and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-6


def test_padding_is_small_at_size():
    rng = np.random.default_rng(4)
    lengths = np.minimum(60_000, (rng.lognormal(6.5, 1.1, 8000)).astype(int) + 1).tolist()
    histogram = np.zeros(m.BINS + 1)
    for n in lengths:
        if n % m.WINDOW:
            histogram[m.step_of(np.int64(n % m.WINDOW))] += 1
    combos, repeats = m.plan_repeats(histogram)
    rows, _ = m.pack_block(lengths, combos, repeats, 1.0, 7)
    total, padded, by = 0, 0, {}
    for _, _, n, s, _ in rows:
        by[s] = by.get(s, 0) + n
    for n in by.values():
        total += n
        padded += 0 if n & (n - 1) == 0 else m.WINDOW - n
    assert total == sum(lengths) and padded / total < 0.02
    assert len(rows) < 2 * len(lengths) + total // m.WINDOW


def test_small_blocks_follow_the_plan():
    """Blocks of 50 pieces take as many combinations as one block of all."""
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(200, 3500, 20_000)]
    histogram = np.bincount(m.step_of(np.array(lengths)), minlength=m.BINS + 1).astype(float)
    combos, repeats = m.plan_repeats(histogram)
    owed, sequence, cut, whole = np.zeros(len(repeats)), 0, 0, m.pack_block(lengths, combos, repeats, 1.0, 0)[0]
    for at in range(0, len(lengths), 50):
        rows, sequence = m.pack_block(lengths[at : at + 50], combos, repeats, 50 / len(lengths), sequence, owed=owed)
        cut += sum(r[1] > 0 for r in rows)
    planned = repeats.sum() - np.abs(owed).sum()
    assert planned > 0.3 * repeats.sum() and sum(r[1] > 0 for r in whole) < cut < len(lengths)
