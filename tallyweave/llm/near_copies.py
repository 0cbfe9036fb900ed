"""Near copies by exact shingle similarity, found through SimHash fingerprints and min-hash bands.

Two texts are linked if the Jaccard similarity of their sets of ``WORDS``-word shingles is at
least ``LEAST`` (shingles as XXH64 hashes, A-Z in lower case).

Candidates. The 64-bit SimHash fingerprints of the distinct shingle sets are searched for those that
differ in at most four bits, by the segment counts of ``simhash_segments``; what hangs together is
under one key. At a similarity of 0.8 two fingerprints differ in 9.7 bits on average, though, so every
set has ``BANDS`` further keys, each of ``ROWS`` min-hashes. A pair of similarity s shares one of
these with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8, 0.99998 at 0.85.

Every candidate is verified, by joins with the shingle sets. First the members of a key are held
against its smallest one, which connects a group of near copies without all its pairs. Members of
keys that still hold several components are few, but a passage that many texts share may bring
thousands of them under one key, none alike. They are searched again by an exact prefix filter: with
the shingles of a text in the order of their frequency among these texts, rarest first, two texts of
n shingles each can only be alike if they share one of the first n - ceil(0.8 n) + 1, and of these
one among the first n - ceil(8/9 n) + 1 of the smaller text, for which it is indexed; the places at
which it stands bound what they can have in common. Shared passages are rarely among the rarest.
Again the members of a shingle are held against one of them first, the one with the least of its own, then those of
different components against each other, whatever their number; a pair inside a component could add
nothing. So the components are those of all candidate pairs.

Only different shingle sets are searched, so copies cost nothing however many there are.

Defined results: a null text has no words; texts without words are copies of each other and of
nothing else; fewer than ``WORDS`` words are one shingle. Repeated rows are copies. Of equal keys the
row with the smallest text hash stays, of equal texts the first in the input. Texts of any length
count whole. An empty table gives no rows. Other columns are carried in a struct, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.simhash_segments import SEED, fingerprint_links, majority, shingle_hashes
from tallyweave.operators.components import connected_components
from tallyweave.session import cut_lineage, drop_step

WORDS = 5
LEAST = (4, 5)  # 0.8 as a fraction, so that no rounding decides
BANDS = 24
ROWS = 6
AT_ONCE = 1 << 10

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, words))


def band_keys(shingles: np.ndarray) -> list[int]:
    """The signed keys of a shingle set; none of an empty one."""
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), AT_ONCE):
        mixed = (shingles[at : at + AT_ONCE, None] ^ _MASKS) * _FACTORS
        # the upper half of a product depends on all bits of the hash; folded in, so does the order
        mixed ^= mixed >> np.uint64(32)
        np.minimum(low, (mixed * _FACTORS).min(axis=0), out=low)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signatures(words: int):
    @F.pandas_udf("shingles long, n int, keys array<long>, fp long")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, words) for t in texts]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"shingles": ids, "n": [len(s) for s in sets], "keys": [band_keys(s) for s in sets], "fp": fps})

    return signature


def _shingles(words: int):
    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, words).view(np.int64) for t in texts], dtype=object)

    return shingles


def _near(common: Column | int, a: Column, b: Column, least: tuple[int, int]) -> Column:
    """Whether ``common`` of ``a`` and ``b`` shingles reach the similarity."""
    return F.lit(least[1]) * common >= F.lit(least[0]) * (a + b - common)


def _sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set) of the ids."""
    return cut_lineage(texts.join(ids.distinct(), "id", "left_semi").select("id", _shingles(words)("text").alias("set")))


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The (src, dst) of ``pairs`` whose similarity is high enough."""
    left = sets.select(F.col("id").alias("src"), F.col("set").alias("a"))
    right = sets.select(F.col("id").alias("dst"), F.col("set").alias("b"))
    joined = pairs.join(left, "src").join(right, "dst")
    common = F.size(F.array_intersect("a", "b"))
    return cut_lineage(joined.where(_near(common, F.size("a"), F.size("b"), least)).select("src", "dst"))


def _possible(a: Column, b: Column, least: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be alike at all."""
    return _near(F.least(a, b), a, b, least)


def _shared(members: DataFrame) -> DataFrame:
    """Members (id, n, key, at, indexed) of keys with several, each with the indexed member as ``first``
    in which the key stands first, then the smallest; keys without one make no pair. A text in which
    little is rarer than what it shares is the one that the others of a group were copied from."""
    lowest = F.min(F.when(F.col("indexed"), F.struct("at", "id", "n")))
    first = members.groupBy("key").agg(lowest.alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 AND first IS NOT NULL").drop("c")
    return cut_lineage(members.join(first, "key"))


def _to_first(shared: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs of the smallest member of a key and each other."""
    pairs = shared.where((F.col("id") != F.col("first.id")) & _possible(F.col("n"), F.col("first.n"), least))
    return pairs.select(F.col("first.id").alias("src"), F.col("id").alias("dst")).distinct()


def _labelled(shared: DataFrame, found: DataFrame) -> DataFrame:
    return shared.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "n", "at", "indexed", "first", F.coalesce("component", "id").alias("component"))


def _unsettled(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members of keys whose other members, beside the smallest, lie in several components."""
    others = cut_lineage(_labelled(shared, found).where("id <> first.id"))
    split = others.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("key")
    return cut_lineage(others.join(split, "key", "left_semi"), replaces=others)


def _rarest(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(id, n, key, at, indexed): the shingles of every set one of which any set alike must share,
    ``at`` which place they stand, and whether a set of the same size or a larger one must share it."""
    each = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("key"))
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "key"))
    reach = lambda part, whole: F.col("n") - F.floor((F.col("n") * part + whole - 1) / whole) + 1
    placed = each.join(counts, "key").withColumn("at", place).where((F.col("at") <= reach(*least)) & (F.col("f") > 1))
    return placed.select("id", "n", "key", "at", (F.col("at") <= reach(2 * least[0], least[0] + least[1])).alias("indexed"))


def with_fingerprint_key(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, n, keys, fp and others) with one more key: what its fingerprint is linked to."""
    groups = connected_components(fingerprint_links(nodes.where("n > 0").select("fp").distinct()))
    key = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))
    keys = F.when(F.col("n") > 0, F.concat("keys", F.array(key))).otherwise(F.col("keys"))
    return nodes.join(groups, F.col("fp") == F.col("node"), "left").withColumn("keys", keys).select(*nodes.columns)


def components_of(nodes: DataFrame, texts: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(node, component) of the linked ones among ``nodes`` (id, n, keys); ``texts`` are (id, text)."""
    shared = _shared(nodes.select("id", "n", F.explode("keys").alias("key"), F.lit(1).alias("at"), F.lit(True).alias("indexed")))
    pairs = cut_lineage(_to_first(shared, least))
    sets = _sets(texts, pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))), words)
    links = _verified(pairs, sets, least)
    drop_step(sets)
    drop_step(pairs)
    found = connected_components(links)
    unsettled = _unsettled(shared, found)
    drop_step(shared)
    if unsettled.isEmpty():
        return found

    sets = _sets(texts, unsettled.select("id"), words)
    shared = _shared(_rarest(sets, least))
    labels = _labelled(shared, found)
    of_first = found.select(F.col("node").alias("_first"), F.col("component").alias("_c"))
    apart = labels.join(of_first, F.col("first.id") == F.col("_first"), "left").where(F.col("component") != F.coalesce("_c", "first.id"))
    links = links.unionByName(_verified(cut_lineage(_to_first(apart, least)), sets, least))
    found = connected_components(links)
    # components first, members after: no pair inside a component is formed
    rest = _unsettled(shared, found).select("key", "id", "n", "at", "component", "indexed")
    smaller, larger = rest.where("indexed"), rest
    # the largest set that one which holds a shared shingle at this place can be like
    most = F.floor((sum(least) * (1 + F.col("n") - F.col("at")) - least[0] * F.col("n")) / least[0])
    low = smaller.groupBy("key", F.col("component").alias("low")).agg(F.min("n").alias("ln"), F.max(F.least(most, F.floor(F.col("n") * least[1] / least[0]))).alias("lm"))
    high = larger.groupBy("key", F.col("component").alias("high")).agg(F.min("n").alias("hn"), F.max("n").alias("hx"), F.max(most).alias("hm"))
    fits = (F.col("low") != F.col("high")) & (F.col("ln") <= F.least("hm", "hx")) & (F.col("lm") >= F.col("hn"))
    crossing = low.join(high, "key").where(fits).select("key", "low", "high")
    a = smaller.select("key", F.col("component").alias("low"), F.col("id").alias("src"), F.col("n").alias("sn"), F.col("at").alias("sa"))
    b = larger.select("key", F.col("component").alias("high"), F.col("id").alias("dst"), F.col("n").alias("dn"), F.col("at").alias("da"))
    ahead = 1 + F.least(F.col("sn") - F.col("sa"), F.col("dn") - F.col("da"))  # the most they can have in common
    reached = F.lit(sum(least)) * ahead >= F.lit(least[0]) * (F.col("sn") + F.col("dn"))
    pairs = crossing.join(a, ["key", "low"]).join(b, ["key", "high"]).where((F.col("sn") <= F.col("dn")) & reached)
    pairs = pairs.where(_possible(F.col("sn"), F.col("dn"), least))
    more = _verified(cut_lineage(pairs.select("src", "dst").distinct()), sets, least)
    return connected_components(links.unionByName(more)) if not more.isEmpty() else found


def one_of_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` with one row of every component of linked texts: the one with the smallest key, and
    of rows that share it the one with the smallest text hash."""
    columns = docs.columns
    stored = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.struct(F.col(f"`{key}`").isNull().alias("n"), F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("t")).alias("_rank"),
            _signatures(words)(F.col(f"`{text}`")).alias("_sig"),
            F.col(f"`{text}`").alias("_text"),
            F.struct(*[F.col(f"`{c}`") for c in columns if c != text]).alias("_doc") if len(columns) > 1 else F.lit(None).alias("_doc"),
        )
    )
    ranked = F.struct("_rank.n", "_rank.k", "_rank.t", F.col("_row").alias("r"))
    nodes = cut_lineage(
        stored.groupBy(F.col("_sig.shingles").alias("id")).agg(F.min(ranked).alias("lowest"), F.first("_sig.n").alias("n"), F.first("_sig.keys").alias("keys"), F.first("_sig.fp").alias("fp"))
    )
    texts = stored.select("_row", F.col("_text").alias("text")).join(nodes.select("id", F.col("lowest.r").alias("_row")), "_row").select("id", "text")
    parts = components_of(with_fingerprint_key(nodes), texts, words, least)
    chosen = (
        nodes.select("id", "lowest")
        .join(parts, F.col("id") == F.col("node"), "left")
        .groupBy(F.coalesce("component", "id").alias("component"))
        .agg(F.min("lowest").alias("lowest"))
        .select(F.col("lowest.r").alias("_row"))
    )
    kept = stored.join(chosen, "_row", "left_semi")
    return kept.select(*[F.col("_text").alias(c) if c == text else F.col("_doc").getField(c).alias(c) for c in columns])
