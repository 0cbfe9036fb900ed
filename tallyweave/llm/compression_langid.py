"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with pieces of its training
texts. A text is lower-cased and encoded once with every dictionary, and the language whose
dictionary gives the smallest output wins. Long texts are encoded in blocks of ``BLOCK`` bytes,
each with the dictionary anew, so that the whole text counts and the last block is judged like
the first. The score is the margin: 1 - smallest / second smallest. ``confident`` rejects
scores under ``MARGIN``.

The dictionaries are the only thing learned. They hold at most ``DICTIONARY_BYTES`` per
language, drawn as pieces of ``PIECE`` code points from all training texts by the hash of the
piece, so a piece that many documents share counts once. A text's prediction depends on the
text alone.

Defined results: a null text, and one without a letter, is ``und`` with score 0. Without any
learned language everything is ``und``; with one, the rival is the plain encoding without a
dictionary. Ties go to the language with more training text, then to the smaller name, and
have score 0. Every language with eight bytes of text or more is learned: the pieces with the
smallest hashes are drawn up to a power of two that fills its dictionary, or all there are. Copies
of a piece count once in that too. Repeated rows are each classified; extra columns stay, except those named like
an output. A table with more than ``MAX_LANGUAGES`` languages is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICTIONARY_BYTES = 112 << 10
PIECE = 1000
HASH_BITS = 62
BLOCK = 4096
LEVEL = 6
MIN_MATCH = 3
MARGIN = 0.01
MAX_LANGUAGES = 512
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def learn_dictionaries(
    docs: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES
) -> list[tuple[str, bytes]]:
    """[(language, dictionary)], the language with most training text first.

    Three passes: one adds up the text of every language, one the distinct pieces by the
    highest bit of their hash, and one draws the pieces below the power of two that fills each
    dictionary and cuts it to size. What reaches the driver is bounded by the dictionaries, not
    by the corpus.
    """
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    totals = (
        rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars")).orderBy(F.desc("chars"), "lang").limit(MAX_LANGUAGES + 1).collect()
    )
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return []
    hashed = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece")).withColumn(
        "hash", F.pmod(F.xxhash64("piece"), F.lit(1 << HASH_BITS))
    )
    level = F.length(F.bin("hash"))
    distinct = hashed.groupBy("lang", "hash").agg(F.max(F.char_length("piece")).alias("chars"))
    sums = distinct.groupBy("lang", level.alias("level")).agg(F.sum("chars").alias("chars")).collect()  # HASH_BITS rows a language
    highest: dict[str, int] = {}
    filled: dict[str, int] = {}
    for r in sorted(sums, key=lambda r: r["level"]):
        if filled.get(r["lang"], 0) < dictionary_bytes:  # a character has a byte at least
            filled[r["lang"]] = filled.get(r["lang"], 0) + r["chars"]
            highest[r["lang"]] = r["level"]
    if not highest:
        return []
    levels = F.create_map(*[F.lit(x) for pair in highest.items() for x in pair])
    pieces = hashed.where(level <= F.element_at(levels, F.col("lang"))).distinct()
    drawn: dict[str, list[tuple[int, str]]] = {}
    for r in pieces.collect():
        drawn.setdefault(r["lang"], []).append((r["hash"], r["piece"]))
    found = []
    for r in totals:
        joined = "\n".join(p for _, p in sorted(drawn.get(r["lang"], []))).lower().encode("utf-8", "replace")
        found.append((r["lang"], joined[:dictionary_bytes]))
    return [(name, content) for name, content in found if len(content) >= 8]


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    """Compressors by language, and the plain one; kept for the next task of the worker."""

    def parameters(size: int) -> zstandard.ZstdCompressionParameters:
        return zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=BLOCK, dict_size=size, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0
        )

    made = []
    for name, content in dictionaries:
        chosen = parameters(len(content))
        loaded = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        loaded.precompute_compress(compression_params=chosen)
        made.append((name, zstandard.ZstdCompressor(compression_params=chosen, dict_data=loaded)))
    return made, zstandard.ZstdCompressor(compression_params=parameters(0))


def classify_text(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    if not text or not dictionaries or not _LETTER.search(text):
        return UNKNOWN, 0.0
    made, plain = _compressors(dictionaries)
    whole = text.lower().encode("utf-8", "replace")
    blocks = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in made]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    others = sizes[:best] + sizes[best + 1 :] or [sum(len(plain.compress(b)) for b in blocks)]
    return made[best][0], max(0.0, 1 - sizes[best] / min(others))


def classify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; nothing is shuffled."""
    # the dictionaries go to every executor once: at most MAX_LANGUAGES * DICTIONARY_BYTES
    sent = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([classify_text(t, sent.value) for t in texts], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    judged = rows.withColumn("_judged", predict(F.col("_doc").getField(text)))
    return judged.select(
        *[F.col("_doc").getField(c).alias(c) for c in kept], F.col("_judged.lang_pred").alias("lang_pred"), F.col("_judged.score").alias("score")
    )


def confident(classified: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows whose language is known by at least ``margin``."""
    return classified.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= margin))
