"""The queries of this folder by name, and the SQL texts of those SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import held_fold, table
from tallyweave.llm.compression_langid import classify, learn_dictionaries
from tallyweave.llm.cube_mixing import mix
from tallyweave.llm.license_scan import scan
from tallyweave.llm.lyndon_runs import detect_runs
from tallyweave.llm.merkle_manifest import prove, tampered_leaf, verify_rows
from tallyweave.llm.multiset_hash import fingerprint_edits
from tallyweave.llm.quality_llr import bucket_ratios, judge_quality
from tallyweave.llm.nnls_packing import pack
from tallyweave.llm.recurrent_lm import score_documents
from tallyweave.llm.repair_shards import read_shards, write_shards
from tallyweave.llm.simhash_segments import near_duplicates
from tallyweave.llm.url_filter import Rule, judge_urls
from tallyweave.llm.warc_bundles import read_bundles, write_bundles
from tallyweave.session import shared_dir, ship_package

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary lies; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

_PARSED_URLS = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS asked
  FROM parts
), canon AS (
  SELECT page_id, host, path,
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') AS plain,
    array_to_string(list_sort(list_filter(string_split(asked, '&'),
      lambda p: NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)') AND p <> '')), '&') AS kept
  FROM split
), keyed AS (
  SELECT page_id, host, path,
    CASE WHEN host <> '' THEN plain || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS k
  FROM canon
), listed AS (SELECT DISTINCT k FROM keyed WHERE page_id % 50 = 0 AND k IS NOT NULL),
ruled AS (
  SELECT page_id, host, path, k, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM keyed
)
SELECT r.page_id, r.host, r.path, r.rule, l.k IS NOT NULL AS listed, CASE
  WHEN r.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
  WHEN l.k IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN listed l ON r.k = l.k
"""


@query("op5_url_filter", _PARSED_URLS)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the rules and the list of the urls whose page id is divisible by 50."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where("page_id % 50 = 0").select("url")
    return judge_urls(pages, "url", listed, RULES).select("page_id", "host", "path", "rule", "listed", "verdict")


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; trusted are those labelled as of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judge_quality(docs, bucket_ratios(docs, "text", trusted, "doc_id")).drop("text")


@query("op3_multiset_hash")
def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op6_compression_langid")
def op6_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; a third of them is never learned from."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (held_fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    learned = learn_dictionaries(docs.where("NOT held_out"))
    return classify(docs.select("doc_id", "held_out", "text"), learned).drop("text")


@query("op10_simhash_segments")
def op10_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    ship_package(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_cube_mixing")
def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document, and the targets of the sources."""
    ship_package(spark)
    return mix(table(spark, sf_dir, "documents")).drop("copies")


@query("op4_nnls_packing")
def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4,096 tokens."""
    ship_package(spark)
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


_RECORDS = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest AS shared, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d LEFT JOIN g ON payload_bytes >= 1000 AND payload_digest = shared
"""


@query("op1_warc_bundles", _RECORDS)
def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived in the shared folder and read back from there."""
    ship_package(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_bundles(table(spark, sf_dir, "pages"), path)
    return read_bundles(spark.read.parquet(path), with_payload=False)


@query("op2_recurrent_lm")
def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all documents; a fifth of them is never learned from."""
    ship_package(spark)
    return score_documents(table(spark, sf_dir, "documents"))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents, laid out as files of a tree by their id: eight to a folder, eight
    folders to the next, four levels deep; the first document of a folder is its licence file."""
    docs = table(spark, sf_dir, "documents")
    at = lambda size: F.floor(F.col("doc_id") / size)
    levels = [4096, 512, 64, 8]
    path = F.concat_ws("/", F.lit(""), *[at(n) for n in levels], F.concat(F.col("doc_id"), F.lit(".txt")))
    for depth, n in sorted(enumerate(levels, 1), reverse=True):  # the outermost folder wins
        licence = F.concat_ws("/", F.lit(""), *[at(k) for k in levels[:depth]], F.lit("LICENSE"))
        path = F.when(F.col("doc_id") % n == 0, licence).otherwise(path)
    first = F.when(F.col("doc_id").isNotNull(), path)
    return scan(docs.select("doc_id", first.alias("path"), "text"), keep=["doc_id"])


_PROOFS = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, n_chars, text, CAST(doc_id AS VARCHAR) AS k FROM documents
), crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)::BIGINT[]), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS inverse
  FROM d
), parts AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(k) || ':' || k, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d
), leaves AS (
  SELECT p.doc_id, coalesce('=' || lang, '') AS tree,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(inverse, 4294967295) % 7 = 0
      THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY p.doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS total
  FROM parts p JOIN crc c USING (doc_id)
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS h, total FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 1) // 2
  FROM nodes WHERE total > 1 GROUP BY tree, level, place // 2
), subroots AS (
  SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1
), top AS (
  SELECT 0 AS level, place, subroot AS h, total FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 1) // 2
  FROM top WHERE total > 1 GROUP BY level, place // 2
), whole AS (
  SELECT tree, level, place, h, total FROM nodes WHERE total > 1
  UNION ALL
  SELECT s.tree, s.height + t.level, t.place, t.h, t.total FROM top t CROSS JOIN subroots s WHERE t.total > 1
), placed AS (
  SELECT l.*, s.subroot, s.height, s.place AS tree_place FROM leaves l JOIN subroots s USING (tree)
), steps AS (
  SELECT p.doc_id, w.level, w.h AS other, w.place AS other_place FROM placed p JOIN whole w
    ON w.tree = p.tree AND w.place = CASE WHEN w.level < p.height THEN xor(p.place >> w.level, 1) ELSE xor(p.tree_place >> (w.level - p.height), 1) END
), proofs AS (
  SELECT doc_id, sha256(string_agg(other, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc_id
), deep AS (SELECT max(height) AS height, (SELECT max(level) FROM top) AS more FROM subroots),
folded AS (
  SELECT p.doc_id, 0 AS level, coalesce(changed, leaf) AS h, p.height + (SELECT more FROM deep) AS last FROM placed p
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(CASE WHEN s.other IS NULL THEN f.h WHEN s.other_place % 2 = 0 THEN s.other || f.h ELSE f.h || s.other END), f.last
  FROM folded f LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level WHERE f.level < f.last
)
SELECT p.doc_id, p.leaf, p.subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN folded f ON f.doc_id = p.doc_id AND f.level = f.last LEFT JOIN proofs q ON q.doc_id = p.doc_id
CROSS JOIN (SELECT h FROM top WHERE total = 1) r
"""

LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query("op11_merkle_manifest", _PROOFS)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, one tree per language; every seventh or so is checked with n_chars changed."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    changed = {"changed": tampered_leaf("doc_id", LEAF_FIELDS, "n_chars", 7)}
    proved = prove(docs, "doc_id", "lang", LEAF_FIELDS, changed)
    checked = verify_rows(proved, F.coalesce("changed", "leaf"))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_lyndon_runs")
def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, with a repetition planted into every tenth."""
    ship_package(spark)
    return detect_runs(table(spark, sf_dir, "documents"), plant=True)


@query("op13_repair_shards")
def op13_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in compressed shards and read back from them."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return read_shards(spark.read.parquet(path), docs.schema["doc_id"].dataType.simpleString())
