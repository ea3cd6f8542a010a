"""Registered queries of the operators: each applies its operator to the whole of its table
and derives the digest columns that its contract names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, divergence, fingerprint, license, minhash, quality, sharding, tokenfile, toxicity, warc, whitening

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a vocabulary file: below $TESSERA_TOKENIZERS, else where the installed
    package of public tokenizers has it."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sizes JOIN least USING (doc_id)
"""


@_register("op1_minhash_dedup", _OP1_SQL)
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, share=(85, 100))


@_register("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(_table(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, modulus: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_field(docs: DataFrame, labels: DataFrame) -> quality.Field:
    return quality.learn_field(docs, labels, remainder(4) != 2)


def toxicity_machine(docs: DataFrame, labels: DataFrame) -> toxicity.Machine:
    return toxicity.learn_machine(docs, labels, remainder(5) != 0)


@_register("op4_quality_crf")
def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality_field(docs, _table(spark, sf_dir, "labels"))), 4, 2, quality.THRESHOLD)


_OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, length(text) + length(role) + 15 + length(regexp_replace(text || role, '[^<\\]', '', 'g'))
                 + length(regexp_replace(role, '[^\n]', '', 'g')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@_register("op5_chat_format", _OP5_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(rows, vocabulary("byte_bpe_50k.json")))


@_register("op6_bpe_codec")
def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


@_register("op7_token_file")
def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""


@_register("op8_warc", _OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"), html=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register("op9_fingerprint")
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


@_register("op10_toxicity_fm")
def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity_machine(docs, _table(spark, sf_dir, "labels"))), 5, 0, toxicity.THRESHOLD)


_OP11_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
numbered AS (SELECT row_number() OVER () AS k, * FROM d),
places AS (SELECT k, lang, source, unnest(w) AS term FROM numbered),
kept AS (SELECT lang, term, count(*) AS lang_n FROM places GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
langs AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS HUGEINT) AS n FROM kept GROUP BY lang),
cells AS (SELECT p.lang, p.source, p.term, count(*) AS n FROM places p JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT s.lang, s.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM sources s LEFT JOIN cells c
          ON c.lang = s.lang AND c.source = s.source GROUP BY ALL),
prices AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (k.lang_n + 5)) // (l.n + 5 * l.v) AS q
           FROM sizes s JOIN langs l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang
           LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.v, 0) AS BIGINT) AS value
          FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS v FROM prices x JOIN prices y
                     ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
          ON f.lang = a.lang AND f.s = a.source AND f.t = b.source),
items AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
          SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM prices WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM items)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@_register("op11_source_divergence", _OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


@_register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


@_register("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))
