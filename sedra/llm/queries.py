"""The queries opN_<name>, each an operator applied to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, mixing, packing, pii, quality, search, secrets, simhash, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page after a round trip through archives."""
    return warc.archived(_table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return docs.select("doc_id", *[_count("found", k).alias(f"n_{k}") for k in secrets.BASE_KINDS], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures, the base rule and the verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    table = quality.measured(docs).withColumn("row", F.struct("row.doc_id"))
    out = quality.judged(quality.written(table, "quality"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence."""
    out = packing.packed_sequences(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that no other extends, rendered."""
    return chats.maximal_chats(_table(spark, sf_dir, "conversations"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every query vector."""
    return search.top_k(_table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, and what is left of it."""
    out = substrings.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op9_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", pii.pii_spans(F.col("text")).alias("found"))
    count = [_count("found", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return docs.select("doc_id", *count, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_secrets, op3_host_rules, op4_simhash, op5_packing, op6_chat_snapshots, op7_top_k, op8_substring_dedup, op9_water_filling, op10_anchor_expansion)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body, {_WORDS} AS w FROM documents),
spans AS (SELECT rid, i, list_slice(w, i, i + 7) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM spans) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM hits, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
r AS (SELECT *, 10 * n_symbols > n_words AS f1, 100 * n_dup_lines > 30 * n_lines AS f2,
  word_chars > 12 * n_words OR word_chars < 2 * n_words AS f3,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(f1::INT) AS a1, sum(f2::INT) AS a2, sum(f3::INT) AS a3 FROM r GROUP BY source),
p AS (SELECT sum(a1) / sum(n) AS m1, var_pop(a1 / n) AS v1, sum(a2) / sum(n) AS m2, var_pop(a2 / n) AS v2, sum(a3) / sum(n) AS m3, var_pop(a3 / n) AS v3 FROM h),
q AS (SELECT m1, m2, m3,
  greatest(1.0, least(1e4, CASE WHEN v1 > 0 THEN m1 * (1 - m1) / v1 - 1 ELSE 1e4 END)) AS w1,
  greatest(1.0, least(1e4, CASE WHEN v2 > 0 THEN m2 * (1 - m2) / v2 - 1 ELSE 1e4 END)) AS w2,
  greatest(1.0, least(1e4, CASE WHEN v3 > 0 THEN m3 * (1 - m3) / v3 - 1 ELSE 1e4 END)) AS w3 FROM p),
e AS (SELECT source, (a1 + m1 * w1) / (n + w1) > 0.5 AS e1, (a2 + m2 * w2) / (n + w2) > 0.5 AS e2, (a3 + m3 * w3) / (n + w3) > 0.5 AS e3 FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (f1 AND e1 OR f2 AND e2 OR f3 AND e3) AS kept
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""

OP1_SQL = """
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = big THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> big THEN big END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY body) AS big,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: (substr(bits, 5 * i + j + 1, 1)::INT << (4 - j))))::INT, 1)), '') AS digest
  FROM (SELECT *, array_to_string(list_transform(range(1, 41), lambda k: right(('0000' || bin(instr('0123456789abcdef', substr(hex, k, 1)) - 1)), 4)), '') AS bits
    FROM (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages)))
"""

OP6_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS l,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(l, 1, n) AS l FROM (SELECT l, unnest(range(1, len(l))) AS n FROM c))
SELECT conv_id, len(l)::BIGINT AS n_turns, rendered FROM c
WHERE l NOT IN (SELECT l FROM p) AND conv_id IN (SELECT min(conv_id) FROM c GROUP BY l)
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, (SELECT unnest(range(0, 20)) AS k) GROUP BY doc_id),
k AS (SELECT d.doc_id, w, gone, list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op3_host_rules": OP3_SQL, "op6_chat_snapshots": OP6_SQL, "op7_top_k": OP7_SQL, "op8_substring_dedup": OP8_SQL}
