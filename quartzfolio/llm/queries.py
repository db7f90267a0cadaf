"""The queries op1_ to op13_ over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, chat_repair, decontaminate, line_dedup, merkle, minhash_forest, pii, quality_classifier, quality_rules, repeated_bytes, token_files, url_filter
from .common import table

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines before, lines and chunks removed, and the text that is left."""
    d = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed_lines").alias("n_removed_lines"), F.col("_n_removed_chunks").alias("n_removed_chunks"), "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.groups(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_extra(table(spark, sf_dir, "conversations")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.digests(chat_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's sizes and digest, and the text that is left."""
    return repeated_bytes.digests(repeated_bytes.cut(table(spark, sf_dir, "documents")), repeated_bytes.kept_text().alias("text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_decontaminate, op4_quality_rules, op5_quality_classifier, op6_minhash, op7_bpe, op8_chat_format, op9_token_files, op10_url_filter, op11_chat_repair, op12_repeated_bytes, op13_merkle)}

_OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
     win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
     rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win),
     cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 3)) AS k) WHERE c > 1 GROUP BY doc_id),
     b AS (SELECT d.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           len(string_split(text, chr(10))) AS n_lines FROM d LEFT JOIN cov USING (doc_id)),
     f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (n_words > 0 AND 2 * n_dup_lines > n_lines) OR (4 * n_symbols > n_words AND n_symbols > 20)
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(text)
            OR 10 * length(regexp_replace(text, '[^!]+', '', 'g')) > length(text)) AS kept
FROM f
"""
_ESC = r"replace(replace(replace({0}, '\', '\b'), '<', '\l'), '[', '\q')"
_OP8 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     m AS (SELECT *, regexp_matches(role || ' ' || text, '<s>|</s>|\[ROLE\]|\[ESC\]|\[INST\]|\[/INST\]|\\[blq]') AS strong FROM t),
     n AS (SELECT *, CASE WHEN strong THEN 8 + length({_ESC.format('role')}) + length({_ESC.format('text')}) ELSE 9 + length(role) + length(text) END + 18 AS size FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
_METHOD = " OR ".join(f"regexp_matches(subject, '{pattern}')" for _, pattern, _ in url_filter.method_rules())
_OP10 = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
                  regexp_extract(substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3), '^[^?#]*\?([^#]*)', 1, 's') AS query,
                  CASE WHEN contains(url, '://') THEN host || path || CASE WHEN query <> '' THEN '?' ELSE '' END || query ELSE '' END AS subject, row_number() OVER () AS k FROM pages),
     rules(verdict, host, path) AS (VALUES {', '.join(str(r) for r in url_filter.RULES)}),
     fits AS (SELECT k, max_by(struct_pack(verdict := r.verdict, rule := r.host || r.path), length(r.host || r.path)) AS best FROM p JOIN rules r
              ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k)
SELECT page_id, host, path, best.rule AS rule,
       CASE WHEN best IS NOT NULL THEN best.verdict WHEN {_METHOD} THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN fits USING (k)
"""
ORACLES = {"op4_quality_rules": _OP4, "op8_chat_format": _OP8, "op10_url_filter": _OP10}
