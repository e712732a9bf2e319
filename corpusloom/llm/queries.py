"""The registered query of each operator, with production parameters, over the whole of its table; SQL where SQL can tell the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, linededup, minhash, simhash, sstable, tokencount, toxicity, warc
from ._shared import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.held_out(parts=3, part=1)
    codes = langid.learn(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), codes).drop("text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.held_out()
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), allowed=~held_out)
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), machine).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


SQL = {
    "op4_decontamination": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT DISTINCT d.doc_id, d.i, d.size, b.item FROM doc_windows d JOIN item_windows b ON d.size = b.size AND d.win = b.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
total AS (SELECT host, count(*) AS total FROM lines GROUP BY host),
counted AS (SELECT host, line, count(*) AS pages FROM (SELECT host, unnest(list_distinct(list_transform(ls, lambda x: trim(x)))) AS line FROM lines) WHERE line <> '' GROUP BY host, line),
frequent AS (SELECT host, list(line) AS f FROM counted JOIN total USING (host) WHERE pages >= 3 AND pages > 0.1 * total GROUP BY host),
kept AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(f, []), trim(x))) AS k FROM lines LEFT JOIN frequent USING (host))
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(k, chr(10)) END AS text, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(k) AS BIGINT) AS n_dropped FROM kept""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder, CAST(('0x' || hex) AS VARCHAR) AS h FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda j:
    (((strpos('0123456789abcdef', substr(hex, CAST((5 * i + j) // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - (5 * i + j) % 4 AS INTEGER)) & 1) * CAST(1 << CAST(4 - j AS INTEGER) AS BIGINT))) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM b""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_token_counts, op3_language, op4_decontamination, op5_line_dedup, op6_toxicity, op7_simhash, op8_bpe, op9_sstable, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
