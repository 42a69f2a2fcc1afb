"""The registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import align, bpe, dedup, jaccard, katz, media, packing, pii, quality, quotes, repair, suffix, toxicity
from logloom.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents")).members().select("doc_id", "n_shingles", "component_id", "class_id")


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents")).counted()


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.crc_rest(F.col("doc_id"), 4) != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.crc_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, contents=False)


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.conversations(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "reply_to", "root", "depth", "n_quoted", "n_linked", F.sha2("clean_text", 256).alias("clean_sha256"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"), contents=False)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.score(docs, toxicity.crc_rest(F.col("doc_id"), 5) != 1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), contents=False)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_OP1 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS shingles FROM w
), e AS (
  SELECT doc_id, unnest(shingles) AS g FROM s
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN s sx ON sx.doc_id = x.doc_id JOIN s sy ON sy.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, len(sx.shingles), len(sy.shingles)
  HAVING 100 * count(*) >= 75 * (len(sx.shingles) + len(sy.shingles) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
), k AS (
  SELECT doc_id, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(shingles)) END AS class_id FROM s
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id, k.class_id
FROM s JOIN c USING (doc_id) JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op2_ngram_jaccard": _OP2}
