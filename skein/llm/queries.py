"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import borda, language, markup, mixing, neighbours, packing, pairs, residue, sentences, topn
from skein.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "qa"), "qa_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "candidates"), "source_path", "reranker_score", "pair_id", 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks, config = table(spark, d, "chunks"), table(spark, d, "vault_config")
    labelled = chunks.select("chunk_id", "text", "vault").join(config.select("vault", "lang"), "vault", "left")
    return language.wrong_labels(chunks, config, language.fit_identifier(labelled, "text", "lang", "chunk_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = borda.rank_candidates(table(spark, d, "candidates"), table(spark, d, "vault_config"), table(spark, d, "rank_queries"), first=1)
    return ranked.select("source_path", "pair_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cleaned = markup.clean_markup(markup.text_fields(table(spark, d, "candidates"), table(spark, d, "search_hits")))
    return cleaned.select("tbl", "row_id", "field", F.explode("kinds").alias("kind"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = sentences.sentence_units(table(spark, d, "chunks").select("chunk_id", "text"), "text", "chunk_id")
    gold = sentences.sentence_units(table(spark, d, "gold").select("gold_id", "sentence"), "sentence", "gold_id")
    one = chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), "end_pos")
    return one.unionByName(gold.select(F.lit("gold").alias("tbl"), F.col("gold_id").alias("row_id"), "end_pos"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mix(spark, d), table(spark, d, "documents"), table(spark, d, "source_weights"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.content_free(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_pack": p8_pack,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
}

ORACLE_SQL: dict[str, str] = {
    "p2_found": """
SELECT source_path, CAST(rn AS INTEGER) AS rank_no, pair_id FROM (
  SELECT source_path, pair_id, row_number() OVER (PARTITION BY source_path ORDER BY reranker_score DESC, pair_id) AS rn
  FROM candidates WHERE reranker_score IS NOT NULL AND NOT isnan(reranker_score))
WHERE rn <= 5""",
    "p3_found": """
WITH v AS (
  SELECT chunk_id, file_path, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks
  WHERE vector IS NOT NULL AND len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (
  SELECT a.chunk_id AS id, b.chunk_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS c
  FROM v a JOIN v b ON a.chunk_id <> b.chunk_id AND a.file_path IS DISTINCT FROM b.file_path),
r AS (
  SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rn FROM s WHERE c >= 0.8)
SELECT DISTINCT least(id, other) AS chunk_id_a, greatest(id, other) AS chunk_id_b FROM r WHERE rn <= 5""",
    "p5_found": """
WITH w AS (
  SELECT vault, max(CASE WHEN NOT isnan(vector_search_weight) THEN vector_search_weight END) AS w FROM vault_config GROUP BY vault),
c AS (
  SELECT c.source_path, c.pair_id, c.vector_distance AS d, c.reranker_score AS s,
         least(1.0, greatest(0.0, coalesce(w.w, 1.0))) AS w
  FROM candidates c LEFT JOIN w ON c.vault = w.vault
  WHERE c.source_path IN (SELECT source_path FROM rank_queries)
    AND c.vector_distance IS NOT NULL AND NOT isnan(c.vector_distance)
    AND c.reranker_score IS NOT NULL AND NOT isnan(c.reranker_score)),
r AS (
  SELECT source_path, pair_id,
         w * (count(*) OVER (PARTITION BY source_path) - rank() OVER (PARTITION BY source_path ORDER BY d)
              - (count(*) OVER (PARTITION BY source_path, d) - 1) / 2.0)
         + (1 - w) * (count(*) OVER (PARTITION BY source_path) - rank() OVER (PARTITION BY source_path ORDER BY s DESC)
              - (count(*) OVER (PARTITION BY source_path, s) - 1) / 2.0) AS points
  FROM c)
SELECT source_path, pair_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY round(points, 9) DESC, pair_id) AS rn FROM r)
WHERE rn = 1""",
}
