"""Grouping candidate pairs and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

JOINER = "\n...\n"


def group_pairs(pairs: DataFrame, n: int = 5) -> DataFrame:
    """(source_path, target_path, contexts, n_contexts): the n best-scored snippets of each pair, best first; unscored rows come last, ties by pair_id."""
    score = F.when(~F.isnan("reranker_score"), F.col("reranker_score"))
    w = W.partitionBy("source_path", "target_path").orderBy(F.desc_nulls_last(score), "pair_id")
    top = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_r", F.coalesce("target_content", F.lit("")).alias("text"))))
    return top.groupBy("source_path", "target_path").agg(rows.alias("_c")).select("source_path", "target_path", F.col("_c.text").alias("contexts"), F.size("_c").alias("n_contexts"))


def group_by_file(reranked: DataFrame, by: str) -> DataFrame:
    """(by, file_path, text, distance, score): the reranked chunks of each file joined in rank order, with the distance and score of the best."""
    rows = F.array_sort(F.collect_list(F.struct("rank_no", F.coalesce("text", F.lit("")).alias("text"))))
    g = reranked.groupBy(by, "file_path").agg(rows.alias("_c"), F.min_by("distance", "rank_no").alias("distance"), F.max("score").alias("score"))
    return g.select(by, "file_path", F.array_join("_c.text", JOINER).alias("text"), "distance", "score")


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows not yet done (checkpoint resume)."""
    return keys.join(done.select(*on).distinct(), on, "left_anti")


def merge_ranked(seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """Seed and expanded rows (query_id, text, score, ord) as one ranking: score descending, seeds first among equals; rank_no from 1."""
    both = seeds.select("query_id", "text", "score", F.lit(0).alias("side"), "ord").unionByName(expanded.select("query_id", "text", "score", F.lit(1).alias("side"), "ord"))
    return both.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "side", "ord")))
