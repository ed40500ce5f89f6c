"""Top N items within every group (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from skein.operators.ranking import magnitude_bin

#: At most this many groups count as hot, so this many threshold rows at most are broadcast.
MAX_HOT_GROUPS = 10_000


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int = 5, bins_per_unit: int = 64) -> DataFrame:
    """(group, rank_no, tie): for each group the n rows with the highest score, rank_no from 1.

    Method: a score histogram per group gives the highest bin edge that at least n rows of the group reach;
    rows below it are dropped before anything is sorted; the few survivors are ranked exactly by
    (score descending, tie ascending). Counts combine before the shuffle. Thresholds of groups with at least
    1/10,000 of all rows are broadcast (there are at most 10,000 such groups), so a hot group is filtered
    where its rows lie; the others meet their threshold in a shuffle join. The final rank keeps n rows a
    group per task before its own shuffle, so even a million equal best scores stay spread.

    Null and NaN scores never count; a null group is a group of its own; groups without a usable score give
    no row; rows equal in score and tie keep both, in any order; other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(score).cast("double").alias("_s"), F.col(tie).alias("_t"))
    rows = rows.filter(F.col("_s").isNotNull() & ~F.isnan("_s")).withColumn("_bin", magnitude_bin(F.col("_s"), bins_per_unit))
    hist = rows.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    down = W.partitionBy("_g").orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = hist.withColumn("_cum", F.sum("_c").over(down))
    edges = cum.groupBy("_g").agg(F.min(F.when(F.col("_cum") - F.col("_c") < n, F.col("_bin"))).alias("_edge"), F.sum("_c").alias("_size"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    edges = edges.crossJoin(F.broadcast(total)).withColumn("_hot", F.col("_size") * MAX_HOT_GROUPS >= F.col("_total"))
    hot = F.broadcast(edges.filter("_hot").select(F.col("_g").alias("_hg"), F.col("_edge").alias("_he")))
    tagged = rows.join(hot, F.col("_g").eqNullSafe(F.col("_hg")), "left").filter(F.col("_he").isNull() | (F.col("_bin") >= F.col("_he")))
    cold = edges.filter("NOT _hot").select(F.col("_g").alias("_cg"), F.col("_edge").alias("_ce"))
    kept = tagged.filter(F.col("_he").isNotNull()).select("_g", "_s", "_t").unionByName(
        tagged.filter(F.col("_he").isNull()).join(cold, F.col("_g").eqNullSafe(F.col("_cg")) & (F.col("_bin") >= F.col("_ce"))).select("_g", "_s", "_t")
    )
    rank = F.row_number().over(W.partitionBy("_g").orderBy(F.desc("_s"), F.asc("_t")))
    return kept.withColumn("rank_no", rank).filter(F.col("rank_no") <= n).select(F.col("_g").alias(group), "rank_no", F.col("_t").alias(tie))
