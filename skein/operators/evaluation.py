"""Scoring of links, retrieval and classification against gold data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.functions import scores as S, text as X


def with_prf(df: DataFrame) -> DataFrame:
    """df (tp, fp, fn) with precision, recall and f1, rounded to 6 digits."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": F.round(S.precision(tp, fp), 6), "recall": F.round(S.recall(tp, fn), 6), "f1": F.round(S.f1(tp, fp, fn), 6)})


def edge_counts(gold: DataFrame, predicted: DataFrame, by: list[str], use_relation: bool = True, case_sensitive: bool = False) -> DataFrame:
    """(by..., tp, fp, fn) over the edge sets (by..., rel_path, relation, target_name), full outer by note; relations compared case-folded unless told otherwise."""
    rel = F.col("relation") if case_sensitive else F.lower("relation")
    keys = [*by, "rel_path", "target_name", *(["_rel"] if use_relation else [])]

    def edges(df: DataFrame, mark: str) -> DataFrame:
        return df.withColumn("_rel", rel).select(*keys).distinct().withColumn(mark, F.lit(1))

    both = edges(gold, "_g").join(edges(predicted, "_p"), keys, "full_outer")
    g, p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    return both.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))


def fuzzy_match(gold_text, predicted_text, threshold: float = 0.5):
    """Whether the predicted sentence covers at least threshold of the gold sentence's lemma set; an empty set falls back to a substring test."""
    g = X.lemma_set(gold_text)
    share = F.size(F.array_intersect(g, X.lemma_set(predicted_text))) / F.size(g)
    return F.when(F.size(g) > 0, share >= threshold).otherwise(predicted_text.contains(gold_text))


def retrieval_counts(gold: DataFrame, predictions: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """(by, tp, fp, fn): gold rows (by, row_id, source_file, entity, sentence) matched by some prediction of their (source_file, entity) are tp, others fn; predicted keys without gold are fp.

    Gold rows count singly and predicted keys once, as the harness does.
    """
    keys = [by, "source_file", "entity"]
    pred = predictions.select(*keys, F.col("sentence").alias("_ps")).distinct()
    hit = gold.join(pred, keys).filter(fuzzy_match(F.col("sentence"), F.col("_ps"), threshold)).select("row_id").distinct()
    rows = gold.select(by, "row_id").join(hit.withColumn("_hit", F.lit(1)), "row_id", "left")
    found = rows.groupBy(by).agg(F.count("_hit").alias("tp"), (F.count(F.lit(1)) - F.count("_hit")).alias("fn"))
    extra = pred.select(*keys).distinct().join(gold.select(*keys).distinct(), keys, "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("fp"))
    out = found.join(extra, by, "full_outer")
    return out.select(by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def gold_groups(gold: DataFrame) -> DataFrame:
    """(sample_name, source_file, entity, true_type, sentences): gold rows grouped in row order; the last type that isn't null wins; groups without a type are dropped."""
    g = gold.groupBy("sample_name", "source_file", "entity").agg(
        F.max_by("link_type", F.when(F.col("link_type").isNotNull(), F.col("gold_id"))).alias("_type"),
        F.array_sort(F.collect_list(F.struct("gold_id", F.coalesce("sentence", F.lit("")).alias("sentence"), F.coalesce("is_direct_mention", F.lit(False)).alias("direct")))).alias("_s"),
    )
    return g.filter(F.col("_type").isNotNull()).select("sample_name", "source_file", "entity", F.lower("_type").alias("true_type"), F.col("_s.sentence").alias("sentences"))


def rank_sentences(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best sentences of each key: direct mentions first, then the higher score, then gold_id; rank_no from 1."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(F.desc(F.coalesce("is_direct_mention", F.lit(False))), F.desc_nulls_last("score"), "gold_id")
    return rows.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= n)


def class_counts(pairs: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn, support) of pairs (true_type, predicted_type) over true and predicted classes; two rows a pair are counted, nothing is joined."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("true_type").alias("cls"), F.lit(True).alias("t")), F.struct(F.col("predicted_type").alias("cls"), F.lit(False).alias("t")))).alias("_x"), (F.col("true_type") == F.col("predicted_type")).alias("_same"))
    same = F.coalesce("_same", F.lit(False))
    return both.select("_x.cls", "_x.t", same.alias("same")).filter("cls IS NOT NULL").groupBy("cls").agg(
        F.count_if(F.col("t") & F.col("same")).alias("tp"), F.count_if(~F.col("t") & ~F.col("same")).alias("fp"), F.count_if(F.col("t") & ~F.col("same")).alias("fn"), F.count_if("t").alias("support")
    )


def class_averages(per_class: DataFrame) -> DataFrame:
    """(avg_kind, precision, recall, f1): macro and support-weighted averages over true classes only."""
    t = per_class.filter("support > 0")
    cols = ("precision", "recall", "f1")
    macro = t.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols)).select(F.lit("macro").alias("avg_kind"), *cols)
    weighted = t.agg(*(F.coalesce(F.sum(F.col(c) * F.col("support")) / F.sum("support"), F.lit(0.0)).alias(c) for c in cols)).select(F.lit("weighted").alias("avg_kind"), *cols)
    return macro.unionByName(weighted).select("avg_kind", *(F.round(c, 6).alias(c) for c in cols))


def prf_rollup(counts: DataFrame, by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) for each value and OVERALL, the sum of all."""
    sums = counts.groupingSets([[F.col(by)], []], F.col(by)).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping(by).alias("_all"))
    return with_prf(sums.select(F.when(F.col("_all") == 1, F.lit("OVERALL")).otherwise(F.col(by)).alias(by), "tp", "fp", "fn"))


def micro_totals(counts: DataFrame, by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1): the counts of all samples summed for each strategy."""
    return with_prf(counts.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def corpus_counts(df: DataFrame, by: str, rows: str, **distinct: str) -> DataFrame:
    """(by, rows, ...): rows, and distinct values of columns by the name they get."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(rows), *(F.countDistinct(c).alias(name) for name, c in distinct.items()))


def nan_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each column without NaN and null, and n_evaluated, the rows less the largest number of such gaps."""
    gap = lambda c: F.col(c).isNull() | F.isnan(c)
    means = [F.round(F.avg(F.when(~gap(c), F.col(c))), 6).alias(c) for c in columns]
    gaps = [F.count_if(gap(c)) for c in columns]
    return df.agg(*means, (F.count(F.lit(1)) - (F.greatest(*gaps) if len(gaps) > 1 else gaps[0])).alias("n_evaluated"))
