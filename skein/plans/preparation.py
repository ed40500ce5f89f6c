"""Preparing link data: page fetching, title filters, link contexts, resumable classification, configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window as W, functions as F

from skein.functions import text as X
from skein.operators import chunking as C, grouping as P, links as L, search as S
from skein.plans.providers import Classifier, CoverageReranker, Lemmatizer, Reranker, TokenLemmatizer, retrying
from skein.session import path_exists
from skein.sources.sinks import append_done
from skein.sources.vault import VaultConfig


def fetch_pages(titles: DataFrame, fetch: Callable[[str], dict | None], retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """(title, summary, text, links) of pages (title), fetched inside the tasks; a page that fails every retry is dropped.

    fetch(title) returns a mapping with summary, text and links, or None where there is no such page.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for title in pdf["title"]:
                try:
                    page = retrying(lambda: fetch(title), retries, backoff, every=True)
                except Exception:
                    continue
                if page:
                    rows.append((title, page.get("summary"), page.get("text"), list(page.get("links") or [])))
            yield pd.DataFrame(rows, columns=["title", "summary", "text", "links"])

    return titles.select("title").distinct().mapInPandas(run, "title string, summary string, text string, links array<string>")


def crawl_candidates(topic: str, pages: DataFrame, visited: DataFrame, limit: int = 100, min_score: float = 0.1, reranker: Reranker | None = None) -> DataFrame:
    """(title, score): the first `limit` unvisited outlinks (title, summary, ord) outside namespaces, scored by "title: summary" (500 characters) against the topic; only scores above min_score."""
    reranker = reranker or CoverageReranker()
    fresh = pages.filter(~F.col("title").contains(":")).join(visited.select("title").distinct(), "title", "left_anti")
    first = fresh.groupBy("title").agg(F.min_by("summary", "ord").alias("summary"), F.min("ord").alias("ord")).orderBy("ord", "title").limit(limit)
    text = F.concat("title", F.lit(": "), F.substring(F.coalesce("summary", F.lit("")), 1, 500))
    return first.select("title", reranker.score(F.lit(topic), text).alias("score")).filter(F.col("score") > min_score)


def sentences_of_titles(pages: DataFrame, titles: DataFrame, lemmatizer: Lemmatizer | None = None) -> DataFrame:
    """(page, title, idx, sentence, lemmas): sentences of a page (page, text) that hold a linked title (page, title) within a short span; both are compared by their lemmas."""
    lemmatizer = lemmatizer or TokenLemmatizer()
    cut = pages.select("page", X.strip_stop_sections(F.col("text")).alias("text"))
    sents = C.sentence_rows(cut, "page", "text").withColumn("lemmas", lemmatizer.lemmas(F.col("sentence")))
    phrase = titles.select("page", "title", X.phrase_of(lemmatizer.lemmas(X.spaced(F.col("title")))).alias("_p")).distinct()
    hit = S.within_span(F.col("lemmas"), F.col("_p.lemmas"), F.col("_p.head"))
    return sents.join(phrase, "page").filter(hit).select("page", "title", "idx", "sentence", "lemmas")


def titles_in_text(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """The titles (page, title) that some sentence of their page holds."""
    return titles.join(sentences_of_titles(pages, titles).select("page", "title").distinct(), ["page", "title"], "left_semi")


def link_contexts(pages: DataFrame, titles: DataFrame, top: int = 5, threshold: float = 0.0, reranker: Reranker | None = None, scored: bool = True) -> DataFrame:
    """(page, title, rank_no, sentence, score): up to `top` distinct sentences for each link, best score first, then in text order.

    scored=False leaves the sentences unscored: then the first ones in text order count, and score is null.
    """
    if not scored:
        once = sentences_of_titles(pages, titles).groupBy("page", "title", "sentence").agg(F.min("idx").alias("idx"))
        first = F.row_number().over(W.partitionBy("page", "title").orderBy("idx"))
        return once.withColumn("rank_no", first).filter(F.col("rank_no") <= top).select("page", "title", "rank_no", "sentence", F.lit(None).cast("double").alias("score"))
    reranker = reranker or CoverageReranker()
    hits = sentences_of_titles(pages, titles).withColumn("score", reranker.score(X.spaced(F.col("title")), F.col("sentence"))).filter(F.col("score") >= threshold)
    once = hits.groupBy("page", "title", "sentence").agg(F.max("score").alias("score"), F.min("idx").alias("idx"))
    rank = F.row_number().over(W.partitionBy("page", "title").orderBy(F.desc("score"), "idx"))
    return once.withColumn("rank_no", rank).filter(F.col("rank_no") <= top).select("page", "title", "rank_no", "sentence", "score")


def classify_pending(pairs: DataFrame, done_path: str, classifier: Classifier) -> DataFrame:
    """Type the grouped pairs (source_path, target_path, contexts) not yet in the checkpoint table, append them, and return all predictions.

    A run that is started again does only what is missing; rows a classifier leaves out stay pending.
    """
    spark = pairs.sparkSession
    keys = ["source_path", "target_path"]
    schema = "source_path string, target_path string, relation_type string, reasoning string"

    def done() -> DataFrame:
        return spark.read.schema(schema).parquet(done_path) if path_exists(spark, done_path) else spark.createDataFrame([], schema)

    append_done(classifier.classify(P.pending(pairs, done(), keys)).select("source_path", "target_path", "relation_type", "reasoning"), done_path)
    return done().dropDuplicates(keys)


def build_links(candidates: DataFrame, done_path: str, classifier: Classifier, n: int = 5) -> DataFrame:
    """(source_path, links): candidates grouped, typed and rendered as sorted link lines."""
    return L.links_by_note(classify_pending(P.group_pairs(candidates, n), done_path, classifier))


def effective_config(saved: VaultConfig | None, fresh: bool = False, **overrides) -> VaultConfig:
    """Defaults on a fresh start, the saved snapshot otherwise; options that were given win over either."""
    base = VaultConfig() if fresh or saved is None else saved
    return replace(base, **{k: v for k, v in overrides.items() if v is not None})


def context_recall(contexts: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, recall): share of the reference's lemmas (query_id, reference) that the retrieved contexts (query_id, text) hold. An overlap figure, no judged score."""
    held = contexts.select("query_id", F.explode(X.lemma_set(F.col("text"))).alias("w")).distinct()
    want = references.select("query_id", F.explode(X.lemma_set(F.col("reference"))).alias("w")).distinct()
    both = want.join(held.withColumn("_h", F.lit(1)), ["query_id", "w"], "left").groupBy("query_id").agg((F.count("_h") / F.count(F.lit(1))).alias("recall"))
    return references.select("query_id").distinct().join(both, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def evaluate_answers(contexts: DataFrame, references: DataFrame, n_contexts: int = 3) -> DataFrame:
    """(query_id, n_contexts, context_recall, context_precision, faithfulness, correctness): the figures of every question, set at once.

    contexts (query_id, rank_no, text), references (query_id, question, reference). The answer is made of the first n_contexts
    contexts. Overlap figures over lemma sets stand in for judged ones: the share of the reference that the contexts hold,
    the share of contexts that hold three of its lemmas (all, if it has fewer), the share of the answer that the contexts hold, and the F1 of answer and reference. A question that fails (no reference or
    no context) is dropped, as a failed item is.
    """
    c = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "text"))).alias("_c")).select("query_id", F.col("_c.text").alias("texts"))
    rows = references.filter("reference IS NOT NULL").join(c, "query_id")
    sets = rows.select("query_id", F.size("texts").alias("n_contexts"), X.lemma_set(F.col("reference")).alias("r"), F.transform("texts", X.lemma_set).alias("t"), X.lemma_set(F.array_join(F.slice("texts", 1, n_contexts), " ")).alias("a"))
    sets = sets.withColumn("all", F.array_distinct(F.flatten("t"))).filter("size(r) > 0")
    share = lambda x, y: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0)
    useful = F.size(F.filter("t", lambda s: F.size(F.array_intersect("r", s)) >= F.least(F.lit(3), F.size("r"))))
    p, r = share("a", "r"), share("r", "a")
    return sets.select(
        "query_id", "n_contexts", F.round(share("r", "all"), 6).alias("context_recall"), F.round(useful / F.col("n_contexts"), 6).alias("context_precision"),
        F.round(share("a", "all"), 6).alias("faithfulness"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("correctness"),
    )
