"""Candidate retrieval strategies and the four question pipelines, each over a whole table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.functions import text as X
from skein.operators import chunking as C, graph as G, grouping as P, links as L, search as S
from skein.plans.providers import CoverageReranker, Embedder, HashEmbedder, Reranker


def broad_candidates(queries: DataFrame, chunks: DataFrame, k: int = 15, top: int = 5, threshold: float = 0.5, reranker: Reranker | None = None) -> DataFrame:
    """(source_path, source_content, target_path, target_content, vector_distance, reranker_score) by vector search, rerank and grouping by file.

    queries (query_id, file_path, text, vector). k + 1 neighbours make up for one hit of the own file, then hits of
    the own file go; repeated texts keep their best hit; reranked hits of a file become one candidate.
    """
    reranker = reranker or CoverageReranker()
    near = S.knn(queries.select("query_id", "vector", F.lit(0).alias("grp")), chunks.select(F.col("chunk_id").alias("item_id"), "vector", F.lit(1).alias("grp")), k + 1)
    hits = near.join(chunks.select(F.col("chunk_id").alias("item_id"), "file_path", "text"), "item_id").join(queries.select("query_id", F.col("file_path").alias("source_path"), F.col("text").alias("source_content")), "query_id")
    hits = S.dedup_by_text(hits.filter("file_path <> source_path"), "query_id", ["rank_no", "item_id"])
    scored = hits.withColumn("score", reranker.score(F.col("source_content"), F.col("text")))
    best = S.rerank(scored.drop("rank_no"), "query_id", "score", ["distance", "item_id"], top, threshold)
    grouped = P.group_by_file(best, "query_id")
    named = grouped.join(queries.select("query_id", F.col("file_path").alias("source_path"), F.col("text").alias("source_content")), "query_id")
    return named.select("source_path", "source_content", F.col("file_path").alias("target_path"), F.col("text").alias("target_content"), F.col("distance").alias("vector_distance"), F.col("score").alias("reranker_score"))


def title_summary_queries(notes: DataFrame) -> DataFrame:
    """(file_path, text): one query for each note from its title and first block."""
    return notes.select(F.concat_ws("/", "vault", "rel_path").alias("file_path"), X.title_summary(F.col("rel_path"), F.col("body")).alias("text"))


def broad_by_summary(queries: DataFrame, chunks: DataFrame, k: int = 15, top: int = 5, threshold: float = 0.5, reranker: Reranker | None = None, embedder: Embedder | None = None) -> DataFrame:
    """broad_candidates with one query for each note (file_path, text), see title_summary_queries, embedded like the chunks (chunk_id, file_path, text).

    Notes are as many as files, so they are searched in blocks against all chunks like any stated set of queries.
    """
    own = embedder or HashEmbedder()
    q = queries.withColumn("query_id", F.xxhash64("file_path")).withColumn("vector", own.vector(F.col("text")))
    return broad_candidates(q, chunks.select("chunk_id", "file_path", "text", own.vector(F.col("text")).alias("vector")), k, top, threshold, reranker)


def strict_candidates(docs: DataFrame, aliases: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Candidates by phrase match: docs (file_path, text) that name an entity (alias, rel_path); the context is the first sentence with it and its neighbours; score 1, distance 0."""
    sents = C.sentence_windows(docs, "file_path", "text", before, after).join(C.sentence_rows(docs, "file_path", "text"), ["file_path", "idx"])
    keyed = sents.withColumn("_k", F.concat_ws("\u0001", "file_path", F.col("idx").cast("string")))
    hits = S.phrase_matches(keyed.select("_k", "sentence"), aliases, "_k", "sentence").join(keyed.select("_k", "file_path", "idx", "window"), "_k")
    first = hits.filter("file_path <> rel_path").groupBy("file_path", "rel_path").agg(F.min_by("window", F.struct("idx", "token_pos")).alias("target_content"))
    return first.join(docs.select("file_path", F.col("text").alias("source_content")), "file_path").select(F.col("file_path").alias("source_path"), "source_content", F.col("rel_path").alias("target_path"), "target_content", F.lit(0.0).alias("vector_distance"), F.lit(1.0).alias("reranker_score"))


def strict_note_candidates(docs: DataFrame, names: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(source_path, target_path, target_content): notes of the own vault that docs (vault, file_path, text) name by a title or alias of names (vault, alias, file_path).

    Phrases are searched once each; then (vault, phrase) leads to all notes of that name, the own note left out. The
    context is that of the first sentence with any name of the note.
    """
    sents = C.sentence_windows(docs, "file_path", "text", before, after).join(C.sentence_rows(docs, "file_path", "text"), ["file_path", "idx"])
    keyed = sents.withColumn("_k", F.concat_ws("\u0001", "file_path", F.col("idx").cast("string")))
    phrases = names.select("alias", F.col("alias").alias("rel_path")).distinct()
    hits = S.phrase_matches(keyed.select("_k", "sentence"), phrases, "_k", "sentence").join(keyed.select("_k", "file_path", "idx", "window"), "_k")
    named = hits.select("file_path", "idx", "token_pos", "window", F.col("rel_path").alias("alias")).join(docs.select("file_path", "vault"), "file_path")
    found = named.join(names.select("vault", "alias", F.col("file_path").alias("target_path")).distinct(), ["vault", "alias"]).filter("file_path <> target_path")
    return found.groupBy(F.col("file_path").alias("source_path"), "target_path").agg(F.min_by("window", F.struct("idx", "token_pos")).alias("target_content"))


def combined_candidates(strict: DataFrame, broad: DataFrame) -> DataFrame:
    return L.union_first_wins(strict, broad, ["source_path", "target_path", "target_content"])


# ---- question pipelines: questions (query_id, question), seeds (query_id, node, rank_no, score) --------------


def search_chunks(questions: DataFrame, chunks: DataFrame, k: int, weight: float = 0.0, embedder: Embedder | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank_no): the k best chunks of each question; weight 1 searches vectors, 0 full text, between them both.

    Questions and chunks that have a column vector are compared by it; else embedder makes the vectors of both from
    their texts. The score of a vector hit is 1 - distance, of a hybrid one the weighted sum of scaled scores.
    """
    if weight <= 0:
        return S.bm25(questions, chunks, "query_id", "question", "chunk_id", "text", k)
    if embedder is not None or "vector" not in questions.columns or "vector" not in chunks.columns:
        own = embedder or HashEmbedder()
        q, c = questions.withColumn("vector", own.vector(F.col("question"))), chunks.withColumn("vector", own.vector(F.col("text")))
    else:
        q, c = questions, chunks
    near = S.knn(q.select("query_id", "vector", F.lit(0).alias("grp")), c.select(F.col("chunk_id").alias("item_id"), "vector", F.lit(1).alias("grp")), k, "cosine").withColumnRenamed("item_id", "chunk_id")
    if weight >= 1:
        return near.select("query_id", "chunk_id", F.round(1 - F.col("distance"), 6).alias("score"), "rank_no")
    hits = S.bm25(questions, chunks, "query_id", "question", "chunk_id", "text", k)
    return S.top_k(S.hybrid(near, hits, weight, "chunk_id"), "query_id", [F.desc("score"), F.asc("chunk_id")], k)


def seed_notes(questions: DataFrame, chunks: DataFrame, k: int = 5, weight: float = 0.0, embedder: Embedder | None = None) -> DataFrame:
    """(query_id, node, rank_no, score): the distinct files of the k best chunks of each question (see search_chunks)."""
    top = search_chunks(questions, chunks, k, weight, embedder).join(chunks.select("chunk_id", "file_path"), "chunk_id")
    return top.groupBy("query_id", F.col("file_path").alias("node")).agg(F.min("rank_no").alias("rank_no"), F.max("score").alias("score"))


def collect_contexts(visited: DataFrame, questions: DataFrame, chunks: DataFrame, top: int = 10, threshold: float = 0.0, reranker: Reranker | None = None) -> DataFrame:
    """(query_id, rank_no, text, score, file_path): the chunks of all visited notes, reranked against the question."""
    reranker = reranker or CoverageReranker()
    rows = visited.select("query_id", F.col("node").alias("file_path")).distinct().join(chunks.select("file_path", "chunk_id", "text"), "file_path").join(questions, "query_id")
    scored = rows.withColumn("score", F.round(reranker.score(F.col("question"), F.col("text")), 6)).select("query_id", "file_path", "chunk_id", "text", "score")
    return S.rerank(scored, "query_id", "score", ["file_path", "chunk_id"], top, threshold)


def run_untyped(questions: DataFrame, chunks: DataFrame, edges: DataFrame, max_hops: int = 2, seed_k: int = 5, top: int = 10, weight: float = 0.0, embedder: Embedder | None = None) -> DataFrame:
    """Seed, breadth-first expansion, prune: contexts of every question. edges (src, dst, relation); weight as in search_chunks."""
    visited = G.bfs(seed_notes(questions, chunks, seed_k, weight, embedder), edges, max_hops)
    return collect_contexts(visited, questions, chunks, top)


def edge_scorer(questions: DataFrame, chunks: DataFrame, reranker: Reranker | None = None):
    """Scores a step by "relation: target. summary" against the question."""
    reranker = reranker or CoverageReranker()
    summaries = C.first_chunks(chunks).select(F.col("file_path").alias("dst"), "summary")

    def score(steps: DataFrame) -> DataFrame:
        text = F.concat("relation", F.lit(": "), X.title_of(F.col("dst")), F.lit(". "), F.coalesce("summary", F.lit("")))
        return steps.join(summaries, "dst", "left").join(questions, "query_id").withColumn("score", reranker.score(F.col("question"), text))

    return score


def run_typed(questions: DataFrame, chunks: DataFrame, edges: DataFrame, max_hops: int = 2, threshold: float = 0.2, seed_k: int = 5, top: int = 10, weight: float = 0.0, embedder: Embedder | None = None) -> DataFrame:
    """As run_untyped, but a step must fit the question by at least threshold."""
    visited = G.bfs_scored(seed_notes(questions, chunks, seed_k, weight, embedder), edges, edge_scorer(questions, chunks), max_hops, threshold)
    return collect_contexts(visited, questions, chunks, top)


def run_single_hop(questions: DataFrame, chunks: DataFrame, links: DataFrame, seed_k: int = 5, top: int = 10, threshold: float = 0.3, expand_k: int = 5, penalty: float = 0.9, weight: float = 0.0, embedder: Embedder | None = None) -> DataFrame:
    """(query_id, rank_no, text, score): reranked seed chunks and the first chunks of notes they link to, as one ranking. links (src, dst, link_ord)."""
    hits = search_chunks(questions, chunks, seed_k, weight, embedder)
    hits = hits.drop("rank_no", "score").join(chunks.select("chunk_id", "file_path", "text"), "chunk_id").join(questions, "query_id")
    scored = hits.withColumn("score", S.coverage(F.col("question"), F.col("text")))
    seeds = S.rerank(scored, "query_id", "score", ["chunk_id"], top, threshold)
    first = C.first_chunks(chunks).select(F.col("file_path").alias("node"), "summary")
    nodes = seeds.groupBy("query_id", F.col("file_path").alias("node")).agg(F.min("rank_no").alias("rank_no"), F.max("score").alias("score"))
    more = G.expand_one_hop(nodes, links, first, expand_k, penalty).join(first, "node")
    return P.merge_ranked(seeds.select("query_id", "text", "score", F.col("rank_no").alias("ord")), more.select("query_id", F.col("summary").alias("text"), "score", F.col("expand_no").alias("ord")))


def entity_seeds(questions: DataFrame, entities: DataFrame, k: int = 10, min_score: int = 1) -> DataFrame:
    """(query_id, node, score, rank_no): the k entities (node, display_name) whose names match most terms of a question, min_score at least.

    Where both sides have a vault, only entities of the question's vault count; they are filtered before the cut.
    """
    own = "vault" in questions.columns and "vault" in entities.columns
    found = S.fulltext(questions, entities, "query_id", "question", "node", "display_name", k, "vault" if own else None)
    return S.top_k(found.filter(F.col("score") >= min_score), "query_id", [F.desc("score"), F.asc("node")], k)


def run_property_graph(questions: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, max_hops: int = 3, seed_k: int = 10, top: int = 10, min_score: int = 1) -> DataFrame:
    """(query_id, text_key, score, text, rank_no): entity seeds by full text, k-hop subgraph, documents by mentions, direct text hits, fused; seeds as entity_seeds.

    entities (node, display_name), mentions (doc = chunk_id, entity), edges (src, dst, relation).
    """
    seeds = entity_seeds(questions, entities, seed_k, min_score).select("query_id", "node")
    kinds, reached = G.shared_neighbourhoods(seeds, edges, max_hops)
    docs = G.documents_of_entities(mentions, reached.withColumnRenamed("kind", "query_id")).select(F.col("query_id").alias("kind"), F.col("doc").alias("chunk_id"), F.col("n").cast("double").alias("score"))
    texts = C.with_next_text(chunks, "file_path", "chunk_index", "text", "chunk_id").select("chunk_id", F.col("text_next").alias("text"))
    by_entity = kinds.join(S.top_k(docs, "kind", [F.desc("score"), F.asc("chunk_id")], top), "kind").select("query_id", "chunk_id", "score", "rank_no")
    direct = S.bm25(questions, chunks, "query_id", "question", "chunk_id", "text", top)
    branches = by_entity.select("query_id", F.lit(0).alias("branch"), F.col("rank_no").alias("ord"), "chunk_id", "score").unionByName(direct.select("query_id", F.lit(1).alias("branch"), F.col("rank_no").alias("ord"), "chunk_id", "score"))
    fused = S.max_norm_fusion(branches.join(texts, "chunk_id"))
    return S.top_k(fused, "query_id", [F.desc("score"), F.asc("text_key")], top)


def answers(contexts: DataFrame) -> DataFrame:
    """(query_id, answer): the default generator over ranked contexts."""
    rows = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "text"))).alias("_c"))
    return rows.select("query_id", X.join_contexts(F.slice(F.col("_c.text"), 1, 3)).alias("answer"))
