"""The registered queries over the reference's own operators, each on whole tables.

Searches take as queries the questions or chunks whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.functions import text as X
from skein.operators import chunking as C, evaluation as E, graph as G, grouping as P, links as L, search as S
from skein.plans import pipelines as R, sql, sql_sources
from skein.session import table
from skein.streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL | sql_sources.ORACLE_SQL


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register f under its name; f gets a function that loads a table."""
    QUERIES[f.__name__] = lambda spark, d: f(lambda name: table(spark, d, name))
    return f


def _path(vault: str = "vault", rel: str = "rel_path"):
    return F.concat(F.col(vault), F.lit("/"), F.col(rel))


def _edges(t) -> DataFrame:
    """(src, dst, relation, link_ord) between file paths."""
    e = L.resolve_edges(L.note_edges(t("notes")), t("notes"))
    return e.select(_path("vault", "src_path").alias("src"), _path("vault", "dst_path").alias("dst"), "relation", "link_ord")


def _questions(t) -> DataFrame:
    return t("qa").filter("qa_id % 20 = 0").select(F.col("qa_id").alias("query_id"), "question")


def _seeds(t) -> DataFrame:
    """(query_id, node, rank_no, score): the notes that a question names as relevant, in order."""
    docs = t("qa").filter("relevant_docs IS NOT NULL").select(F.col("qa_id").alias("query_id"), "vault", F.posexplode("relevant_docs").alias("_i", "stem"))
    named = docs.join(L.first_paths(t("notes")), ["vault", "stem"])
    return named.groupBy("query_id", _path("vault", "dst_path").alias("node")).agg((F.min("_i") + 1).alias("rank_no"), (F.lit(1.0) / (F.min("_i") + 1)).alias("score"))


# ---- text ------------------------------------------------------------------------------------------------


@query
def note_split(t):
    body, links = X.note_body(F.col("content")), X.note_links(F.col("content"))
    return t("notes").select("vault", "rel_path", F.md5(body).alias("body_md5"), F.md5(links).alias("links_md5"), F.md5(X.cut_at(F.col("content"))).alias("cut_md5"))


@query
def content_hash(t):
    return t("notes").select("vault", "rel_path", X.content_hash(F.col("content")).alias("sha"))


@query
def clean_text(t):
    return t("notes").select("vault", "rel_path", X.clean_for_model(F.col("content")).alias("clean"))


@query
def normalize_names(t):
    s = F.col("stem")
    return t("notes").select("vault", "rel_path", X.node_id(s).alias("node"), X.camel_label(s).alias("label"), X.entity_key(s).alias("entity"), X.file_name(X.title_of(F.col("rel_path"))).alias("file_name"), X.alias_key(s).alias("alias"))


@query
def strip_sections(t):
    return t("documents").select("doc_id", X.strip_stop_sections(X.clean_wiki(F.col("text"))).alias("clean"))


@query
def title_summary(t):
    return t("notes").select("vault", "rel_path", X.title_summary(F.col("rel_path"), F.col("body")).alias("query"))


@query
def query_strings(t):
    return t("qa").select("qa_id", X.query_string(F.col("question")).alias("q"))


@query
def lemma_texts(t):
    return t("chunks").select("chunk_id", X.lemma_text(F.col("text")).alias("lemmas"))


@query
def prompt_items(t):
    g = P.group_pairs(t("candidates"))
    return g.select("source_path", "target_path", X.prompt_item(F.lit(1), F.col("source_path"), F.coalesce("target_path", F.lit("")), F.col("contexts")).alias("item"))


# ---- chunks ----------------------------------------------------------------------------------------------


@query
def line_chunks(t):
    return C.sentence_rows(t("documents"), "doc_id", "text")


@query
def sentence_window(t):
    return C.sentence_windows(t("documents"), "doc_id", "text")


@query
def fixed_chunks(t):
    return C.fixed_chunks(t("documents"), "doc_id", "text", 1000, 100)


@query
def recursive_chunks(t):
    return C.recursive_chunks(t("documents"), "doc_id", "text")


@query
def latest_chunks(t):
    return C.latest_chunks(t("chunks")).select("file_path", "chunk_index", "chunk_id")


@query
def first_chunk_summary(t):
    return C.first_chunks(t("chunks"))


@query
def next_chunk(t):
    rows = C.with_next_text(C.latest_chunks(t("chunks")), "file_path", "chunk_index", "text")
    return rows.select("chunk_id", "text_next")


@query
def prev_chunk(t):
    return C.chunk_ids(C.latest_chunks(t("chunks")), "file_path", "chunk_index").select("chunk_key", "previous_key")


@query
def next_chunk_edges(t):
    return C.next_chunk_edges(C.latest_chunks(t("chunks")), "file_path", "chunk_index")


@query
def chunk_batches(t):
    return C.batches(t("chunks"), "file_path", "chunk_id", 5).select("chunk_id", "batch_no")


# ---- links -----------------------------------------------------------------------------------------------


@query
def extract_links(t):
    return L.note_edges(t("notes"))


@query
def extract_wikilinks(t):
    return L.note_wikilinks(t("notes"))


@query
def resolve_links(t):
    return L.resolve_edges(L.note_edges(t("notes")), t("notes"))


@query
def dangling_links(t):
    return L.dangling_edges(L.note_edges(t("notes")), t("notes")).select("vault", "src_path", "relation", "target_name", "link_ord")


def _predictions(t) -> DataFrame:
    return t("gold").select(_path("sample_name", "source_file").alias("source_path"), F.concat("entity", F.lit(".md")).alias("target_path"), F.col("link_type").alias("relation_type"))


@query
def links_by_note(t):
    return L.links_by_note(_predictions(t)).select("source_path", F.array_join("links", "\n").alias("lines"))


@query
def link_upsert(t):
    return L.upsert_links(t("notes").select("vault", "rel_path", "content"), L.links_by_note(_predictions(t)))


@query
def backfill_types(t):
    known = t("gold").filter("link_type IS NOT NULL").groupBy(_path("sample_name", "source_file").alias("source_path"), F.col("entity")).agg(F.max("link_type").alias("relation_type"))
    notes = t("notes").select("vault", F.col("stem").alias("entity"), F.col("rel_path"))
    pred = known.withColumn("vault", F.substring_index("source_path", "/", 1)).join(notes, ["vault", "entity"]).select("source_path", _path().alias("target_path"), "relation_type", F.lit("gold").alias("reasoning"))
    return L.backfill_types(t("candidates").select("pair_id", "source_path", "target_path"), pred).select("pair_id", "llm_type", "llm_reasoning")


@query
def strict_broad_union(t):
    c = t("candidates").select("source_path", "target_path", "target_content", F.when(~F.isnan("vector_distance"), F.col("vector_distance")).alias("d"), "pair_id")
    return L.union_first_wins(c.filter("d = 0"), c.filter("d IS NULL OR d <> 0"), ["source_path", "target_path", "target_content"]).select("source_path", "target_path", "target_content", "d")


# ---- dictionary and phrases --------------------------------------------------------------------------------


def _aliases(t) -> DataFrame:
    """(alias, rel_path): what a note's stem says behind its two coined words; equal phrases are one entity."""
    a = t("notes").select(X.alias_key(F.regexp_extract("stem", r"^[^_]+_[^_]+_(.+)$", 1)).alias("alias")).filter("alias <> ''").distinct()
    return a.withColumn("rel_path", F.col("alias"))


@query
def alias_dictionary(t):
    e = t("notes").select("rel_path", X.title_of(F.col("rel_path")).alias("title"), F.array(F.regexp_extract("stem", r"^[^_]+_[^_]+_(.+)$", 1)).alias("aliases"))
    return C.alias_map(e).select("alias", F.array_join("paths", "|").alias("paths"))


@query
def phrase_join(t):
    return S.phrase_matches(t("chunks").select(F.col("chunk_id").cast("string").alias("chunk"), "text"), _aliases(t), "chunk", "text").select("chunk", F.col("rel_path").alias("alias"), "token_pos")


@query
def strict_retrieval(t):
    docs = t("notes").filter("body IS NOT NULL").select(_path().alias("file_path"), F.col("body").alias("text"))
    return R.strict_candidates(docs, _aliases(t)).select("source_path", "target_path", "target_content", "reranker_score")


def _names(t) -> DataFrame:
    """(vault, alias, file_path): titles, stems and the phrases behind the coined words, with every note of that name."""
    name = F.explode(F.array(X.title_of(F.col("rel_path")), F.col("stem"), F.regexp_extract("stem", r"^[^_]+_[^_]+_(.+)$", 1)))
    n = t("notes").select("vault", _path().alias("file_path"), name.alias("name"))
    return n.select("vault", X.alias_key(F.col("name")).alias("alias"), "file_path").filter("alias <> ''").distinct()


@query
def phrase_notes(t):
    return _names(t)


@query
def strict_note_retrieval(t):
    docs = t("notes").filter("body IS NOT NULL").select("vault", _path().alias("file_path"), F.col("body").alias("text"))
    return R.strict_note_candidates(docs, _names(t))


@query
def proximity_match(t):
    p = X.phrase_lemmas(F.regexp_extract("entity", r"^[^_]+_[^_]+_(.+)$", 1))
    rows = t("gold").select("gold_id", X.tokens(F.coalesce("sentence", F.lit(""))).alias("s"), p.alias("p"))
    return rows.select("gold_id", S.within_span(F.col("s"), F.col("p.lemmas"), F.col("p.head")).alias("hit"))


# ---- search ----------------------------------------------------------------------------------------------


@query
def bm25_topk(t):
    return S.bm25(_questions(t), t("chunks"), "query_id", "question", "chunk_id", "text", 10)


@query
def fulltext_or_fuzzy(t):
    return S.top_k(S.fulltext(_questions(t), t("chunks"), "query_id", "question", "chunk_id", "text", 10), "query_id", [F.desc("score"), F.asc("chunk_id")], 10)


def _vectors(t) -> DataFrame:
    usable = "vector IS NOT NULL AND size(vector) = 64 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30)"
    return t("chunks").filter(usable)


def _knn(t, metric: str) -> DataFrame:
    v = _vectors(t)
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector", F.col("file_path").alias("grp"))
    return S.knn(q, v.select(F.col("chunk_id").alias("item_id"), "vector", F.col("file_path").alias("grp")), 10, metric)


@query
def knn_topk(t):
    return _knn(t, "l2").select("query_id", "item_id", "rank_no")


@query
def knn_threshold(t):
    return _knn(t, "cosine").filter("distance <= 0.2").select("query_id", "item_id", "rank_no")


@query
def hybrid_fusion(t):
    q = _vectors(t).filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("question"))
    hits = S.bm25(q, t("chunks"), "query_id", "question", "chunk_id", "text", 10)
    near = _knn(t, "cosine").withColumnRenamed("item_id", "chunk_id")
    return S.hybrid(near, hits, 0.6, "chunk_id")


@query
def maxnorm_fusion(t):
    h = t("search_hits")
    near = h.select("query_id", F.lit(0).alias("branch"), F.col("hit_id").alias("ord"), "text", (1.0 / (1.0 + F.col("distance"))).alias("score"))
    place = h.select("query_id", F.lit(1).alias("branch"), F.col("hit_id").alias("ord"), "text", (F.lit(1.0) / F.col("rank_no")).alias("score"))
    return S.max_norm_fusion(near.unionByName(place))


@query
def rerank_hits(t):
    h = t("search_hits").join(t("qa").select(F.col("qa_id").alias("query_id"), "question"), "query_id")
    scored = h.withColumn("score", F.round(S.coverage(F.col("question"), F.coalesce("text", F.lit(""))), 6)).drop("rank_no")
    return S.rerank(scored, "query_id", "score", ["hit_id"], 5, 0.1).select("query_id", "hit_id", "score", "rank_no")


@query
def dedup_hits(t):
    return S.dedup_by_text(t("search_hits"), "query_id", ["distance", "hit_id"]).select("query_id", "hit_id")


@query
def best_text_score(t):
    return S.best_by_text(t("search_hits").withColumn("score", F.col("distance")), "query_id")


@query
def text_path_recovery(t):
    h = t("search_hits")
    return S.path_of_text(h.select("query_id", "text").distinct(), h).select("query_id", "text", "file_path")


@query
def group_topn_contexts(t):
    return P.group_pairs(t("candidates")).select("source_path", "target_path", F.array_join("contexts", "\n").alias("contexts"), "n_contexts")


@query
def group_hits_by_file(t):
    h = t("search_hits").filter("file_path IS NOT NULL").withColumn("score", F.lit(1.0) / F.col("rank_no"))
    one = h.groupBy("query_id", "file_path", "rank_no").agg(F.min("text").alias("text"), F.min("distance").alias("distance"), F.max("score").alias("score"))
    return P.group_by_file(one, "query_id").select("query_id", "file_path", "text", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


# ---- graph -----------------------------------------------------------------------------------------------


@query
def bfs_untyped(t):
    return G.bfs(_seeds(t), _edges(t), 2)


@query
def bfs_typed(t):
    q = t("qa").select(F.col("qa_id").alias("query_id"), "question")
    return G.bfs_scored(_seeds(t), _edges(t), R.edge_scorer(q, t("chunks")), 2, 0.2).select("query_id", "node", "depth", F.round("score", 6).alias("score"))


@query
def expand_one_hop(t):
    first = C.first_chunks(t("chunks")).select(F.col("file_path").alias("node"), "summary")
    return G.expand_one_hop(_seeds(t), _edges(t), first)


@query
def khop_undirected(t):
    return G.khop_undirected(_seeds(t), _edges(t), 3)


@query
def note_components(t):
    return G.connected_components(_edges(t).filter("src <> dst").select("src", "dst"))


@query
def entity_documents(t):
    mentions = t("gold").select(F.concat_ws("/", "sample_name", "source_file").alias("doc"), F.concat_ws(":", "sample_name", "entity").alias("entity"))
    seeds = t("qa").select(F.col("qa_id").alias("query_id"), "vault", F.explode("relevant_docs").alias("stem")).select("query_id", F.concat_ws(":", "vault", "stem").alias("node"))
    return G.documents_of_entities(mentions, seeds)


# ---- evaluation --------------------------------------------------------------------------------------------


def _gold_edges(t) -> DataFrame:
    return t("gold").filter("link_type IS NOT NULL").select(F.col("sample_name").alias("vault"), F.col("source_file").alias("rel_path"), F.col("link_type").alias("relation"), F.col("entity").alias("target_name"))


def _note_edges(t) -> DataFrame:
    return L.note_edges(t("notes")).withColumnRenamed("src_path", "rel_path")


@query
def edge_prf(t):
    return E.with_prf(E.edge_counts(_gold_edges(t), _note_edges(t), ["vault"]))


@query
def edge_prf_untyped(t):
    return E.with_prf(E.edge_counts(_gold_edges(t), _note_edges(t), ["vault"], use_relation=False))


@query
def prf_rollup(t):
    return E.prf_rollup(E.edge_counts(_gold_edges(t), _note_edges(t), ["vault"], case_sensitive=True), "vault")


def _typed_pairs(t) -> DataFrame:
    predicted = _note_edges(t).groupBy(F.col("vault").alias("sample_name"), F.col("rel_path").alias("source_file"), F.col("target_name").alias("entity")).agg(F.min(F.lower("relation")).alias("predicted_type"))
    return E.gold_groups(t("gold")).join(predicted, ["sample_name", "source_file", "entity"], "left").select("true_type", F.coalesce("predicted_type", F.lit("no link")).alias("predicted_type"))


@query
def class_prf(t):
    return E.with_prf(E.class_counts(_typed_pairs(t)))


@query
def class_averages(t):
    return E.class_averages(E.with_prf(E.class_counts(_typed_pairs(t))))


@query
def gold_groups(t):
    return E.gold_groups(t("gold")).select("sample_name", "source_file", "entity", "true_type", F.array_join("sentences", "\n").alias("sentences"))


@query
def sentence_ranking(t):
    rows = t("gold").withColumn("score", F.length("sentence").cast("double"))
    return E.rank_sentences(rows, ["sample_name", "source_file", "entity"], 5).select("gold_id", "rank_no")


@query
def fuzzy_match(t):
    gold = t("gold").select("sample_name", F.col("gold_id").alias("row_id"), "source_file", "entity", F.coalesce("sentence", F.lit("")).alias("sentence"))
    c = t("candidates").filter("target_path IS NOT NULL AND target_content IS NOT NULL")
    stem = F.regexp_replace(F.substring_index("target_path", "/", -1), r"\.md$", "")
    pred = c.select(F.col("vault").alias("sample_name"), F.substring(F.col("source_path"), F.length("vault") + 2, F.length("source_path")).alias("source_file"), stem.alias("entity"), F.col("target_content").alias("sentence"))
    return E.with_prf(E.retrieval_counts(gold, pred, "sample_name"))


@query
def nan_mean(t):
    return E.nan_means(t("candidates"), ["vector_distance", "reranker_score"])


@query
def qa_reference_contexts(t):
    docs = t("qa").select("qa_id", "vault", F.posexplode("relevant_docs").alias("ord", "stem")).join(t("notes").select("vault", "stem", X.reference_text(F.col("content")).alias("text")), ["vault", "stem"]).filter("text <> ''")
    rows = docs.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_c"))
    return t("qa").select("qa_id").join(rows, "qa_id", "left").select("qa_id", X.join_contexts(F.col("_c.text")).alias("contexts"))


# ---- incremental -------------------------------------------------------------------------------------------


def _files(t) -> DataFrame:
    return t("notes").select(_path().alias("file_path"), F.md5("content").alias("hash"))


@query
def content_hash_changes(t):
    return I.changes(_files(t), t("chunks").select("file_path", F.col("file_hash").alias("hash"), "indexed_at", "chunk_id"))


@query
def chunk_cache(t):
    return I.cached(t("chunks"), _files(t)).select("chunk_id")


@query
def resume_anti_join(t):
    done = t("gold").filter("link_type IS NOT NULL").select(_path("sample_name", "source_file").alias("file_path"))
    return P.pending(t("notes").select(_path().alias("file_path")), done, ["file_path"])


@query
def corpus_counts(t):
    return E.corpus_counts(t("candidates"), "vault", "n_pairs", n_sources="source_path")


# ---- pipelines -------------------------------------------------------


@query
def pipeline_untyped(t):
    return R.run_untyped(_questions(t), t("chunks"), _edges(t)).select("query_id", "rank_no", "text", "score")


@query
def pipeline_typed(t):
    return R.run_typed(_questions(t), t("chunks"), _edges(t)).select("query_id", "rank_no", "text", "score")


@query
def pipeline_single_hop(t):
    return R.run_single_hop(_questions(t), t("chunks"), _edges(t)).select("query_id", "rank_no", "text", F.round("score", 6).alias("score"))


@query
def pipeline_property_graph(t):
    a = _aliases(t)
    mentions = S.phrase_matches(t("chunks").select(F.col("chunk_id").cast("string").alias("chunk"), "text"), a, "chunk", "text").select(F.col("chunk").cast("long").alias("doc"), F.col("rel_path").alias("entity"))
    short = lambda c: X.alias_key(F.regexp_extract(X.title_of(F.col(c)), r"^\S+ \S+ (.+)$", 1))
    edges = _edges(t).select(short("src").alias("src"), short("dst").alias("dst"), "relation").filter("src <> '' AND dst <> ''").distinct()
    return R.run_property_graph(_questions(t), t("chunks"), a.select(F.col("alias").alias("node"), F.col("alias").alias("display_name")), mentions, edges, max_hops=3).select("query_id", "rank_no", "text_key", "score")


@query
def broad_retrieval(t):
    v = _vectors(t)
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "file_path", "text", "vector")
    return R.broad_candidates(q, v).select("source_path", "target_path", "target_content", F.round("vector_distance", 6).alias("vector_distance"), F.round("reranker_score", 6).alias("reranker_score"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ranked contexts of the questions by the untyped pipeline."""
    return QUERIES["pipeline_untyped"](spark, d)


from skein.plans import catalog_sources as catalog_sources  # noqa: E402  registers its queries with query()
