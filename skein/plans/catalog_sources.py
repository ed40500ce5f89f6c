"""Registered queries over sources, sinks, model outputs, link preparation and re-indexing, each on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from skein.functions import text as X
from skein.operators import chunking as C, evaluation as E, graph as G, grouping as P, links as L, search as S
from skein.plans import pipelines as R, preparation as Q, providers as M
from skein.plans.catalog import _edges, _gold_edges, _note_edges, _path, _predictions, _questions, _seeds, query
from skein.session import shared_folder
from skein.sources import sinks, vault as V
from skein.streaming import incremental as I


def _folder(df: DataFrame, name: str) -> str:
    """A new folder in the shared one, for queries that write and read back."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    """The same folder as the executors' file functions see it."""
    return path.removeprefix("file:") if path.startswith("file:") else path


# ---- sources and sinks -----------------------------------------------------------------------------------


@query
def scan_roundtrip(t):
    """Notes written as files by the executors and scanned again; an ignored folder beside them is left out."""
    notes = t("notes").select("vault", "rel_path", "content")
    root = _local(_folder(notes, "vaults"))
    ignored = notes.select("vault", F.concat(F.lit(".trash/"), "rel_path").alias("rel_path"), "content")
    sinks.write_notes(notes.unionByName(ignored), root)
    return V.scan_notes(notes.sparkSession, root).select("vault", "rel_path", "stem", F.sha2("content", 256).alias("sha"), "content_hash", F.md5("links_section").alias("links_md5"))


@query
def loaded_documents(t):
    return V.load_documents(t("notes")).select("source", "source_rel", "vault", F.md5("text").alias("text_md5"))


@query
def front_matter_aliases(t):
    """Titles and aliases of notes with front matter of each of its forms, chosen by the length of the stem."""
    stem, form = F.col("stem"), F.length("stem") % 4
    block = F.when(form == 0, F.concat(F.lit("aliases: "), stem, F.lit(", old name"))).when(form == 1, F.concat(F.lit("aliases: ['"), stem, F.lit("', \"old name\", ]"))).when(form == 2, F.concat(F.lit("tags: x\naliases:\n  - "), stem, F.lit("\n  - old name"))).otherwise(F.concat(F.lit("aliases: ["), stem))
    notes = t("notes").withColumn("content", F.concat(F.lit("---\n"), block, F.lit("\n---\n"), "content"))
    return V.entities(notes).select("rel_path", "title", F.array_join("aliases", "|").alias("aliases"))


@query
def settings(t):
    return V.with_defaults(t("vault_config"))


@query
def gold_as_json(t):
    """Gold rows written as JSON lines and read with their schema."""
    gold = t("gold")
    path = _folder(gold, "gold")
    gold.select("gold_id", "entity", "source_file", "sentence", "is_direct_mention", "link_type").write.json(path)
    return V.read_json(gold.sparkSession, path, "gold_id long, " + V.GOLD_SCHEMA, lines=True)


@query
def links_as_json(t):
    """Link lines saved as JSON, a source with its lines each, and read back."""
    links = L.links_by_note(_predictions(t))
    path = _folder(links, "links")
    sinks.save_links(t("notes"), links, "json", path)
    return V.read_json(links.sparkSession, path, "source_path string, links array<string>", lines=True).select("source_path", F.array_join("links", "\n").alias("lines"))


@query
def enriched_export(t):
    """An enriched copy of the vaults: old generated links cleared, new ones merged in, scanned again."""
    notes = t("notes").select("vault", "rel_path", "content")
    path = _local(_folder(notes, "export"))
    sinks.save_links(notes, L.links_by_note(_predictions(t)), "export", path)
    return V.scan_notes(notes.sparkSession, path).select("vault", "rel_path", F.md5("content").alias("content_md5"))


@query
def cleared_links(t):
    return L.clear_links(t("notes")).select("vault", "rel_path", F.md5("content").alias("content_md5"))


@query
def index_upkeep(t):
    """The chunk index after the notes with the most chunks were replaced by their first chunk."""
    chunks = t("chunks").select("file_path", "chunk_id", "text")
    changed = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("chunk_id")).filter("n > 4")
    fresh = changed.join(chunks.select("chunk_id", "text"), "chunk_id").select("file_path", F.col("chunk_id"), F.col("text"))
    return sinks.replace_files(chunks, changed, fresh).select("file_path", "chunk_id")


@query
def candidate_dump(t):
    """Candidates as found and as reranked, dumped and read back."""
    found = t("candidates").select("pair_id", "source_path", "reranker_score")
    path = _folder(found, "dump")
    sinks.dump_candidates(found, found.filter("reranker_score >= 0.5 AND NOT isnan(reranker_score)"), path)
    read = lambda stage: found.sparkSession.read.schema("pair_id long, source_path string").json(f"{path}/{stage}").withColumn("stage", F.lit(stage))
    return read("before").unionByName(read("after"))


@query
def predictions_by_strategy(t):
    """Predictions written in a folder for each strategy and counted there."""
    c = t("candidates").filter("target_path IS NOT NULL").select(F.when(F.col("vector_distance") == 0, F.lit("strict")).otherwise(F.lit("broad")).alias("strategy"), "source_path", "target_path")
    path = _folder(c, "predictions")
    sinks.write_by_strategy(c, path)
    back = c.sparkSession.read.schema("source_path string, target_path string, strategy string").json(path)
    return back.groupBy("strategy", "source_path").agg(F.count(F.lit(1)).alias("n"))


@query
def checkpoint_resume(t):
    """Pairs that a checkpoint table, appended to twice, doesn't hold yet."""
    pairs = t("candidates").select("source_path", "target_path").filter("target_path IS NOT NULL").distinct()
    done = t("gold").select(_path("sample_name", "source_file").alias("source_path"), F.concat("sample_name", F.lit("/"), "entity", F.lit(".md")).alias("target_path"), "link_type")
    path = _folder(pairs, "done")
    for part in (done.filter("link_type IS NOT NULL"), done.filter("link_type IS NULL")):
        sinks.append_done(part.select("source_path", "target_path").filter("source_path IS NOT NULL AND target_path IS NOT NULL"), path)
    return P.pending(pairs, pairs.sparkSession.read.parquet(path), ["source_path", "target_path"])


@query
def graph_merge(t):
    """A graph written from the gold entities and merged with that of the notes."""
    gold = t("gold").filter("entity IS NOT NULL").select(F.concat_ws(":", "sample_name", X.node_id(F.col("entity"))).alias("id"), F.lit("Entity").alias("type"), F.lit("gold").alias("origin")).distinct()
    notes = t("notes").select(F.concat_ws(":", "vault", X.node_id(F.col("stem"))).alias("id"), F.lit("Note").alias("type"), F.lit("notes").alias("origin")).distinct()
    rels = t("gold").filter("link_type IS NOT NULL AND entity IS NOT NULL").select(_path("sample_name", "source_file").alias("src_id"), F.concat_ws(":", "sample_name", X.node_id(F.col("entity"))).alias("dst_id"), F.lower("link_type").alias("type"))
    path = _folder(gold, "graph")
    sinks.upsert_graph(gold, rels, path, wipe=True)
    sinks.upsert_graph(notes, rels, path)
    nodes, edges = sinks.read_graph(gold.sparkSession, path)
    degree = edges.groupBy(F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    return nodes.join(degree, "id", "left").select("id", "type", "origin", F.coalesce("n_in", F.lit(0)).alias("n_in"))


# ---- text of links and of model outputs ------------------------------------------------------------------


@query
def typed_links_anywhere(t):
    rows = t("notes").filter("content IS NOT NULL").select("vault", "rel_path", F.posexplode(X.typed_links(F.col("content"))).alias("link_no", "_l"))
    return rows.select("vault", "rel_path", "link_no", "_l.relation", "_l.target")


@query
def link_labels(t):
    """Targets of links with labels: each link of a note's section with its relation as label, taken apart again."""
    both = t("notes").filter("links_section IS NOT NULL").select("vault", "rel_path", F.posexplode(X.line_links(F.col("links_section"))).alias("link_no", "_l"))
    target = F.when(F.col("link_no") % 2 == 0, F.concat("_l.target", F.lit("|"), "_l.relation")).otherwise(F.col("_l.target"))
    return both.select("vault", "rel_path", "link_no", X.split_label(target).alias("_s")).select("vault", "rel_path", "link_no", "_s.name", "_s.label")


@query
def pair_keys(t):
    return t("candidates").select("pair_id", X.pair_key(F.col("source_path"), F.col("target_path"), F.col("target_content")).alias("pair_key"))


@query
def plain_file_names(t):
    return t("notes").select("vault", "rel_path", X.file_name(F.concat(F.lit(" "), X.title_of(F.col("rel_path")), F.lit("'s \"log\"/1 ")), False).alias("name"))


@query
def answers_parsed(t):
    """Model outputs around each answer, in the forms they come in, and the answer read from them."""
    a, form = F.coalesce("answer", F.lit("")), F.length(F.coalesce("question", F.lit(""))) % 3
    raw = F.when(form == 0, F.concat(F.lit("<reasoning>because <b>"), "question", F.lit("</reasoning>\n<answer> "), a, F.lit(" </answer> bye"))).when(form == 1, F.concat(F.lit("<reasoning>open\n<answer>no</answer></reasoning> <ANSWER>"), a)).otherwise(F.concat(F.lit("<REASONING>x</reasoning>\n "), a, F.lit("\n")))
    return t("qa").filter("question IS NOT NULL").select("qa_id", X.parse_answer(raw).alias("answer"))


@query
def outputs_parsed(t):
    """Typed answers of a model as JSON: a list, an object by number, fenced or behind a thinking block; read leniently."""
    g = t("gold").select("gold_id", "link_type")
    one = F.format_string('{"id": 0, "relation_type": %s, "reasoning": "row %d"}', F.when(F.col("link_type").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.upper("link_type"), F.lit('"'))), F.col("gold_id"))
    form = F.col("gold_id") % 4
    raw = F.when(form == 0, F.concat(F.lit("["), one, F.lit("]"))).when(form == 1, F.concat(F.lit('```json\n{"thinking": "hm", "0": '), one, F.lit("}\n```"))).when(form == 2, F.concat(F.lit("<think>[1]</think>Here: {\"items\": ["), one, F.lit("]}"))).otherwise(F.concat(F.lit("["), one, F.lit(', {"id": 1, "relation_type": "cut of')))
    rows = g.select("gold_id", F.explode(X.lenient_json(raw)).alias("_j"))
    return rows.select("gold_id", "_j.id", "_j.relation_type", "_j.reasoning")


@query
def retry_delays(t):
    """Waiting times that error messages ask for, and whether the error is one that passes."""
    d = F.format_string("%.1f", F.col("distance"))
    message = F.when(F.col("rank_no") % 3 == 0, F.concat(F.lit("429 RESOURCE_EXHAUSTED {'retryDelay': '"), d, F.lit("s'}"))).when(F.col("rank_no") % 3 == 1, F.lit("503 UNAVAILABLE")).otherwise(F.concat(F.lit("400 bad value "), d))
    rows = t("search_hits").filter("distance IS NOT NULL AND NOT isnan(distance) AND distance >= 0").select("hit_id", message.alias("m"))
    return rows.select("hit_id", X.retry_delay(F.col("m")).alias("wait"), X.is_transient(F.col("m")).alias("transient"))


# ---- links ----------------------------------------------------------------------------------------------------


@query
def links_rewritten(t):
    typed = t("gold").filter("entity IS NOT NULL").select(F.col("sample_name").alias("vault"), F.col("source_file").alias("src_path"), F.col("link_type").alias("relation"), F.col("entity").alias("target_name"), F.col("gold_id").alias("link_ord"))
    return L.rewrite_links(t("notes"), typed).select("vault", "rel_path", F.md5("content").alias("content_md5"))


def _outlinks(t, ignore_case: bool) -> DataFrame:
    out = L.note_wikilinks(t("notes")).select(_path("vault", "src_path").alias("page"), F.replace(F.col("target_name"), F.lit("_"), F.lit(" ")).alias("title"))
    saved = t("notes").filter("body IS NOT NULL").select(F.replace(F.lower("stem") if ignore_case else F.col("stem"), F.lit("_"), F.lit(" ")).alias("title"))
    return L.keep_saved_outlinks(out, saved, ignore_case)


@query
def saved_outlinks(t):
    return _outlinks(t, False)


@query
def saved_outlinks_ignoring_case(t):
    return _outlinks(t, True)


@query
def claimed_relations(t):
    """Note links with the relations claimed between the items of their titles; the gold types stand for the claims."""
    links = L.note_edges(t("notes")).select(F.concat_ws(":", "vault", F.regexp_replace(F.substring_index("src_path", "/", -1), r"\.md$", "")).alias("source"), F.concat_ws(":", "vault", "target_name").alias("target")).distinct()
    titles = links.select(F.col("source").alias("title")).unionByName(links.select(F.col("target").alias("title"))).distinct()
    qids = titles.select("title", F.concat(F.lit("Q"), F.md5("title")).alias("qid"))
    g = t("gold").filter("link_type IS NOT NULL AND entity IS NOT NULL")
    item = lambda c: F.concat(F.lit("Q"), F.md5(F.concat_ws(":", "sample_name", c)))
    claims = g.select(item(F.regexp_replace(F.substring_index("source_file", "/", -1), r"\.md$", "")).alias("src_qid"), item(F.col("entity")).alias("tgt_qid"), F.col("link_type").alias("label"))
    return L.claimed_relations(links, qids, claims)


def _pages(t) -> tuple[DataFrame, DataFrame]:
    """(page, text) of notes and (page, title): the entities that gold rows name on them."""
    pages = t("notes").filter("body IS NOT NULL").select(_path().alias("page"), F.col("body").alias("text"))
    titles = t("gold").filter("entity IS NOT NULL AND source_file IS NOT NULL").select(_path("sample_name", "source_file").alias("page"), F.regexp_extract("entity", r"^[^_]+_[^_]+_(.+)$", 1).alias("title")).filter("title <> ''").distinct()
    return pages, titles


@query
def titles_in_text(t):
    return Q.titles_in_text(*_pages(t))


@query
def link_contexts(t):
    return Q.link_contexts(*_pages(t), top=3, threshold=0.5).select("page", "title", "rank_no", F.md5("sentence").alias("sentence_md5"), F.round("score", 6).alias("score"))


@query
def link_contexts_unscored(t):
    return Q.link_contexts(*_pages(t), top=3, scored=False).select("page", "title", "rank_no", F.md5("sentence").alias("sentence_md5"))


@query
def crawl_ranking(t):
    """Outlinks worth a visit: titles of search hits outside namespaces that aren't notes yet, scored against a topic."""
    hits = t("search_hits").filter("file_path IS NOT NULL")
    pages = hits.select(F.when(F.col("rank_no") == 1, F.concat(F.lit("Talk:"), "file_path")).otherwise(F.col("file_path")).alias("title"), F.col("text").alias("summary"), F.col("hit_id").alias("ord"))
    visited = t("notes").filter("body IS NULL").select(_path().alias("title"))
    return Q.crawl_candidates("the old mill and the river wheel", pages, visited, limit=200, min_score=0.1).select("title", F.round("score", 6).alias("score"))


@query
def property_graph_nodes(t):
    """Entities of gold rows as graph nodes: ids prefixed by the vault and in title case, names for display, and their MENTIONS edges."""
    chunks = t("notes").filter("body IS NOT NULL").select(_path().alias("chunk"), "vault", F.col("body").alias("text"))
    aliases = t("notes").select(X.alias_key(F.regexp_extract("stem", r"^[^_]+_[^_]+_(.+)$", 1)).alias("alias"), F.regexp_extract("stem", r"^[^_]+_[^_]+_(.+)$", 1).alias("rel_path")).filter("alias <> ''").distinct()
    nodes, rels = M.extract_triples(chunks, aliases, "chunk", "text")
    n = rels.groupBy(F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("n_mentions"))
    return nodes.join(n, "id").select("id", "vault", "type", "display_name", "n_mentions")


@query
def entity_resolution(t):
    """Entities of one meaning: vectors within a cosine of a query vector (each id divisible by 20), joined to components by their least id."""
    e = t("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    pairs = S.within(e.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector"), e, 0.35)
    groups, _ = G.resolve_entities(pairs.select(F.col("query_id").alias("a"), F.col("item_id").alias("b"), "similarity"), e.select(F.col("item_id").alias("src"), F.col("item_id").alias("dst")), 0.35)
    return groups


@query
def resolved_edges(t):
    """Note edges after notes of one stem in several vaults became one entity."""
    edges = t("gold").filter("link_type IS NOT NULL AND entity IS NOT NULL").select(F.concat_ws("/", "sample_name", F.regexp_replace(F.substring_index("source_file", "/", -1), r"\.md$", "")).alias("src"), F.concat_ws("/", "sample_name", "entity").alias("dst"))
    nodes = t("notes").select(F.concat_ws("/", "vault", "stem").alias("node"), "stem").distinct()
    least = nodes.groupBy("stem").agg(F.min("node").alias("b"))
    pairs = nodes.join(least, "stem").filter("node <> b").select(F.col("node").alias("a"), "b", F.lit(1.0).alias("similarity"))
    return G.resolve_entities(pairs, edges, 0.9)[1]


@query
def bfs_discoverers(t):
    return G.bfs(_seeds(t), _edges(t), 2, discoverer=True)


@query
def entity_seeds(t):
    """The notes of a question's own vault whose names match most of its terms."""
    q = t("qa").filter("qa_id % 20 = 0").select(F.col("qa_id").alias("query_id"), "question", "vault")
    notes = t("notes").select(F.concat_ws(":", "vault", X.node_id(F.col("stem"))).alias("node"), "vault", X.spaced(F.col("stem")).alias("display_name")).distinct()
    return R.entity_seeds(q, notes, 5).select("query_id", "node", "score", "rank_no")


# ---- evaluation --------------------------------------------------------------------------------------------------


@query
def micro_by_strategy(t):
    """Totals over all samples for each way of comparing edges."""
    typed = E.edge_counts(_gold_edges(t), _note_edges(t), ["vault"]).withColumn("strategy", F.lit("typed"))
    untyped = E.edge_counts(_gold_edges(t), _note_edges(t), ["vault"], use_relation=False).withColumn("strategy", F.lit("untyped"))
    return E.micro_totals(typed.unionByName(untyped), "strategy")


@query
def results_appended(t):
    """Classification results appended as JSON lines in two runs and read back."""
    typed = E.gold_groups(t("gold")).select("sample_name", "source_file", "entity", "true_type")
    path = _folder(typed, "results")
    for part in (typed.filter("true_type <= 'm'"), typed.filter("true_type > 'm'")):
        sinks.append_results(part, path)
    return V.read_json(typed.sparkSession, path, V.RESULT_SCHEMA, lines=True).select("sample_name", "source_file", "entity", "true_type")


@query
def merged_ranking(t):
    """Seed hits and expanded hits as one ranking."""
    h = t("search_hits").withColumn("score", F.round(F.lit(1.0) / (1.0 + F.col("distance")), 6))
    near, far = h.filter("rank_no <= 3"), h.filter("rank_no > 3").withColumn("score", F.round(F.col("score") * 0.9, 6))
    return P.merge_ranked(near.withColumn("ord", F.col("hit_id")), far.withColumn("ord", F.col("hit_id"))).select("query_id", F.col("ord").alias("hit_id"), "side", "rank_no")


def _qa(t) -> tuple[DataFrame, DataFrame]:
    contexts = t("search_hits").filter("text IS NOT NULL").select("query_id", "rank_no", "text")
    return contexts, t("qa").select(F.col("qa_id").alias("query_id"), "question", F.col("answer").alias("reference"))


@query
def context_recall(t):
    contexts, qa = _qa(t)
    return Q.context_recall(contexts, qa).select("query_id", F.round("recall", 6).alias("recall"))


@query
def qa_evaluation(t):
    """The four figures of each question over its retrieved contexts and an extractive answer, in the order of the questions."""
    contexts, qa = _qa(t)
    return Q.evaluate_answers(contexts, qa)


# ---- pipelines over vectors ----------------------------------------------------------------------------------------


@query
def vector_search(t):
    """Chunks nearest to each question by hashed term vectors."""
    return R.search_chunks(_questions(t), t("chunks").filter("text IS NOT NULL"), 5, weight=1.0).select("query_id", "chunk_id", "rank_no")


@query
def hybrid_search(t):
    return R.search_chunks(_questions(t), t("chunks").filter("text IS NOT NULL"), 5, weight=0.5).select("query_id", "chunk_id", "score")


@query
def pipeline_untyped_vector(t):
    return R.run_untyped(_questions(t), t("chunks").filter("text IS NOT NULL"), _edges(t), weight=1.0).select("query_id", "rank_no", "text", "score")


@query
def broad_retrieval_by_summary(t):
    """Broad retrieval with a title and summary of each note as its query, by hashed term vectors."""
    chunks = t("chunks").filter("text IS NOT NULL")
    queries = R.title_summary_queries(t("notes").filter("body IS NOT NULL"))
    return R.broad_by_summary(queries, chunks, threshold=0.3).select("source_path", "target_path", F.md5("target_content").alias("content_md5"), F.round("reranker_score", 6).alias("reranker_score"))


# ---- re-indexing ----------------------------------------------------------------------------------------------------


@query
def reindexed(t):
    """The chunk index after removed and updated notes went and added and updated ones were cut again (by characters here)."""
    files = t("notes").select(_path().alias("file_path"), F.md5("content").alias("hash"))
    changed = I.changes(files, t("chunks").select("file_path", F.col("file_hash").alias("hash"), "indexed_at", "chunk_id"))
    notes = t("notes").select(_path().alias("file_path"), "body", F.md5("content").alias("hash"))
    cut = lambda df: C.fixed_chunks(df, "file_path", "body", 1000, 100)
    return I.reindex(t("chunks"), notes, changed, cut=cut).select("file_path", "chunk_index", F.md5("text").alias("text_md5"), "file_hash")


@query
def kept_after_removal(t):
    files = t("notes").select(_path().alias("file_path"), F.md5("content").alias("hash"))
    changed = I.changes(files, t("chunks").select("file_path", F.col("file_hash").alias("hash"), "indexed_at", "chunk_id"))
    return I.remove(t("chunks"), changed).select("chunk_id")
