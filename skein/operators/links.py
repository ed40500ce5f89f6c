"""Links between notes: extraction, resolution, merging and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from skein.functions import text as X


def note_edges(notes: DataFrame) -> DataFrame:
    """(vault, src_path, relation, target_name, link_ord): the typed links of every note's link section in text order, from 0."""
    links = F.posexplode(X.line_links(F.col("links_section")))
    rows = notes.filter(F.col("links_section").isNotNull()).select("vault", F.col("rel_path").alias("src_path"), links.alias("link_ord", "_l"))
    return rows.select("vault", "src_path", F.col("_l.relation").alias("relation"), F.col("_l.target").alias("target_name"), "link_ord")


def note_wikilinks(notes: DataFrame) -> DataFrame:
    """(vault, src_path, target_name, link_ord): all [[links]] of the full content in text order."""
    return notes.filter(F.col("content").isNotNull()).select("vault", F.col("rel_path").alias("src_path"), F.posexplode(X.wikilinks(F.col("content"))).alias("link_ord", "target_name"))


def first_paths(notes: DataFrame) -> DataFrame:
    """(vault, stem, dst_path): the first path of each stem by rel_path."""
    return notes.groupBy("vault", "stem").agg(F.min("rel_path").alias("dst_path"))


def resolve_edges(edges: DataFrame, notes: DataFrame, keep_dangling: bool = False) -> DataFrame:
    """Edges with dst_path, the first note of that stem in the vault; unresolved ones are dropped or kept with a null."""
    names = first_paths(notes).withColumnRenamed("stem", "target_name")
    return edges.join(names, ["vault", "target_name"], "left" if keep_dangling else "inner")


def dangling_edges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    return edges.join(first_paths(notes).withColumnRenamed("stem", "target_name"), ["vault", "target_name"], "left_anti")


def links_by_note(predictions: DataFrame) -> DataFrame:
    """(source_path, links): the sorted distinct link lines of each source; "no link" and empty types give none."""
    typed = predictions.filter(F.col("relation_type").isNotNull() & ~F.lower(F.trim("relation_type")).isin("no link", ""))
    return typed.groupBy("source_path").agg(F.array_sort(F.collect_set(X.link_line(F.col("relation_type"), F.col("target_path")))).alias("links"))


def lines_of(section):
    """Trimmed lines of a section that are not blank."""
    return F.filter(F.transform(F.split(section, "\n"), lambda x: X.strip(x)), lambda x: x != "")


def upsert_links(notes: DataFrame, new_links: DataFrame, header: str = X.LINK_HEADER) -> DataFrame:
    """(vault, rel_path, content): notes with new link lines merged into their section, sorted; unchanged where nothing is new."""
    joined = notes.join(new_links.select(F.col("source_path").alias("_s"), F.col("links").alias("_new")), F.concat_ws("/", "vault", "rel_path") == F.col("_s"), "left")
    old = lines_of(X.note_links(F.col("content"), header))
    fresh = F.array_except(F.coalesce("_new", F.array().cast("array<string>")), old)
    text = F.concat(X.note_body(F.col("content"), header), F.lit(header), F.array_join(F.array_sort(F.array_union(old, fresh)), "\n"))
    return joined.select("vault", "rel_path", F.when(F.size(fresh) > 0, text).otherwise(F.col("content")).alias("content"))


def clear_links(notes: DataFrame, header: str = X.LINK_HEADER) -> DataFrame:
    return notes.select("vault", "rel_path", X.note_body(F.col("content"), header).alias("content"))


def rewrite_links(notes: DataFrame, classified: DataFrame, header: str = X.LINK_HEADER) -> DataFrame:
    """Notes with their section replaced by classified links (vault, src_path, relation, target_name, link_ord); no links, no section. A null relation prints None."""
    line = F.format_string("- %s:: [[%s]]", F.coalesce("relation", F.lit("None")), F.col("target_name"))
    lines = classified.groupBy("vault", F.col("src_path").alias("rel_path")).agg(F.array_sort(F.collect_list(F.struct("link_ord", line.alias("line")))).alias("_l"))
    body = X.note_body(F.col("content"), header)
    joined = notes.join(lines, ["vault", "rel_path"], "left")
    return joined.select("vault", "rel_path", F.when(F.col("_l").isNull(), body).otherwise(F.concat(body, F.lit(header), F.array_join(F.col("_l.line"), "\n"))).alias("content"))


def backfill_types(candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """Candidates with llm_type and llm_reasoning of their (source, target); unmatched ones say "no link"."""
    p = predictions.groupBy("source_path", "target_path").agg(F.max_by(F.struct("relation_type", "reasoning"), F.struct("relation_type", "reasoning")).alias("_p"))
    out = candidates.join(p, ["source_path", "target_path"], "left")
    return out.withColumn("llm_type", F.coalesce("_p.relation_type", F.lit("no link"))).withColumn("llm_reasoning", F.coalesce("_p.reasoning", F.lit(""))).drop("_p")


def keep_saved_outlinks(outlinks: DataFrame, saved: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(page, block): the outlinks (page, title) that lead to saved pages (title), as sorted link lines; ignore_case compares without case and names empty blocks."""
    norm = (lambda c: F.lower(X.file_name(c, apostrophes=False))) if ignore_case else (lambda c: X.file_name(c))
    have = saved.select(norm(F.col("title")).alias("_k")).distinct()
    kept = outlinks.withColumn("_k", norm(F.col("title"))).join(have, "_k", "left_semi")
    lines = kept.groupBy("page").agg(F.array_join(F.array_sort(F.collect_set(F.format_string("- [[%s]]", X.file_name(F.col("title"), not ignore_case)))), "\n").alias("block"))
    return outlinks.select("page").distinct().join(lines, "page", "left").select("page", F.coalesce("block", F.lit("_No links found._" if ignore_case else "")).alias("block"))


def claimed_relations(links: DataFrame, qids: DataFrame, claims: DataFrame) -> DataFrame:
    """Links (source, target) with the property labels claimed between their items, joined by ", "; null where there are none."""
    ids = qids.groupBy("title").agg(F.min("qid").alias("qid"))
    out = links.join(ids.select(F.col("title").alias("source"), F.col("qid").alias("_a")), "source", "left").join(ids.select(F.col("title").alias("target"), F.col("qid").alias("_b")), "target", "left")
    named = claims.groupBy("src_qid", "tgt_qid").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("relation"))
    return out.join(named, (F.col("_a") == F.col("src_qid")) & (F.col("_b") == F.col("tgt_qid")), "left").select("source", "target", "relation")


def union_first_wins(strict: DataFrame, broad: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of strict, then those of broad whose key is new; within each side the first by all columns wins."""
    cols = [c for c in strict.columns if c in broad.columns]
    both = strict.select(F.lit(0).alias("_side"), *cols).unionByName(broad.select(F.lit(1).alias("_side"), *cols))
    order = W.partitionBy(*keys).orderBy("_side", *[c for c in cols if c not in keys])
    return both.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).drop("_r", "_side")
