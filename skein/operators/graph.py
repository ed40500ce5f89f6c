"""Traversals over edge tables, for all queries at once; each hop is written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from skein.session import materialize


def bfs(seeds: DataFrame, edges: DataFrame, max_hops: int = 2, discoverer: bool = False) -> DataFrame:
    """(query_id, node, depth): all nodes within max_hops directed edges (src, dst) of a query's seeds (query_id, node), at their least depth.

    discoverer adds via, the node that a node was first reached from (of several the least); null for seeds.

    Each hop joins the frontier with the edges and drops what the query has visited; it stops when no query finds
    anything new. The frontier is materialised, so the lineage stays one hop long and a lost executor costs one hop.
    """
    visited = seeds.select("query_id", "node").distinct().withColumn("depth", F.lit(0))
    if discoverer:
        visited = visited.withColumn("via", F.lit(None).cast(edges.schema["src"].dataType))
    frontier = visited
    links = edges.select(F.col("src").alias("node"), "dst").filter("node <> dst").distinct()
    for hop in range(1, max_hops + 1):
        steps = frontier.select("query_id", "node").join(links, "node").select("query_id", F.col("dst").alias("node"), F.col("node").alias("via"))
        found = steps.groupBy("query_id", "node").agg(F.min("via").alias("via")) if discoverer else steps.select("query_id", "node").distinct()
        frontier = materialize(found.join(visited, ["query_id", "node"], "left_anti").withColumn("depth", F.lit(hop)), "bfs")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def bfs_scored(seeds: DataFrame, edges: DataFrame, score: Callable[[DataFrame], DataFrame], max_hops: int = 2, threshold: float = 0.2) -> DataFrame:
    """(query_id, node, depth, score): like bfs, but a step counts only if its best edge scores at least threshold.

    score gets (query_id, src, dst, relation) and returns it with a column score; it runs once for each edge that
    leaves the frontier to a node not yet visited. Nodes reached by several edges keep the best.
    """
    visited = seeds.select("query_id", "node").distinct().withColumn("depth", F.lit(0)).withColumn("score", F.lit(None).cast("double"))
    frontier = visited
    links = edges.select("src", "dst", "relation").filter("src <> dst").distinct()
    for hop in range(1, max_hops + 1):
        steps = frontier.select("query_id", F.col("node").alias("src")).join(links, "src")
        steps = steps.join(visited.select("query_id", F.col("node").alias("dst")), ["query_id", "dst"], "left_anti")
        best = score(steps).groupBy("query_id", F.col("dst").alias("node")).agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
        frontier = materialize(best.select("query_id", "node", F.lit(hop).alias("depth"), "score"), "bfs-scored")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def expand_one_hop(seeds: DataFrame, links: DataFrame, summaries: DataFrame, limit: int = 5, penalty: float = 0.9) -> DataFrame:
    """(query_id, node, score, expand_no): the first `limit` new notes that a query's seeds link to.

    seeds (query_id, node, rank_no, score) in rank order, their links (src, dst, link_ord) in text order; notes that
    are seeds or have no summary (node, summary) don't count; the first link to a note counts; its score is the
    seed's times penalty.
    """
    steps = seeds.withColumnRenamed("node", "src").join(links, "src").join(summaries.filter("summary IS NOT NULL AND summary <> ''").select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    fresh = steps.join(seeds.select("query_id", F.col("node").alias("dst")), ["query_id", "dst"], "left_anti")
    first = fresh.groupBy("query_id", "dst").agg(F.min_by("score", F.struct("rank_no", "link_ord")).alias("_s"), F.min(F.struct("rank_no", "link_ord")).alias("_o"))
    ranked = first.withColumn("expand_no", F.row_number().over(W.partitionBy("query_id").orderBy("_o", "dst")))
    return ranked.filter(F.col("expand_no") <= limit).select("query_id", F.col("dst").alias("node"), F.round(F.col("_s") * penalty, 9).alias("score"), "expand_no")


def khop_undirected(seeds: DataFrame, edges: DataFrame, max_hops: int = 3, leave_out: tuple[str, ...] = ("MENTIONS", "NEXT_CHUNK")) -> DataFrame:
    """(query_id, node, depth) within max_hops of the seeds over entity edges (src, dst, relation), either way, seeds included."""
    own = edges.filter(~F.col("relation").isin(*leave_out)).select("src", "dst")
    return bfs(seeds, own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), max_hops)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node id of each component of undirected edges (src, dst).

    Alternates large-star and small-star steps: every node is hung below the least node of its neighbourhood until
    nothing changes. Rounds grow with the logarithm of the component size; more than max_rounds raise an error. The least
    neighbour of a node is a minimum that combines before the shuffle, and it goes back to the node's edges in SALTS
    places, so the edges of a hub are spread. Each round is materialised; it ends when all edges lead from a node to
    the least of its component, of which nothing but a yes or no comes to the driver.
    """
    edge = edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).filter("hi <> lo").distinct()
    current = materialize(edge, "components")
    for _ in range(max_rounds):
        if _stars(current):
            break
        both = current.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(current.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("lowest"))
        large = _spread_join(both, low, "n", "m").filter("m > n").select(F.col("m").alias("hi"), F.col("lowest").alias("lo"))
        down = large.filter("hi <> lo").distinct()
        least = down.groupBy("hi").agg(F.min("lo").alias("lowest"))
        small = _spread_join(down, least, "hi", "lo").select(F.col("lo").alias("hi"), F.col("lowest").alias("lo")).unionByName(least.select("hi", F.col("lowest").alias("lo")))
        current = materialize(small.filter("hi <> lo").distinct(), "components")
    else:
        if not _stars(current):
            raise RuntimeError(f"components still change after {max_rounds} rounds")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(current.select(F.col("hi").alias("node"), "lo"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node of (hi, lo) has one edge down and none of those it leads to has one: components are stars round their least node."""
    ends = edges.groupBy("hi").agg(F.count(F.lit(1)).alias("down")).select(F.col("hi").alias("n"), "down", F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("lo").alias("n"), F.lit(0).cast("long").alias("down"), F.lit(1).alias("up")).distinct())
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down > 0 AND up > 0)").isEmpty()


SALTS = 16


def _spread_join(many: DataFrame, one: DataFrame, key: str, other: str) -> DataFrame:
    """many joined with one (a row a key), the rows of a key spread over SALTS places by the column other."""
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")


def resolve_entities(pairs: DataFrame, edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((node, component), merged edges): nodes joined by pairs (a, b, similarity >= threshold) become their least id; self-loops and repeated edges go."""
    groups = connected_components(pairs.filter(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    out = edges
    for c in ("src", "dst"):
        out = out.join(groups.select(F.col("node").alias(c), F.col("component").alias("_c")), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    return groups, out.filter("src <> dst").distinct()


def best_first(start: str, links: dict[str, list[tuple[str, float]]], max_pages: int = 100, max_depth: int = 3, min_score: float = 0.1) -> list[tuple[str, int, float]]:
    """(title, depth, score) in the order a focused crawl saves pages: best score first, then least depth, then title.

    A crawl fetches one page at a time and at most max_pages of them, so it is driver code over a bounded frontier.
    """
    import heapq

    heap, seen, out = [(-1.0, 0, start)], {start}, []
    while heap and len(out) < max_pages:
        score, depth, title = heapq.heappop(heap)
        out.append((title, depth, -score))
        if depth >= max_depth:
            continue
        for target, s in links.get(title, ()):
            if s > min_score and ":" not in target and target not in seen:
                seen.add(target)
                heapq.heappush(heap, (-s, depth + 1, target))
    return out


def documents_of_entities(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, doc, n): documents that mention (doc, entity) a query's entities (query_id, node), and how many distinct ones."""
    hits = mentions.select("doc", F.col("entity").alias("node")).distinct().join(seeds.select("query_id", "node").distinct(), "node")
    return hits.groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("n"))


def alike(sets: DataFrame, by: str, member: str) -> DataFrame:
    """(by, least): for each set of members the least by whose set is the same; sets (by, member) without repeated rows.

    Sets are compared by their size and two independent 64-bit hashes of their members, so none is gathered in a row.
    """
    marks = sets.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(member)).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("_b"))
    return marks.join(marks.groupBy("_n", "_a", "_b").agg(F.min(by).alias("least")), ["_n", "_a", "_b"]).select(by, "least")


def shared_neighbourhoods(seeds: DataFrame, edges: DataFrame, max_hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """((query_id, kind), (kind, node)): what khop_undirected reaches from each query's seeds (query_id, node), one kind for queries that reach the same nodes.

    Each distinct seed is followed once, whatever the number of queries that start there; queries whose seeds reach alike
    are joined before and after their neighbourhoods are united, so a part of the graph that all reach is one set of nodes.
    """
    seeds = materialize(seeds.select("query_id", "node").distinct(), "seeds")
    own = materialize(edges.select("src", "dst", "relation").distinct(), "graph-edges")
    from_one = khop_undirected(seeds.select(F.col("node").alias("query_id"), "node").distinct(), own, max_hops)
    balls = materialize(from_one.select(F.col("query_id").alias("seed"), "node"), "balls")
    parts = materialize(seeds.join(alike(balls, "seed", "node").withColumnRenamed("seed", "node"), "node").select("query_id", F.col("least").alias("seed")).distinct(), "ball-sets")
    first = materialize(alike(parts, "query_id", "seed"), "ball-kinds")
    united = parts.join(first.select(F.col("least").alias("query_id")).distinct(), "query_id").join(balls, "seed").select(F.col("query_id").alias("kind"), "node").distinct()
    united = materialize(united, "united")
    second = materialize(alike(united, "kind", "node").withColumnRenamed("least", "_least"), "kinds")
    kinds = first.withColumnRenamed("least", "kind").join(second, "kind").select("query_id", F.col("_least").alias("kind"))
    return kinds, united.join(second.select(F.col("_least").alias("kind")).distinct(), "kind")
