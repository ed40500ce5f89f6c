import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skein.operators import chunking as C, evaluation as E, graph as G, grouping as P, links as L, search as S
from skein.operators.ranking import standing_of_values
from skein.plans import pipelines as R

NOTES = [
    ("v", "a.md", "a", "A", "A", "- Uses:: [[b]]\n- Is a:: [[missing]]"),
    ("v", "x/b.md", "b", "B", "B", "- Uses:: [[c]]"),
    ("v", "c.md", "c", "C", "C", "- Uses:: [[a]]"),
    ("v", "z/b.md", "b", "B2", "B2", None),
]
NOTE_SCHEMA = "vault string, rel_path string, stem string, content string, body string, links_section string"


def notes(spark):
    return spark.createDataFrame(NOTES, NOTE_SCHEMA)


def test_links_resolve_to_first_path_and_report_dangling(spark, rows):
    e = L.note_edges(notes(spark))
    assert rows(L.resolve_edges(e, notes(spark)), "src_path", "dst_path") == [("a.md", "x/b.md"), ("c.md", "a.md"), ("x/b.md", "c.md")]
    assert rows(L.dangling_edges(e, notes(spark)), "src_path", "target_name") == [("a.md", "missing")]


def test_link_upsert_is_idempotent(spark, rows):
    n = spark.createDataFrame([("v", "a.md", "Body  \n\n## Related Connections\n\n- b:: [[B]]"), ("v", "q.md", "Other ")], "vault string, rel_path string, content string")
    new = spark.createDataFrame([("v/a.md", ["- a:: [[A]]", "- b:: [[B]]"])], "source_path string, links array<string>")
    once = L.upsert_links(n, new)
    assert rows(once, "rel_path", "content") == [("a.md", "Body\n\n## Related Connections\n\n- a:: [[A]]\n- b:: [[B]]"), ("q.md", "Other ")]
    assert rows(L.upsert_links(once, new)) == rows(once)
    assert rows(L.clear_links(once), "content") == [("Body",), ("Other ",)]


def test_rewrite_and_outlinks_and_claims(spark, rows):
    n = spark.createDataFrame([("v", "a.md", "Body"), ("v", "b.md", "Only" + "\n\n## Related Connections\n\n- x:: [[Y]]")], "vault string, rel_path string, content string")
    c = spark.createDataFrame([("v", "a.md", None, "T", 1), ("v", "a.md", "Uses", "S", 0)], "vault string, src_path string, relation string, target_name string, link_ord int")
    assert rows(L.rewrite_links(n, c), "content") == [("Body\n\n## Related Connections\n\n- Uses:: [[S]]\n- None:: [[T]]",), ("Only",)]
    out = spark.createDataFrame([("p", "Big Cat"), ("p", "Dog"), ("q", "Nope")], "page string, title string")
    saved = spark.createDataFrame([("big cat",), ("Dog",)], "title string")
    assert rows(L.keep_saved_outlinks(out, saved)) == [("p", "- [[Dog]]"), ("q", "")]
    assert rows(L.keep_saved_outlinks(out, saved, ignore_case=True)) == [("p", "- [[Big_Cat]]\n- [[Dog]]"), ("q", "_No links found._")]
    q = spark.createDataFrame([("A", "Q1"), ("B", "Q2")], "title string, qid string")
    claims = spark.createDataFrame([("Q1", "Q2", "part of"), ("Q1", "Q2", "has use")], "src_qid string, tgt_qid string, label string")
    assert rows(L.claimed_relations(spark.createDataFrame([("A", "B"), ("B", "A")], "source string, target string"), q, claims)) == [("A", "B", "has use, part of"), ("B", "A", None)]


def test_union_first_wins_is_idempotent(spark, rows):
    a = spark.createDataFrame([("s", "t", "x", 1.0)], "s string, t string, c string, score double")
    b = spark.createDataFrame([("s", "t", "x", 9.0), ("s", "t", "y", 2.0)], "s string, t string, c string, score double")
    u = L.union_first_wins(a, b, ["s", "t", "c"])
    assert rows(u) == [("s", "t", "x", 1.0), ("s", "t", "y", 2.0)]
    assert rows(L.union_first_wins(u, u, ["s", "t", "c"])) == rows(u)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#?", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_recursive_chunks_keep_order_size_and_letters(text, size, overlap):
    chunks = C.split_recursive(text, size, overlap)
    assert all(len(c) <= size for c in chunks)
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())
    at = 0
    for c in chunks:
        at = text.find(c, max(0, at - overlap - 2))
        assert at >= 0


def test_windows_and_fixed_chunks(spark, rows):
    d = spark.createDataFrame([(1, "One. Two! Three?\nFour"), (2, ""), (3, None)], "id int, t string")
    assert rows(C.sentence_rows(d, "id", "t")) == [(1, 0, "One."), (1, 1, "Two!"), (1, 2, "Three?"), (1, 3, "Four")]
    assert rows(C.sentence_windows(d, "id", "t"))[0] == (1, 0, "One. Two!")
    assert rows(C.fixed_chunks(spark.createDataFrame([(1, "abcdefgh")], "id int, t string"), "id", "t", 4, 1)) == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "gh")]


def test_chunk_chain(spark, rows):
    d = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("g", 0, "c")], "f string, i int, t string")
    assert rows(C.next_chunk_edges(d, "f", "i")) == [("f::0", "f::1")]
    assert rows(C.with_next_text(d, "f", "i", "t"), "text_next") == [("a\nb",), ("b",), ("c",)]


def test_bm25_and_fuzzy(spark, rows):
    docs = spark.createDataFrame([(1, "stencil archive"), (2, "stencils"), (3, "other"), (4, None)], "id int, t string")
    q = spark.createDataFrame([(7, "stencil")], "q int, text string")
    assert rows(S.bm25(q, docs, "q", "text", "id", "t", 3), "id", "rank_no") == [(1, 1)]
    assert rows(S.fulltext(q, docs, "q", "text", "id", "t"), "id", "score") == [(1, 1), (2, 1)]


def test_knn_excludes_own_group_and_breaks_ties(spark, rows):
    items = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "c"), (4, None, "d"), (5, [5.0], "e")], "item_id long, vector array<float>, grp string")
    q = spark.createDataFrame([(1, [0.0, 0.0], "a")], "query_id long, vector array<float>, grp string")
    assert rows(S.knn(q, items, 2), "item_id", "distance", "rank_no") == [(2, 1.0, 1), (3, 1.0, 2)]


def test_hybrid_fusion_rerank(spark, rows):
    v = spark.createDataFrame([(1, "a", 0.0), (1, "b", 1.0)], "query_id int, k string, distance double")
    t = spark.createDataFrame([(1, "b", 5.0), (1, "c", 1.0)], "query_id int, k string, score double")
    assert rows(S.hybrid(v, t, 0.6, "k")) == [(1, "a", 0.6), (1, "b", 0.4), (1, "c", 0.0)]
    b = spark.createDataFrame([(1, 0, 0, "x", 2.0), (1, 1, 0, "x", 4.0), (1, 1, 1, "y", 2.0)], "query_id int, branch int, ord int, text string, score double")
    assert rows(S.max_norm_fusion(b), "text", "score") == [("x", 2.0), ("y", 0.5)]
    h = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.1)], "q int, id int, score double")
    assert rows(S.rerank(h, "q", "score", ["id"], 5, 0.5), "id", "rank_no") == [(1, 1), (2, 2)]


def test_phrases_and_proximity(spark, rows):
    docs = spark.createDataFrame([("d1", "The Ion-trap and the ion trap"), ("ion", "ion trap")], "k string, t string")
    al = spark.createDataFrame([("ion trap", "ion"), ("", "none")], "alias string, rel_path string")
    assert rows(S.phrase_matches(docs, al, "k", "t")) == [("d1", "ion", 1)]
    none = spark.createDataFrame([], "alias string, rel_path string")
    assert rows(S.phrase_matches(docs, none, "k", "t")) == []
    df = spark.createDataFrame([(["big", "x", "cat"], ["big", "cat"], "cat"), (["big"] + ["x"] * 20 + ["cat"], ["big", "cat"], "cat"), (["cat", "cat"], ["cat", "cat"], "cat"), ([], ["a"], "a")], "s array<string>, l array<string>, h string")
    assert [r.x for r in df.select(S.within_span(F.col("s"), F.col("l"), F.col("h")).alias("x")).collect()] == [True, False, True, False]


def test_bfs_depth_on_random_graphs(spark, rows):
    rng = random.Random(3)
    edges = {(rng.randrange(20), rng.randrange(20)) for _ in range(35)}
    depth, frontier = {0: 0}, [0]
    for hop in (1, 2, 3):
        frontier = sorted({b for a, b in edges if a in frontier and b not in depth})
        depth |= {b: hop for b in frontier}
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    got = G.bfs(spark.createDataFrame([(1, 0)], "query_id int, node int"), e, 3)
    assert rows(got, "node", "depth") == sorted(depth.items(), key=repr)


def test_typed_bfs_uses_best_edge_and_stops(spark, rows):
    e = spark.createDataFrame([(1, 2, "bad"), (1, 2, "good"), (1, 3, "bad"), (3, 4, "good"), (2, 5, "good")], "src int, dst int, relation string")
    score = lambda d: d.withColumn("score", F.when(F.col("relation") == "good", 0.5).otherwise(0.1))
    got = G.bfs_scored(spark.createDataFrame([(9, 1)], "query_id int, node int"), e, score, 2, 0.2)
    assert rows(got, "node", "depth") == [(1, 0), (2, 1), (5, 2)]


def test_expand_components_crawl(spark, rows):
    seeds = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 0.5)], "query_id int, node string, rank_no int, score double")
    links = spark.createDataFrame([("a", "b", 0), ("a", "x", 1), ("b", "y", 0), ("a", "n", 2)], "src string, dst string, link_ord int")
    summ = spark.createDataFrame([("x", "s"), ("y", "s"), ("n", "")], "node string, summary string")
    assert rows(G.expand_one_hop(seeds, links, summ)) == [(1, "x", 0.9, 1), (1, "y", 0.45, 2)]
    e = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 51)], "src int, dst int")
    assert {r.component for r in G.connected_components(e).collect()} == {0, 50}
    assert G.connected_components(e).filter("component = 0").count() == 13
    groups, merged = G.resolve_entities(spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.1)], "a int, b int, similarity double"), spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int"), 0.8)
    assert rows(merged, "src", "dst") == [(1, 3)] and rows(groups) == [(1, 1), (2, 1)]
    assert G.best_first("s", {"s": [("a", 0.2), ("b", 0.9), ("c", 0.05), ("x:y", 1.0)], "b": [("d", 0.5)]}, max_depth=2) == [("s", 0, 1.0), ("b", 1, 0.9), ("d", 2, 0.5), ("a", 1, 0.2)]


def test_metrics(spark, rows):
    g = spark.createDataFrame([("v", "a", "Uses", "x"), ("v", "a", "Is a", "y")], "vault string, rel_path string, relation string, target_name string")
    p = spark.createDataFrame([("v", "a", "uses", "x"), ("v", "a", "is a", "z"), ("w", "b", "uses", "q")], "vault string, rel_path string, relation string, target_name string")
    assert rows(E.edge_counts(g, p, ["vault"])) == [("v", 1, 1, 1), ("w", 0, 1, 0)]
    assert rows(E.edge_counts(g, p, ["vault"], case_sensitive=True)) == [("v", 0, 2, 2), ("w", 0, 1, 0)]
    roll = {r.vault: (r.tp, r.fp, r.fn) for r in E.prf_rollup(E.edge_counts(g, p, ["vault"]), "vault").collect()}
    assert roll["OVERALL"] == (1, 2, 1)
    c = E.with_prf(E.class_counts(spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "true_type string, predicted_type string")))
    assert rows(c, "cls", "tp", "fp", "fn", "support") == [("a", 1, 1, 1, 2), ("b", 0, 1, 0, 0), ("c", 0, 0, 1, 1)]
    avg = {r.avg_kind: r.recall for r in E.class_averages(c).collect()}
    assert avg == {"macro": 0.25, "weighted": round(1 / 3, 6)}
    gold = spark.createDataFrame([("s", 1, "f", "e", "big red cat"), ("s", 2, "f", "e", "blue"), ("s", 3, "f", "q", "the")], "sample_name string, row_id int, source_file string, entity string, sentence string")
    pred = spark.createDataFrame([("s", "f", "e", "a big red dog"), ("s", "f", "zz", "x"), ("s", "f", "q", "in the end")], "sample_name string, source_file string, entity string, sentence string")
    assert rows(E.retrieval_counts(gold, pred, "sample_name")) == [("s", 2, 1, 1)]
    n = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (3.0, float("nan"))], "a double, b double")
    assert tuple(E.nan_means(n, ["a", "b"]).first()) == (2.0, 2.0, 1)


def test_grouping_and_pipelines_agree_over_partitions(spark, rows):
    c = spark.createDataFrame([(1, "s", "t", "x", 0.5), (2, "s", "t", "y", 0.9), (3, "s", "t", None, None)], "pair_id int, source_path string, target_path string, target_content string, reranker_score double")
    assert rows(P.group_pairs(c, 2)) == [("s", "t", ["y", "x"], 2)]
    chunks = spark.createDataFrame([(1, "v/a.md", 0, "stencil archive of the mill", "x"), (2, "v/b.md", 0, "the mill burned", "y")], "chunk_id int, file_path string, chunk_index int, text string, text_lemmatized string")
    q = spark.createDataFrame([(1, "stencil mill")], "query_id int, question string")
    edges = spark.createDataFrame([("v/a.md", "v/b.md", "Uses", 0)], "src string, dst string, relation string, link_ord int")
    got = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(R.run_untyped(q, chunks, edges, seed_k=1), "file_path", "score", "rank_no"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == [("v/a.md", 1.0, 1), ("v/b.md", 0.5, 2)]
    one = rows(R.run_single_hop(q, chunks, edges, seed_k=1), "text", "rank_no")
    assert one == [("stencil archive of the mill", 1), ("the mill burned", 2)]
    assert R.answers(R.run_typed(q, chunks, edges, seed_k=1)).count() == 1


def test_standing_of_values(spark, rows):
    rng = random.Random(1)
    data = [(g, rng.choice([-5.0, 0.0, 0.001, 0.5, 3.0, 1e9, rng.random()])) for g in "ab" for _ in range(60)]
    got = {(r.g, r.v): (r.n_lower, r.n_equal) for r in standing_of_values(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()}
    for g, v in data:
        assert got[g, v] == (sum(1 for h, w in data if h == g and w < v), sum(1 for h, w in data if h == g and w == v))


def test_property_graph_query_takes_three_hops(spark, monkeypatch):
    from skein.plans import catalog

    hops, khop = [], G.khop_undirected
    monkeypatch.setattr(G, "khop_undirected", lambda seeds, edges, n, *rest: hops.append(n) or khop(seeds, edges, n, *rest))
    catalog.QUERIES["pipeline_property_graph"](spark, "/root/testdata/sf0.001")
    assert hops == [3]


def test_strict_candidates_lead_to_notes_of_the_vault(spark, rows):
    from skein.plans import pipelines as R

    docs = spark.createDataFrame([("v", "v/a.md", "First line. See the salt pan here."), ("v", "v/b.md", "The salt pan."), ("w", "w/c.md", "A salt pan.")], "vault string, file_path string, text string")
    names = spark.createDataFrame([("v", "salt pan", "v/b.md"), ("v", "salt pan", "v/d.md"), ("w", "salt pan", "w/e.md")], "vault string, alias string, file_path string")
    got = rows(R.strict_note_candidates(docs, names), "source_path", "target_path")
    assert got == [("v/a.md", "v/b.md"), ("v/a.md", "v/d.md"), ("v/b.md", "v/d.md"), ("w/c.md", "w/e.md")]
