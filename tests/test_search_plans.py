"""Bins, posting lists, similarity search, seeds by weight, batched models, link formats and evaluation figures on small data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import evaluation as E, graph as G, search as S
from skein.operators.ranking import magnitude_bin, standing_of_values
from skein.plans import pipelines as R, preparation as Q, providers as M
from skein.sources import vault as V


def test_bins_are_monotone_and_spread_small_units(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308, 1.0, 2.0, 4.0, math.nextafter(4.0, 0), math.nextafter(4.0, 9)] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)]
    small = [rng.uniform(1e-9, 2e-9) for _ in range(300)]
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in values + small], "v double").select("v", magnitude_bin(F.col("v"), 64).alias("b")).collect()}
    order = sorted(set(values + small))
    assert all(got[a] <= got[b] for a, b in zip(order, order[1:]))
    assert len({got[v] for v in small}) > 40 and got[0.0] == 0 and got[5e-324] > 0 > got[-5e-324]


def test_standing_of_values_in_small_units(spark):
    rng = random.Random(6)
    data = [("g", rng.randrange(30) * 1e-8) for _ in range(300)]
    got = {r.v: (r.n_lower, r.n_equal) for r in standing_of_values(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()}
    vs = [v for _, v in data]
    assert got == {v: (sum(x < v for x in vs), vs.count(v)) for v in set(vs)}


def test_fulltext_counts_terms_once_and_keeps_the_best(spark, rows):
    docs = spark.createDataFrame([(f"d{i}", "common word " + ("stencils stencil" if i % 3 == 0 else "")) for i in range(60)] + [("none", None), ("empty", "")], "k string, t string")
    q = spark.createDataFrame([(1, "common stencil"), (2, "stencil"), (3, "of"), (4, None)], "q int, t string")
    got = rows(S.fulltext(q, docs, "q", "t", "k", "t"), "query_id", "k", "score")
    want = sorted([(1, f"d{i}", 2 if i % 3 == 0 else 1) for i in range(60)] + [(2, f"d{i}", 1) for i in range(0, 60, 3)], key=repr)
    assert got == want
    best = rows(S.fulltext(q, docs, "q", "t", "k", "t", 5), "query_id", "k", "score")
    assert {x for x in best if x[0] == 1} == {x for x in want if x[0] == 1 and x[2] == 2}
    assert S.fulltext(q.limit(0), docs, "q", "t", "k", "t").count() == 0 and S.fulltext(q, docs.limit(0), "q", "t", "k", "t").count() == 0


def test_within_a_cosine(spark, rows):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "item_id long, vector array<float>")
    q = items.filter("item_id IN (1, 5)").withColumnRenamed("item_id", "query_id")
    assert rows(S.within(q, items, 0.9), "query_id", "item_id") == [(1, 2)]
    assert S.within(q.limit(0), items, 0.9).count() == 0


def test_search_by_weight(spark, rows):
    chunks = spark.createDataFrame([(1, "f1", "ion trap ion trap"), (2, "f2", "ion"), (3, "f3", "moss garden")], "chunk_id long, file_path string, text string")
    q = spark.createDataFrame([(7, "ion trap")], "query_id long, question string")
    for w in (0.0, 0.5, 1.0):
        assert rows(R.search_chunks(q, chunks, 2, w), "chunk_id", "rank_no") == [(1, 1), (2, 2)], w
        assert rows(R.seed_notes(q, chunks, 1, w), "node", "rank_no") == [("f1", 1)]
    with_vectors = chunks.withColumn("vector", F.array(F.lit(1.0), F.col("chunk_id").cast("double")))
    assert rows(R.search_chunks(q.withColumn("vector", F.array(F.lit(1.0), F.lit(3.0))), with_vectors, 1, 1.0), "chunk_id") == [(3,)]


def test_models_get_batches_and_no_nulls(spark):
    def load():
        def score(pairs):
            assert 0 < len(pairs) <= 4 and all(a is not None and b is not None for a, b in pairs)
            return [float(len(a) + len(b)) for a, b in pairs]

        return score

    def encoder():
        return lambda texts: [[float(len(t)), float(len(texts) <= 4)] for t in texts]

    data = [("a" * i, "b") for i in range(11)] + [(None, "b"), ("a", None)]
    df = spark.createDataFrame(data, "q string, c string")
    assert sorted(r.s for r in df.select(M.ModelReranker(load, 4).score(F.col("q"), F.col("c")).alias("s")).collect()) == sorted([float(i + 1) for i in range(11)] + [0.0, 0.0])
    got = [r.v for r in df.select("q", M.ModelEmbedder(encoder, 2, 4).vector(F.col("q")).alias("v")).collect()]
    assert sum(v is None for v in got) == 1 and all(v[1] == 1.0 for v in got if v)


def test_components_of_a_hub_and_unfinished_ones(spark, rows):
    star = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(20)], "src int, dst int")
    got = G.connected_components(star)
    assert got.filter("component = 0").count() == 300 and got.filter("component = 1000").count() == 21
    with pytest.raises(RuntimeError):
        G.connected_components(star, max_rounds=1)


def test_link_formats(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one("[[a|b]] [[ c ]] [[d\ne]] [[f|]] [[\ng]]", X.wikilinks) == ["a", "c", "g"]
    assert tuple(one("name|a|b", X.split_label)) == ("name", "a|b") and tuple(one("name", X.split_label)) == ("name", None)


def test_settings_have_defaults(spark):
    c = spark.createDataFrame([("a", None, float("nan"), 0, " "), ("b", "ru", 0.25, 7, "summary")], "vault string, lang string, vector_search_weight double, initial_retrieval_k int, broad_query_mode string")
    for name, kind in (("rerank_top_k", "int"), ("rerank_threshold", "double"), ("chunk_size", "int"), ("chunk_overlap", "int"), ("link_header", "string")):
        c = c.withColumn(name, F.lit(None).cast(kind))
    got = {r.vault: r for r in V.with_defaults(c).collect()}
    d = V.VaultConfig()
    assert (got["a"].lang, got["a"].vector_search_weight, got["a"].initial_retrieval_k, got["a"].broad_query_mode, got["a"].link_header) == (d.lang, d.vector_search_weight, d.initial_retrieval_k, d.broad_query_mode, d.link_header)
    assert (got["b"].lang, got["b"].vector_search_weight, got["b"].initial_retrieval_k, got["b"].broad_query_mode) == ("ru", 0.25, 7, "summary")


def test_link_contexts_unscored_come_in_text_order(spark, rows):
    pages = spark.createDataFrame([("p", "The ion trap hums. Nothing here. An ion trap again. The ion trap hums.")], "page string, text string")
    titles = spark.createDataFrame([("p", "ion_trap")], "page string, title string")
    assert rows(Q.link_contexts(pages, titles, scored=False), "rank_no", "sentence", "score") == [(1, "The ion trap hums.", None), (2, "An ion trap again.", None)]


def test_evaluation_figures(spark):
    contexts = spark.createDataFrame([(1, 1, "mill river wheel"), (1, 2, "moss")], "query_id int, rank_no int, text string")
    qa = spark.createDataFrame([(1, "q", "mill river frost"), (2, "q", "no context"), (3, "q", None)], "query_id int, question string, reference string")
    r = Q.evaluate_answers(contexts, qa, 1).collect()
    assert len(r) == 1 and r[0].n_contexts == 2
    assert (r[0].context_recall, r[0].context_precision, r[0].faithfulness, r[0].correctness) == (round(2 / 3, 6), 0.0, 1.0, round(2 / 3, 6))
    assert [tuple(x) for x in E.micro_totals(spark.createDataFrame([("s", 1, 1, 0), ("s", 1, 0, 1)], "k string, tp int, fp int, fn int"), "k").select("k", "tp", "fp", "fn").collect()] == [("s", 2, 1, 1)]


def test_retries_wait_as_asked_and_give_up(spark):
    waits, calls = [], []

    def call(errors):
        def run():
            calls.append(1)
            if errors:
                raise RuntimeError(errors.pop(0))
            return "ok"

        return run

    assert M.retrying(call(["429 {'retryDelay': '2.5s'}", "503"]), 3, 1.0, sleep=waits.append) == "ok" and waits == [3.5, 2.0]
    with pytest.raises(RuntimeError):
        M.retrying(call(["bad input"]), 3, sleep=waits.append)
    with pytest.raises(RuntimeError):
        M.retrying(call(["503"] * 5), 2, sleep=waits.append)
    assert M.retrying(call(["bad input"]), 3, every=True, sleep=waits.append) == "ok"


def test_discoverers_and_seeds_of_the_own_vault(spark, rows):
    e = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("c", "a")], "src string, dst string")
    got = rows(G.bfs(spark.createDataFrame([(1, "b"), (1, "a")], "query_id int, node string"), e, 2, discoverer=True), "node", "depth", "via")
    assert got == [("a", 0, None), ("b", 0, None), ("c", 1, "a"), ("d", 2, "c")]
    entities = spark.createDataFrame([("v:mill", "v", "old mill"), ("w:mill", "w", "old mill"), ("w:river", "w", "river")], "node string, vault string, display_name string")
    q = spark.createDataFrame([(1, "where does the mill stand", "w")], "query_id int, question string, vault string")
    assert rows(R.entity_seeds(q, entities, 1), "node", "score") == [("w:mill", 1)]
    assert rows(R.entity_seeds(q.drop("vault"), entities, 5), "node") == [("v:mill",), ("w:mill",)]


def test_export_takes_other_files_along(spark, tmp_path):
    from skein.sources import sinks

    (tmp_path / "in" / "v" / ".git").mkdir(parents=True)
    for name in ("v/a.md", "v/picture.png", "v/run.log", "v/.git/config"):
        (tmp_path / "in" / name).write_text("x")
    notes = spark.createDataFrame([("v", "a.md", "text")], "vault string, rel_path string, content string")
    links = spark.createDataFrame([("v/a.md", ["- Uses:: [[b]]"])], "source_path string, links array<string>")
    sinks.save_links(notes, links, "export", str(tmp_path / "out"), str(tmp_path / "in"))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["v/a.md", "v/picture.png"]
    assert (tmp_path / "out" / "v" / "a.md").read_text().endswith("- Uses:: [[b]]")
    assert open(sinks.save_page(str(tmp_path / "pages"), "sub/Page", "body")).read() == "body"


def test_entity_seeds_make_no_pairs_of_other_vaults(spark, rows):
    """Pairs of a question and a note of another vault were all made, and broadcast from the driver to be filtered."""
    names = ["old mill", "mill race", "river mill", "wheel", "mil wheel", "stone bridge", "bridges"]
    notes = [(f"{v}:{n}", v, n) for v in ("a", "b", "c", None) for n in names]
    entities = spark.createDataFrame([(n or "", v, d) for n, v, d in notes], "node string, vault string, display_name string")
    asked = [(i, text, v) for i, (text, v) in enumerate([("where is the river mill", "a"), ("mill wheel or bridge", "b"), ("bridges and mills of stone", "c"), ("old mill", "d"), ("old mill", None)])]
    q = spark.createDataFrame(asked, "query_id int, question string, vault string")
    found = R.entity_seeds(q, entities, 3)
    want = []
    for i, text, v in asked:
        terms = {w for w in text.split() if w not in ("where", "and", "the") and len(w) >= 4}
        near = lambda t, w: t == w or (len(t) > 5 and abs(len(t) - len(w)) <= 1 and any(t[:j] + t[j + 1 :] in (w, w[:j] + w[j + 1 :]) or t == w[:j] + w[j + 1 :] for j in range(max(len(t), len(w)))))
        hits = sorted((-sum(any(near(t, w) for w in d.split()) for t in terms), n) for n, u, d in notes if v is not None and u == v)
        want += [(i, n, -s, r + 1) for r, (s, n) in enumerate([h for h in hits if h[0] < 0][:3])]
    assert want and rows(found, "query_id", "node", "score", "rank_no") == sorted(want, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    pairs = S.fulltext(q, entities, "query_id", "question", "node", "display_name", group="vault")
    assert {(r.query_id, r.node) for r in pairs.collect()} <= {(i, n) for i, _, v in asked for n, u, _ in notes if u == v and v is not None}


def test_queries_that_reach_the_same_nodes_share_their_documents(spark, rows, monkeypatch):
    """Each question was joined with every document that mentions a node it reaches, though most questions reach the same nodes."""
    ring = [(f"n{i}", f"n{(i + 1) % 6}", "Uses") for i in range(6)]
    edges = spark.createDataFrame([*ring, ("x", "y", "Uses"), ("y", "y", "Uses"), ("n0", "x", "MENTIONS"), ("p0", "p1", "Uses"), ("p1", "p2", "Uses"), ("p2", "p3", "Uses"), ("p3", "p4", "Uses")], "src string, dst string, relation string")
    starts = [(i, f"n{i % 6}") for i in range(12)] + [(1, "n4"), (12, "x"), (13, "y"), (13, "n1"), (14, "x"), (14, "n2"), (14, "n2"), (15, "alone"), (16, "p0"), (17, "p1"), (18, "p0"), (18, "p4"), (19, "p1"), (19, "p4"), (20, "alone")]
    seeds = spark.createDataFrame(starts, "query_id long, node string")
    kinds, reached = G.shared_neighbourhoods(seeds, edges, 3)
    each = rows(kinds.join(reached, "kind"), "query_id", "node")
    assert each == rows(G.khop_undirected(seeds, edges, 3), "query_id", "node")
    sets = {q: frozenset(n for p, n in each if p == q) for q, _ in each}
    assert len({kind for _, kind in rows(kinds, "query_id", "kind")}) == len(set(sets.values())) < len(sets)
    assert rows(kinds, "query_id") == [(q,) for q in sorted(sets, key=lambda q: repr((q,)))]

    chunks = spark.createDataFrame([(i, f"v/{i}.md", 0, f"the n{i % 6} stands near") for i in range(20)], "chunk_id long, file_path string, chunk_index int, text string")
    mentions = spark.createDataFrame([(i, f"n{i % 6}") for i in range(20)] + [(3, "n0")], "doc long, entity string")
    nodes = [(f"n{i}", f"stone{i}") for i in range(6)]
    entities = spark.createDataFrame(nodes, "node string, display_name string")
    questions = spark.createDataFrame([(i, f"about stone{i % 6}") for i in range(30)], "query_id long, question string")
    asked, documents = [], G.documents_of_entities
    monkeypatch.setattr(G, "documents_of_entities", lambda m, s: asked.append(s.count()) or documents(m, s))
    got = rows(R.run_property_graph(questions, chunks, entities, mentions, edges, top=2), "query_id", "rank_no", "text_key", "score")
    assert asked == [6]  # one set of six nodes, not one a question
    assert got == sorted([(i, r, t, s) for i in range(30) for r, t, s in [(1, "the n3 stands near", 1.0), (2, "the n0 stands near", 0.5)]], key=repr)
