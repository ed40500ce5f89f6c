from skein.plans import preparation as R
from skein.plans.providers import CueClassifier
from skein.sources.vault import VaultConfig


def test_fetch_drops_failures(spark, rows):
    def fetch(title):
        if title == "bad":
            raise OSError("down")
        return {"summary": "s", "text": "t", "links": ["x"]} if title != "none" else None

    got = R.fetch_pages(spark.createDataFrame([("a",), ("bad",), ("none",), ("a",)], "title string"), fetch, 2, 0.0)
    assert rows(got) == [("a", "s", "t", ["x"])]


def test_crawl_candidates(spark, rows):
    pages = spark.createDataFrame([("Mill", "old mill", 0), ("File:x", "mill", 1), ("Seen", "mill", 2), ("Far", "nothing", 3)], "title string, summary string, ord int")
    assert rows(R.crawl_candidates("mill river", pages, spark.createDataFrame([("Seen",)], "title string"))) == [("Mill", 0.5)]


def test_link_contexts(spark, rows):
    pages = spark.createDataFrame([("p", "The old mill burned. Nobody saw it. The mill was old.\nThe old mill burned.\n== See also\nold mill")], "page string, text string")
    titles = spark.createDataFrame([("p", "Old_mill"), ("p", "Iron bridge")], "page string, title string")
    assert rows(R.titles_in_text(pages, titles)) == [("p", "Old_mill")]
    assert rows(R.link_contexts(pages, titles), "rank_no", "sentence") == [(1, "The old mill burned."), (2, "The mill was old.")]


def test_classification_resumes(spark, rows, tmp_path):
    done = str(tmp_path / "done")
    c = spark.createDataFrame([(1, "v/a.md", "v/b.md", "it depends on x", 0.9), (2, "v/a.md", "v/c.md", "nothing", 0.5)], "pair_id int, source_path string, target_path string, target_content string, reranker_score double")
    assert rows(R.build_links(c, done, CueClassifier())) == [("v/a.md", ["- uses:: [[b]]"])]

    class Fails:
        def classify(self, pairs):
            assert pairs.count() == 0  # nothing is pending any more
            return CueClassifier().classify(pairs)

    assert rows(R.build_links(c, done, Fails())) == [("v/a.md", ["- uses:: [[b]]"])]


def test_config_precedence():
    saved = VaultConfig(lang="ru", rerank_top_k=9)
    assert R.effective_config(saved).lang == "ru"
    assert R.effective_config(saved, fresh=True).rerank_top_k == 5
    assert R.effective_config(saved, broad_query_mode="title_summary", lang=None).broad_query_mode == "title_summary"


def test_context_recall(spark, rows):
    ctx = spark.createDataFrame([(1, "old mill"), (1, "river")], "query_id int, text string")
    ref = spark.createDataFrame([(1, "old river bridge boat"), (2, "x")], "query_id int, reference string")
    assert rows(R.context_recall(ctx, ref)) == [(1, 0.5), (2, 0.0)]
