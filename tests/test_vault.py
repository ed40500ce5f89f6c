import json
import os

from skein.plans import providers
from skein.sources import sinks, vault
from skein.streaming import incremental as I


def write(root, files):
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8", newline="") as f:
            f.write(text)


def test_scan_and_sinks(spark, rows, tmp_path):
    root = str(tmp_path / "vaults")
    write(root, {"v/a.md": "Body\r\n\r\n## Related Connections\r\n\r\n- x:: [[B]]", "v/sub/b c.md": "B", "v/.out/skip.md": "no", "v/x.txt": "no"})
    n = vault.scan_notes(spark, root)
    assert rows(n, "vault", "rel_path", "stem", "body") == [("v", "a.md", "a", "Body"), ("v", "sub/b c.md", "b c", "B")]
    new = spark.createDataFrame([("v/a.md", ["- a:: [[A]]"])], "source_path string, links array<string>")
    sinks.save_links(n, new, "export", str(tmp_path / "copy"))
    with open(tmp_path / "copy/v/a.md", encoding="utf-8") as f:
        assert f.read() == "Body\n\n## Related Connections\n\n- a:: [[A]]"
    sinks.save_links(n, new, "inplace", root)
    again = vault.scan_notes(spark, root)
    assert rows(again, "rel_path", "content_hash") == rows(n, "rel_path", "content_hash")
    sinks.save_links(n, new, "json", str(tmp_path / "links"))
    assert spark.read.json(str(tmp_path / "links")).count() == 1
    assert vault.load_documents(n).count() == 2 and vault.load_documents(n, limit=1).count() == 1


def test_config_and_vaults(tmp_path):
    write(str(tmp_path), {"one/a.md": "x", "two/readme.txt": "x", "c.json": json.dumps({"lang": "de", "rerank_top_k": "bad", "vector_search_weight": 1})})
    assert [os.path.basename(p) for p in vault.resolve_vaults(str(tmp_path))] == ["one"]
    c = vault.VaultConfig.read(str(tmp_path / "c.json"))
    assert (c.lang, c.rerank_top_k, c.vector_search_weight) == ("de", 5, 1)
    assert vault.VaultConfig.read(str(tmp_path / "none.json")) == vault.VaultConfig()


def test_json_sources(spark, rows, tmp_path):
    write(str(tmp_path), {"gold/s.json": json.dumps([{"entity": "e", "source_file": "f", "sentence": "x", "is_direct_mention": True, "link_type": None}]), "r.jsonl": '{"sample_name": "s"}\n\n{"sample_name": "t"}\n'})
    assert rows(vault.read_gold(spark, str(tmp_path / "gold"))) == [("s", "f", "e", "x", True, None, 0)]
    assert vault.read_json(spark, str(tmp_path / "r.jsonl"), vault.RESULT_SCHEMA, lines=True).filter("sample_name IS NOT NULL").count() == 2


def test_changes_and_reindex(spark, rows):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "9")], "file_path string, hash string")
    state = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, hash string")
    ch = I.changes(files, state)
    assert rows(ch) == [("b", "updated"), ("c", "removed"), ("d", "added")]
    chunks = spark.createDataFrame([("a", 0, "x", "1"), ("b", 0, "y", "1"), ("c", 0, "z", "1")], "file_path string, chunk_index int, text string, file_hash string")
    notes = spark.createDataFrame([("b", "new", "2"), ("d", "  ", "9")], "file_path string, body string, hash string")
    assert rows(I.reindex(chunks, notes, ch)) == [("a", 0, "x", "1"), ("b", 0, "new", "2")]
    assert rows(I.cached(chunks, files), "file_path") == [("a",)]


def test_run_state(tmp_path):
    p = str(tmp_path / "state.json")
    s = I.RunState.load(p)
    s.pending = "pairs"
    s.advance("classify", p, n=3)
    again = I.RunState.load(p)
    assert again.resumable() and again.details == {"n": 3}
    again.clear(p)
    assert I.RunState.load(p).stage == "idle"


def test_stream_reindexes(spark, rows, tmp_path):
    src, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "file_path string, body string, hash string"
    spark.createDataFrame([("a", "first", "1")], schema).write.parquet(src)
    run = lambda: I.stream_changes(spark.readStream.schema(schema).parquet(src), index, str(tmp_path / "cp")).awaitTermination(60)
    run()
    spark.createDataFrame([("a", "second", "2"), ("b", "other", "1")], schema).write.mode("append").parquet(src)
    run()
    want = [("a", "second"), ("b", "other")]
    assert rows(I.read_index(spark, index), "file_path", "text") == want
    for name in os.listdir(tmp_path / "cp" / "commits"):  # the pointer was written, the commit was lost
        if name.lstrip(".").startswith("1"):
            os.remove(tmp_path / "cp" / "commits" / name)
    run()
    assert rows(I.read_index(spark, index), "file_path", "text") == want
    spark.createDataFrame([("a", None, None), ("c", "third", "1")], schema).write.mode("append").parquet(src)
    run()
    assert rows(I.read_index(spark, index), "file_path", "text") == [("b", "other"), ("c", "third")]


def test_segments_are_merged(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT", 2)
    src, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "file_path string, body string, hash string"
    for n in range(4):
        spark.createDataFrame([("a", f"text {n}", str(n)), (f"f{n}", "own", "1")], schema).write.mode("append").parquet(src)
        I.stream_changes(spark.readStream.schema(schema).parquet(src), index, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(I.read_index(spark, index), "file_path", "text") == [("a", "text 3"), *((f"f{n}", "own") for n in range(4))]
    assert len([x for x in os.listdir(index) if not x.startswith((".", "current"))]) <= 3


def test_newest_row_of_a_file_counts(spark, rows):
    files = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None)], "file_path string, hash string")
    state = spark.createDataFrame([("a", "9", 1, 1), ("a", "2", 2, 2), ("b", "1", 1, 3), ("b", "2", None, 4), ("c", "1", 1, 5)], "file_path string, hash string, indexed_at int, chunk_id int")
    assert rows(I.changes(files, state)) == [("c", "updated")]


def test_graph_is_merged_and_wiped(spark, rows, tmp_path):
    path = str(tmp_path / "g")
    n = lambda *r: spark.createDataFrame(list(r), "id string, type string, name string")
    r = lambda *x: spark.createDataFrame(list(x), "src_id string, dst_id string, type string")
    sinks.upsert_graph(n(("a", "Entity", "old"), ("b", "Entity", "b")), r(("a", "b", "USES")), path)
    sinks.upsert_graph(n(("a", "Entity", "new"), ("b", "Entity", None), ("c", "Entity", "c")), r(("a", "b", "USES"), ("b", "c", "USES")), path)
    nodes, rels = sinks.read_graph(spark, path)
    assert rows(nodes, "id", "name") == [("a", "new"), ("b", "b"), ("c", "c")] and rels.count() == 2
    sinks.upsert_graph(n(("d", "Entity", "d")), r(), path, wipe=True)
    assert rows(sinks.read_graph(spark, path)[0], "id") == [("d",)]


def test_fresh_start_keeps_configuration_and_log(spark, tmp_path):
    for name in ("config.json", "run.log", "state.json"):
        (tmp_path / name).write_text("{}")
    (tmp_path / "index").mkdir()
    notes = spark.createDataFrame([("v", "a.md", "text\n\n## Related Connections\n\n- Uses:: [[b]]")], "vault string, rel_path string, content string")
    assert I.fresh_start(spark, str(tmp_path), notes=notes).first().content == "text"
    assert sorted(os.listdir(tmp_path)) == ["config.json", "run.log"]


def test_candidate_dumps(spark, rows, tmp_path):
    c = spark.createDataFrame([("a", 1.0), ("b", 0.1)], "source_path string, score double")
    sinks.dump_candidates(c, c.limit(0), str(tmp_path))
    assert rows(spark.read.json(str(tmp_path / "before")), "source_path") == [("a",), ("b",)] and not os.path.exists(tmp_path / "after")


def test_providers(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("s", "t", ["it depends on x"]), ("s", "u", ["nothing"])], "source_path string, target_path string, contexts array<string>")
    assert rows(providers.CueClassifier().classify(df), "target_path", "relation_type") == [("t", "uses"), ("u", "no link")]
    v = spark.createDataFrame([("a b a",), ("",)], "t string").select(providers.HashEmbedder(8).vector(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and set(v[1].v) == {0.0}
    chunks = spark.createDataFrame([("c1", "v", "the ion trap")], "k string, vault string, t string")
    nodes, rels = providers.extract_triples(chunks, spark.createDataFrame([("ion trap", "ion_trap")], "alias string, rel_path string"), "k", "t")
    assert rows(nodes, "id", "display_name") == [("v:Ion Trap", "ion trap")] and rels.count() == 1
