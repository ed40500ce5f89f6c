"""Writing notes, links, indexes and checkpoints."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.operators import links as L
from skein.session import read_path, remove_path, write_path

SAVE_MODES = ("inplace", "json", "export")


def write_notes(notes: DataFrame, root: str) -> int:
    """Write (vault, rel_path, content) as files below root, partition by partition on the executors; the number of files written. root must be a folder all executors share."""

    def write(batches):
        import pandas as pd

        n = 0
        for pdf in batches:
            for vault, rel, content in zip(pdf["vault"], pdf["rel_path"], pdf["content"]):
                path = os.path.join(root, vault, rel) if vault else os.path.join(root, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                tmp = path + ".tmp"
                with open(tmp, "w", encoding="utf-8", newline="\n") as f:
                    f.write(content or "")
                os.replace(tmp, path)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return notes.select("vault", "rel_path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def copy_others(root: str, target: str, ignored: tuple[str, ...] = (".out", ".git", ".trash")) -> int:
    """Copy what a vault holds besides notes (attachments, settings), but no log files and nothing below an ignored folder; the number of files."""
    n = 0
    for where, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if d not in ignored]
        for f in files:
            if not f.endswith((".md", ".log")):
                place = os.path.join(target, os.path.relpath(where, root))
                os.makedirs(place, exist_ok=True)
                shutil.copy2(os.path.join(where, f), os.path.join(place, f))
                n += 1
    return n


def save_links(notes: DataFrame, links: DataFrame, mode: str, target: str, root: str | None = None) -> None:
    """Save links (source_path, links): into the notes, as JSON, or as an enriched copy of the vaults whose old generated links are cleared; root is the vaults' folder, whose other files the copy gets as well."""
    if mode not in SAVE_MODES:
        raise ValueError(f"mode must be one of {SAVE_MODES}")
    if mode == "json":
        links.select("source_path", "links").write.mode("overwrite").json(target)
    elif mode == "inplace":
        write_notes(L.upsert_links(notes, links), target)
    else:
        shutil.rmtree(target, ignore_errors=True)
        cleared = notes.drop("content").join(L.clear_links(notes), ["vault", "rel_path"])
        write_notes(L.upsert_links(cleared, links), target)
        if root is not None:
            copy_others(root, target)


def replace_files(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks without those of changed files (file_path), and the fresh ones."""
    kept = chunks.join(changed.select("file_path").distinct(), "file_path", "left_anti")
    return kept.unionByName(fresh.select(*chunks.columns))


def write_table(df: DataFrame, path: str, partition: str | None = None, files: int | None = None) -> None:
    """Overwrite a Parquet table; files compacts it to about that many files."""
    w = (df if files is None else df.repartition(files)).write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_by_strategy(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").partitionBy("strategy").json(path)


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One node for each id of old and new: the columns of the new one, where it has them; the first by type where several are new."""
    rest = [c for c in new.columns if c != "id"]
    both = old.select("id", *rest, F.lit(1).alias("_age")).unionByName(new.select("id", *rest, F.lit(0).alias("_age")))
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_age", "type"))).alias(c)
    return both.groupBy("id").agg(*map(best, rest))


def merge_rels(old: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct relationships of both."""
    return old.select(*new.columns).unionByName(new).distinct()


def upsert_graph(nodes: DataFrame, rels: DataFrame, path: str, wipe: bool = False) -> None:
    """Merge nodes (id, type, ...) and relationships into the graph at path; wipe starts it anew.

    The merged tables are written beside the old ones and named in graph.json at the end, so readers never see half a graph.
    """
    spark = nodes.sparkSession
    state = {} if wipe else load_state(f"{path}/graph.json", spark)
    version = load_state(f"{path}/graph.json", spark).get("version", 0) + 1
    if state:
        nodes, rels = merge_nodes(spark.read.parquet(f"{path}/nodes-{state['version']}"), nodes), merge_rels(spark.read.parquet(f"{path}/rels-{state['version']}"), rels)
    else:
        nodes, rels = merge_nodes(nodes.limit(0), nodes), rels.distinct()
    nodes.write.mode("overwrite").parquet(f"{path}/nodes-{version}")
    rels.write.mode("overwrite").parquet(f"{path}/rels-{version}")
    save_state(f"{path}/graph.json", {"version": version}, spark)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, relationships) as last written."""
    version = load_state(f"{path}/graph.json", spark)["version"]
    return spark.read.parquet(f"{path}/nodes-{version}"), spark.read.parquet(f"{path}/rels-{version}")


def dump_candidates(before: DataFrame, after: DataFrame, path: str) -> None:
    """Write the candidates as found and as reranked, as JSON lines beside each other; an empty dump leaves no file behind."""
    for name, df in (("before", before), ("after", after)):
        df.write.mode("overwrite").json(f"{path}/{name}")
        if df.sparkSession.read.text(f"{path}/{name}").isEmpty():
            remove_path(df.sparkSession, f"{path}/{name}")


def save_state(path: str, state: dict, spark: SparkSession | None = None) -> None:
    """Write a state file atomically; with a session on any file system Hadoop knows, else on the local one."""
    if spark is not None:
        return write_path(spark, path, json.dumps(state, ensure_ascii=False, indent=2))
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(state, f, ensure_ascii=False, indent=2)
    os.replace(path + ".tmp", path)


def load_state(path: str, spark: SparkSession | None = None) -> dict:
    """The state in a file, {} where there is none or it can't be read."""
    try:
        if spark is not None:
            data = json.loads(read_path(spark, path) or "{}")
        else:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
        return data if isinstance(data, dict) else {}
    except (OSError, ValueError):
        return {}


def append_done(done: DataFrame, path: str) -> None:
    """Append finished keys to a checkpoint table (Parquet's commit protocol makes each append all or nothing)."""
    done.write.mode("append").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append evaluation rows as JSON lines."""
    results.write.mode("append").json(path)


def save_page(root: str, name: str, text: str) -> str:
    """Write one page below root; the path."""
    path = os.path.join(root, f"{name}.md")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(path + ".tmp", path)
    return path


def move_note(root: str, old: str, new: str) -> None:
    target = os.path.join(root, new)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    os.replace(os.path.join(root, old), target)
