"""Incremental indexing: change detection, cascading removal, re-indexing, run state, and the same over a file stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.operators import chunking as C, links as L
from skein.session import list_path, remove_path
from skein.sources import sinks

STAGES = ("idle", "diff", "index", "retrieve", "group", "classify", "export", "done")


def changes(files: DataFrame, state: DataFrame, newest: tuple[str, ...] = ("indexed_at", "chunk_id")) -> DataFrame:
    """(file_path, change): added, removed or updated files of (file_path, hash) against the stored state; unchanged ones are left out.

    Of several rows of a file in the state the newest counts, by those of the columns `newest` that it has (null is
    oldest), then by hash. A null hash differs from any other.
    """
    now = files.groupBy("file_path").agg(F.max("hash").alias("_n"), F.lit(True).alias("_new"))
    order = F.struct(*(c for c in newest if c in state.columns), "hash")
    old = state.groupBy("file_path").agg(F.max_by("hash", order).alias("_o"), F.lit(True).alias("_old"))
    both = now.join(old, "file_path", "full_outer")
    kind = F.when(F.col("_old").isNull(), F.lit("added")).when(F.col("_new").isNull(), F.lit("removed")).when(~F.col("_n").eqNullSafe(F.col("_o")), F.lit("updated"))
    return both.select("file_path", kind.alias("change")).filter("change IS NOT NULL")


def remove(table: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of a table (metadata or index) whose file is neither removed nor updated."""
    return table.join(changed.filter("change IN ('removed', 'updated')").select("file_path"), "file_path", "left_anti")


def cached(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose (file_path, file_hash) is still current: they needn't be made again."""
    return chunks.join(files.select("file_path", F.col("hash").alias("file_hash")).distinct(), ["file_path", "file_hash"], "left_semi")


def reindex(chunks: DataFrame, notes: DataFrame, changed: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(file_path, chunk_index, text, file_hash): the kept chunks and those of added or updated notes (file_path, body, hash); empty notes give none.

    cut makes (file_path, idx, chunk) of notes, the recursive splitter by default.
    """
    todo = changed.filter("change IN ('added', 'updated')").select("file_path")
    own = notes.join(todo, "file_path", "left_semi").filter(F.coalesce(F.trim("body"), F.lit("")) != "")
    fresh = (cut(own) if cut else C.recursive_chunks(own, "file_path", "body", size, overlap)).join(own.select("file_path", F.col("hash").alias("file_hash")), "file_path")
    fresh = fresh.select("file_path", F.col("idx").alias("chunk_index"), F.col("chunk").alias("text"), "file_hash")
    return remove(chunks.select("file_path", "chunk_index", "text", "file_hash"), changed).unionByName(fresh)


@dataclass
class RunState:
    """Where a run stands; written after every stage so that a new run resumes pending pairs first."""

    stage: str = "idle"
    details: dict = field(default_factory=dict)
    pending: str | None = None
    done: int = 0
    total: int = 0

    @classmethod
    def load(cls, path: str) -> RunState:
        data = sinks.load_state(path)
        state = cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})
        return state if state.stage in STAGES else cls()

    def advance(self, stage: str, path: str, **details) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        self.stage = stage
        self.details.update(details)
        sinks.save_state(path, asdict(self))

    def resumable(self) -> bool:
        return bool(self.pending) and self.stage in ("classify", "group")

    def clear(self, path: str) -> None:
        self.__init__()
        sinks.save_state(path, asdict(self))


COMPACT = 16


def _segment(base: str, name: str) -> tuple[str, str]:
    return f"{base}/{name}/chunks", f"{base}/{name}/files"


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """(file_path, chunk_index, text, file_hash): the index that stream_changes keeps; a file's chunks are those of the last segment that names it."""
    names = sinks.load_state(f"{index_path}/current.json", spark).get("segments", [])
    return _merged(spark, index_path, names)[0]


def _merged(spark: SparkSession, index_path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks, files still there) of segments, later ones winning."""
    chunks = spark.createDataFrame([], _CHUNK + ", seq int")
    files = spark.createDataFrame([], "file_path string, change string, seq int")
    for n, name in enumerate(names):
        c, f = _segment(index_path, name)
        chunks = chunks.unionByName(spark.read.schema(_CHUNK).parquet(c).withColumn("seq", F.lit(n)))
        files = files.unionByName(spark.read.schema("file_path string, change string").parquet(f).withColumn("seq", F.lit(n)))
    last = files.groupBy("file_path").agg(F.max("seq").alias("seq"), F.max_by("change", "seq").alias("change")).filter("change <> 'removed'")
    return chunks.join(last.select("file_path", "seq"), ["file_path", "seq"]).drop("seq"), last.select("file_path", "change")


_CHUNK = "file_path string, chunk_index int, text string, file_hash string"


def stream_changes(stream: DataFrame, index_path: str, checkpoint: str, available_now: bool = True):
    """Re-index a stream of notes (file_path, body, hash, perhaps changed_at): each micro-batch replaces the chunks of its files.

    A batch writes one segment, its files and their chunks, and then the pointer file, which lists the segments; nothing
    else is rewritten until COMPACT segments are merged into one. A batch that is run again after a failure finds its own
    number in the pointer and starts from the segments before it, so the index is the same however often it runs. A row
    with a null hash removes its file. Of several rows of a file in a batch the one with the latest changed_at counts, or
    the largest hash where there is no such column. Both paths may be on any file system Hadoop knows.
    """
    pointer = f"{index_path}/current.json"

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = sinks.load_state(pointer, spark)
        before = state.get("before", []) if state.get("epoch") == epoch else state.get("segments", [])
        order = F.struct(*(c for c in ("changed_at",) if c in batch.columns), "hash")
        latest = batch.groupBy("file_path").agg(F.max_by(F.struct("body", "hash"), order).alias("_n")).select("file_path", "_n.*")
        changed = latest.select("file_path", F.when(F.col("hash").isNull(), F.lit("removed")).otherwise(F.lit("updated")).alias("change"))
        chunks, files = _segment(index_path, f"v{epoch}")
        reindex(spark.createDataFrame([], _CHUNK), latest, changed).write.mode("overwrite").parquet(chunks)
        changed.write.mode("overwrite").parquet(files)
        segments = [*before, f"v{epoch}"]
        if len(segments) >= COMPACT:
            merged, kept = _merged(spark, index_path, segments)
            chunks, files = _segment(index_path, f"v{epoch}-all")
            merged.write.mode("overwrite").parquet(chunks)
            kept.write.mode("overwrite").parquet(files)
            segments = [f"v{epoch}-all"]
        sinks.save_state(pointer, {"segments": segments, "before": before, "epoch": epoch}, spark)
        for name in {*state.get("before", []), *state.get("segments", []), f"v{epoch}"} - {*segments, *before}:
            remove_path(spark, f"{index_path}/{name}")

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def fresh_start(spark: SparkSession, folder: str, keep: tuple[str, ...] = ("config.json", "run.log"), notes: DataFrame | None = None) -> DataFrame | None:
    """Forget an earlier run: everything in its folder but its configuration and log goes; notes (vault, rel_path, content), if given, come back without generated links."""
    for path in list_path(spark, folder):
        if path.rstrip("/").rsplit("/", 1)[-1] not in keep:
            remove_path(spark, path)
    return None if notes is None else L.clear_links(notes)
