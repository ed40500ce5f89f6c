"""Cutting texts into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from skein.functions import text as X

# Separators of the recursive splitter, tried in this order (fixed values).
SEPARATORS = ["\n# ", "\n## ", "\n### ", "\n\n", ". ", "? ", "! ", "\n", " ", ""]
CHUNK_SIZE, CHUNK_OVERLAP = 3000, 300


def sentences(c: Column) -> Column:
    """Sentences of a text: split behind . ! ? before white space and at line ends; trimmed, blanks dropped."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence), idx from 0."""
    return df.select(key, F.posexplode(sentences(F.col(text))).alias("idx", "sentence"))


def sentence_windows(df: DataFrame, key: str, text: str, before: int = 1, after: int = 1) -> DataFrame:
    """(key, idx, window): each sentence with its neighbours, joined by a space; no shuffle, the window is a slice of the row's own array."""
    s = df.select(key, sentences(F.col(text)).alias("_s")).filter(F.size("_s") > 0)
    first = lambda i: F.greatest(i + 1 - before, F.lit(1))
    windows = F.transform("_s", lambda x, i: F.array_join(F.slice("_s", first(i), F.least(i + 1 + after, F.size("_s")) - first(i) + 1), " "))
    return s.select(key, F.posexplode(windows).alias("idx", "window"))


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most size characters: cut by the first separator that occurs (it stays with the piece behind it), longer pieces cut on by the next ones, neighbours merged up to size with at most overlap characters repeated."""
    seps = SEPARATORS if separators is None else separators

    def pieces(s: str, at: int) -> list[str]:
        if len(s) <= size:
            return [s]
        while at < len(seps) and seps[at] and seps[at] not in s[1:]:
            at += 1
        if at >= len(seps) or not seps[at]:
            return [s[i : i + size] for i in range(0, len(s), size)]
        sep, cuts, pos = seps[at], [0], s.find(seps[at], 1)
        while pos >= 0:
            cuts.append(pos)
            pos = s.find(sep, pos + len(sep))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(s)]):
            if b > a:
                out += [s[a:b]] if b - a <= size else pieces(s[a:b], at + 1)
        return out

    chunks: list[str] = []
    window: list[str] = []
    total = 0
    for p in pieces(text, 0):
        if window and total + len(p) > size:
            chunks.append("".join(window))
            while window and (total > overlap or total + len(p) > size):
                total -= len(window.pop(0))
        window.append(p)
        total += len(p)
    if window:
        chunks.append("".join(window))
    return [c for c in (c.strip() for c in chunks) if c]


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, idx, chunk) by the recursive splitter (a Pandas UDF: the recursion has no built-in form)."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: split_recursive(t, size, overlap) if t else []), T.ArrayType(T.StringType()))
    return df.select(key, udf(F.col(text)).alias("_c")).select(key, F.posexplode("_c").alias("idx", "chunk"))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, idx, chunk): windows of size characters, each starting size - overlap behind the last; all JVM-side."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step))).cast("int")
    starts = F.sequence(F.lit(0), n - 1)
    parts = F.transform(starts, lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    return df.filter(F.length(text) > 0).select(key, F.posexplode(parts).alias("idx", "chunk"))


def chunk_ids(chunks: DataFrame, source: str, index: str) -> DataFrame:
    """Chunks with chunk_key "source::index" and previous_key, null for the first of a source."""
    key = lambda i: F.format_string("%s::%d", F.col(source), i)
    prev = F.lag(index).over(W.partitionBy(source).orderBy(index))
    return chunks.withColumn("chunk_key", key(F.col(index))).withColumn("_p", prev).withColumn("previous_key", F.when(F.col("_p").isNotNull(), key(F.col("_p")))).drop("_p")


def next_chunk_edges(chunks: DataFrame, source: str, index: str) -> DataFrame:
    """(src_key, dst_key): each chunk to the one behind it in its source, once."""
    return chunk_ids(chunks, source, index).filter("previous_key IS NOT NULL").select(F.col("previous_key").alias("src_key"), F.col("chunk_key").alias("dst_key")).distinct()


def with_next_text(chunks: DataFrame, source: str, index: str, text: str, *ties: str) -> DataFrame:
    """Chunks with text_next: their text, a line break and the next chunk's text where there is one; ties order chunks of one index."""
    nxt = F.lead(text).over(W.partitionBy(source).orderBy(index, *ties))
    return chunks.withColumn("text_next", F.concat(F.col(text), F.coalesce(F.concat(F.lit("\n"), nxt), F.lit(""))))


def batches(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """df with batch_no: within each key, rows in order, n to a batch, from 0."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return df.withColumn("batch_no", F.floor((rank - 1) / n).cast("int"))


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """The newest row of each (file_path, chunk_index): re-indexed rows replace older ones; equal or missing times go by id."""
    newest = W.partitionBy("file_path", "chunk_index").orderBy(F.desc_nulls_last("indexed_at"), F.desc("chunk_id"))
    return chunks.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(file_path, summary, summary_lemmas) of each file's first chunk."""
    low = chunks.groupBy("file_path").agg(F.min_by(F.struct("text", "text_lemmatized"), F.struct("chunk_index", "chunk_id")).alias("_c"))
    return low.select("file_path", F.col("_c.text").alias("summary"), F.col("_c.text_lemmatized").alias("summary_lemmas"))


def entity_names(entities: DataFrame) -> DataFrame:
    """(rel_path, name): title and aliases of entities (rel_path, title, aliases)."""
    return entities.select("rel_path", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))


def alias_map(entities: DataFrame) -> DataFrame:
    """(alias, paths): cleaned aliases and the sorted paths they may mean."""
    named = entity_names(entities).select("rel_path", X.alias_key(F.col("name")).alias("alias")).filter("alias <> ''")
    return named.groupBy("alias").agg(F.array_sort(F.collect_set("rel_path")).alias("paths"))
