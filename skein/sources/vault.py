"""Notes, JSON files and vault configuration as DataFrames."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.functions import text as X

GOLD_SCHEMA = "entity string, source_file string, sentence string, is_direct_mention boolean, link_type string"
QA_SCHEMA = "question string, answer string, relevant_docs array<string>, vault string"
CANDIDATE_SCHEMA = "source_path string, source_content string, target_path string, target_content string, vector_distance double, reranker_score double, llm_type string, llm_reasoning string"
RESULT_SCHEMA = "sample_name string, source_file string, entity string, true_type string, predicted_type string, reasoning string"


@dataclass
class VaultConfig:
    """Settings of one vault; values that are absent or can't be read keep their defaults."""

    lang: str = "en"
    link_header: str = X.LINK_HEADER
    relations: list[str] = field(default_factory=lambda: list(X.LINK_TYPES))
    vector_search_weight: float = 1.0
    initial_retrieval_k: int = 15
    broad_query_mode: str = "chunk"
    rerank_top_k: int = 5
    rerank_threshold: float = 0.5
    chunk_size: int = 3000
    chunk_overlap: int = 300

    @classmethod
    def read(cls, path: str) -> VaultConfig:
        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            return cls()
        known = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known and v is not None and (isinstance(v, known[k]) or known[k] is float and isinstance(v, int))}) if isinstance(data, dict) else cls()


def with_defaults(config: DataFrame) -> DataFrame:
    """vault_config rows with the default of every setting that is null, NaN or out of its range; one row a vault (the first by all columns)."""
    d = VaultConfig()
    number = lambda c, default, low: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) >= low), F.col(c)).otherwise(F.lit(default))
    text = lambda c, default: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c)).otherwise(F.lit(default))
    one = config.groupBy("vault").agg(F.min(F.struct(*[c for c in config.columns if c != "vault"])).alias("_c")).select("vault", "_c.*")
    return one.select(
        "vault", text("lang", d.lang).alias("lang"), number("vector_search_weight", d.vector_search_weight, 0).alias("vector_search_weight"), number("initial_retrieval_k", d.initial_retrieval_k, 1).alias("initial_retrieval_k"),
        text("broad_query_mode", d.broad_query_mode).alias("broad_query_mode"), number("rerank_top_k", d.rerank_top_k, 1).alias("rerank_top_k"), number("rerank_threshold", d.rerank_threshold, 0).alias("rerank_threshold"),
        number("chunk_size", d.chunk_size, 1).alias("chunk_size"), number("chunk_overlap", d.chunk_overlap, 0).alias("chunk_overlap"), text("link_header", d.link_header).alias("link_header"),
    )


def resolve_vaults(root: str, names: list[str] | None = None) -> list[str]:
    """Vault folders: the named ones, else the root if it holds notes itself, else its child folders that do; a missing one raises FileNotFoundError."""
    if names:
        found = [os.path.join(root, n) for n in names]
        for p in found:
            if not os.path.isdir(p):
                raise FileNotFoundError(p)
        return found
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    if any(e.endswith(".md") for e in os.listdir(root)):
        return [root]
    return [p for e in sorted(os.listdir(root)) if os.path.isdir(p := os.path.join(root, e)) and any(f.endswith(".md") for _, _, fs in os.walk(p) for f in fs)]


def scan_notes(spark: SparkSession, root: str, ignored: tuple[str, ...] = (".out", ".git", ".trash"), header: str = X.LINK_HEADER, vault: str | None = None) -> DataFrame:
    """notes(vault, rel_path, stem, content, body, links_section, content_hash) of all *.md files below root.

    The files are read by the executors. The first folder below root is the vault unless one is given. Paths with
    an ignored component are left out; line ends become \\n before hashing; the hash covers the body only, so
    links written back don't make a note look changed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = "file:" + os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/"), r"^\Q" + base + r"\E", "")
    rows = files.select(rel.alias("rel"), X.normalise_newlines(F.decode("content", "UTF-8")).alias("content"))
    rows = rows.filter(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, ignored))))
    if vault is None:
        rows = rows.withColumn("vault", F.substring_index("rel", "/", 1)).withColumn("rel_path", F.substring(F.col("rel"), F.length("vault") + 2, F.length("rel")))
    else:
        rows = rows.withColumn("vault", F.lit(vault)).withColumn("rel_path", F.col("rel"))
    stem = F.regexp_replace(F.substring_index("rel_path", "/", -1), r"\.md$", "")
    body = X.note_body(F.col("content"), header)
    return rows.select("vault", "rel_path", stem.alias("stem"), "content", body.alias("body"), X.note_links(F.col("content"), header).alias("links_section"), F.sha2(body, 256).alias("content_hash"))


def load_documents(notes: DataFrame, header_line: str = "## Related Connections", limit: int | None = None) -> DataFrame:
    """(source, source_rel, vault, text): cleaned notes that aren't empty, by vault and path; limit counts across vaults (it is the feature, not a cap)."""
    rows = notes.select(F.concat_ws("/", "vault", "rel_path").alias("source"), F.col("rel_path").alias("source_rel"), "vault", X.clean_for_model(F.col("content"), header_line).alias("text")).filter("text <> ''")
    return rows if limit is None else rows.orderBy("vault", "source_rel").limit(limit)


def entities(notes: DataFrame) -> DataFrame:
    """(rel_path, title, aliases): the title from the stem, aliases from front matter."""
    return notes.select("rel_path", "stem", X.title_of(F.col("rel_path")).alias("title"), F.coalesce(X.parse_aliases(F.col("content")), F.array().cast("array<string>")).alias("aliases"))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON file (an array or one object) or, with lines, JSON lines with blank ones skipped."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    """gold(sample_name, source_file, entity, sentence, is_direct_mention, link_type, ord_no) of all <sample>.json files of a folder; ord_no is the row's place in its file."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    sample = F.regexp_replace(F.substring_index("path", "/", -1), r"\.json$", "")
    rows = whole.select(sample.alias("sample_name"), F.posexplode(F.from_json(F.decode("content", "UTF-8"), f"array<struct<{GOLD_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("ord_no", "_g"))
    return rows.select("sample_name", "_g.source_file", "_g.entity", "_g.sentence", "_g.is_direct_mention", "_g.link_type", "ord_no")
