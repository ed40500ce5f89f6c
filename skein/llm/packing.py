"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.llm.nearcopies import describe, near_clusters
from skein.llm.tokens import token_count
from skein.session import materialize, spread


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, source_share: float = 0.5) -> list[int]:
    """Container number of each item: the tightest container with room that holds none of the item's duplicates nor enough of its source.

    Items are taken from the largest down. Containers are ordered by residual room; the search starts at the
    smallest residual that fits and goes on to its successors until one is compatible by its bitmaps; else a new
    container opens. The source bitmap of a container has the sources that hold source_share of its capacity or more:
    they get no further item there. 0 keeps two items of one source apart always, 1 binds nothing. cluster or source
    -1: none.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    count: dict[int, int] = {}
    for c in clusters:
        count[c] = count.get(c, 0) + 1
    bit = {c: 1 << n for n, c in enumerate(c for c, k in count.items() if k > 1 and c != -1)}
    source_bit = {s: 1 << n for n, s in enumerate(sorted(set(sources) - {-1}))}
    room: list[tuple[int, int]] = []  # (residual, container), ordered
    held: list[list[int]] = []  # bitmaps of each container: duplicate clusters, sources with their share
    by_source: dict[tuple[int, int], int] = {}
    out = [0] * len(sizes)
    for i in order:
        size, cb, sb = sizes[i], bit.get(clusters[i], 0), source_bit.get(sources[i], 0)
        at = bisect_left(room, (size, -1))
        while at < len(room):
            b = room[at][1]
            if not held[b][0] & cb and not held[b][1] & sb:
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= cb
        by_source[b, sb] = by_source.get((b, sb), 0) + size
        if by_source[b, sb] >= source_share * capacity:
            held[b][1] |= sb
        insort(room, (left - size, b))
        out[i] = b
    return out


def _pack(round_no: int, loose_above: float | None, source_share: float):
    """Packs one group; containers with more than loose_above of their capacity free are given back as loose items (container null)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part_no"], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iat[0])
        bins = best_fit(pdf["n_tokens"].tolist(), pdf["cluster"].tolist(), pdf["source_no"].tolist(), capacity, source_share)
        pdf["_bin"] = bins
        fill = pdf.groupby("_bin")["n_tokens"].transform("sum")
        prefix = f"{pdf['container_kind'].iat[0]}-{round_no}-{pdf['shard'].iat[0]}-"
        pdf["container_id"] = [prefix + str(b) for b in bins]
        if loose_above is not None:
            pdf.loc[capacity - fill > loose_above * capacity, "container_id"] = None
        return pdf[["container_kind", "capacity", "container_id", "doc_id", "part_no", "n_tokens", "cluster", "source_no"]]

    return pack


_ITEM = "container_kind string, capacity long, container_id string, doc_id long, part_no int, n_tokens long, cluster long, source_no long"


#: Kinds of containers at most; every document gets a place for each, and their list goes to all tasks.
MAX_KINDS = 1000


def pack_documents(documents: DataFrame, limits: DataFrame, tokenizer: str | None = None, group_rows: int = 20_000, source_share: float = 0.5) -> DataFrame:
    """(container_kind, container_id, doc_id, part_no, n_tokens): an assignment of every document to containers of every kind.

    Sizes are tokens of a public tokenizer. A document beyond the capacity fills whole containers with its first
    parts (part_no from 0, capacity tokens each) and its remainder is packed like any other; no other document is
    split. Method: conflict-constrained best fit (see best_fit); copies of a text, equal after folding case and
    white space, and near copies never share a container of a kind. Near copies have a Jaccard similarity of 0.8 of
    their 5-word shingles (see nearcopies), directly or over others. A source that holds source_share of a container gets
    no further document into it, so no container is filled by one source while others are at hand.

    Documents are packed in groups of about group_rows by hash, so no task sees all of them; containers left more
    than a twentieth empty are opened again and their items packed together in a second round, without the limit on
    sources (what is left then may be of one source only), so neither the groups nor that limit cost much room. Null and empty texts have size 0 and still get a place; a null source is a source; an empty
    table gives an empty result; limits without a positive capacity are left out; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    folded = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), folded.alias("folded"), "text", F.xxhash64(F.coalesce("source", F.lit(""))).alias("source_no"))
    sized = spread(docs).select("doc_id", "folded", token_count(F.col("text"), tokenizer).alias("size"), "source_no")
    described = describe(sized, "size", "source_no")
    near = near_clusters(docs.filter("folded <> ''"), described=described)
    items = described.filter("doc_id IS NOT NULL").select("doc_id", "size", "source_no", "set_id").join(near, "set_id", "left")
    items = materialize(items.select("doc_id", "size", "source_no", F.coalesce("near", "set_id", F.lit(-1)).alias("cluster")), "pack-items")
    kinds = limits.filter(F.col("capacity_tokens") > 0).select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    if len(kinds.limit(MAX_KINDS + 1).collect()) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    cut = items.crossJoin(F.broadcast(kinds)).withColumn("full", F.expr("CASE WHEN size > capacity THEN CAST(size div capacity AS INT) ELSE 0 END"))
    whole = cut.filter("full > 0").select("container_kind", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no"))
    whole = whole.select("container_kind", F.format_string("%s-whole-%d-%d", "container_kind", "doc_id", "part_no").alias("container_id"), "doc_id", "part_no", F.col("capacity").alias("n_tokens"))
    rest = cut.withColumn("left", F.col("size") - F.col("full") * F.col("capacity")).filter("left > 0 OR full = 0")
    rest = rest.select("container_kind", "capacity", "doc_id", F.col("full").alias("part_no"), F.col("left").alias("n_tokens"), "cluster", "source_no")

    n = items.count()
    first = _rounds(rest, n, group_rows, 1, 0.05, source_share)
    first = materialize(first, "pack-first")
    loose = first.filter(F.col("container_id").isNull()).drop("container_id")
    n_loose = loose.groupBy("container_kind").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("m")).first().m
    second = _rounds(loose, n_loose, 2 * group_rows, 2, None, 1.0)
    columns = ["container_kind", "container_id", "doc_id", "part_no", "n_tokens"]
    return whole.select(columns).unionByName(first.filter(F.col("container_id").isNotNull()).select(columns)).unionByName(second.select(columns))


def _rounds(rest: DataFrame, n: int, group_rows: int, round_no: int, loose_above: float | None, source_share: float) -> DataFrame:
    groups = max(1, -(-n // group_rows))
    sharded = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(round_no)), F.lit(groups)).cast("int"))
    return sharded.groupBy("container_kind", "shard").applyInPandas(_pack(round_no, loose_above, source_share), _ITEM)
