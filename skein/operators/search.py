"""Vector, full-text, hybrid and phrase search for many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skein.functions import text as X
from skein.session import materialize, spread

K1, B = 1.2, 0.75
#: Queries whose vectors one pass over the items carries; larger query sets take several passes.
QUERY_BLOCK = 8192


def top_k(df: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank_no") -> DataFrame:
    """The first k rows of each value of by, with their rank from 1; k rows a task and value survive before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def knn(queries: DataFrame, items: DataFrame, k: int, metric: str = "l2", exclude: bool = True) -> DataFrame:
    """(query_id, item_id, distance, rank_no): the k nearest items (item_id, vector, grp) of each query (query_id, vector, grp).

    metric l2 is the squared Euclidean distance, cosine is 1 - cosine. exclude leaves out items of the query's own
    grp, before the cut. Queries are a stated set: they go to the tasks in blocks of QUERY_BLOCK vectors, each task
    keeps k items a query of its rows, so no pairs of all rows are formed. Ties go to the smaller item_id. Null or
    odd-sized vectors don't take part.
    """
    spark = items.sparkSession
    q = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector", F.xxhash64(F.coalesce(F.col("grp").cast("string"), F.lit("\u0000"))).alias("grp"))
    it = items.filter(F.col("vector").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "vector", F.xxhash64(F.coalesce(F.col("grp").cast("string"), F.lit("\u0000"))).alias("grp"))
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        own = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        t = own.toArrow()
        dim = max((len(v) for v in t["vector"].to_pylist()), default=0)
        rows = [i for i, v in enumerate(t["vector"].to_pylist()) if len(v) == dim and all(x is not None for x in v)]
        shared = spark.sparkContext.broadcast((np.array([t["query_id"][i].as_py() for i in rows], dtype=np.int64), np.array([t["vector"][i].as_py() for i in rows], dtype=np.float64).reshape(len(rows), dim), np.array([t["grp"][i].as_py() for i in rows], dtype=np.int64)))
        parts.append(it.mapInArrow(_nearest(shared, dim, k, metric, exclude), "query_id long, item_id long, distance double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_k(found, "query_id", [F.asc("distance"), F.asc("item_id")], k)


def _nearest(shared, dim: int, k: int, metric: str, exclude: bool):
    def run(batches):
        ids, q, grp = shared.value
        if not len(ids):
            return
        for batch in batches:
            vec = batch.column("vector")
            lengths = vec.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(lengths == dim)
            if not len(at):
                continue
            x = vec.take(pa.array(at)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1)
            at, x = at[ok], x[ok]
            item, g = batch.column("item_id").to_numpy()[at], batch.column("grp").to_numpy()[at]
            for s in range(0, len(q), 512):
                a = q[s : s + 512]
                if metric == "cosine":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = 1.0 - (a @ x.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(x, axis=1))
                else:
                    d = np.maximum((a**2).sum(axis=1)[:, None] - 2 * (a @ x.T) + (x**2).sum(axis=1)[None, :], 0.0)
                d[np.isnan(d)] = np.inf
                if exclude:
                    d[grp[s : s + 512][:, None] == g[None, :]] = np.inf
                d = np.round(d, 6)
                if d.shape[1] > k:
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                else:
                    i, j = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_pydict({"query_id": ids[s + i], "item_id": item[j], "distance": d[i, j]})

    return run


def within(queries: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(query_id, item_id, similarity): items (item_id, vector) whose cosine with a query (query_id, vector) is at least `least`, rounded to 6 digits; an item isn't like itself.

    Queries are a stated set and go to the tasks in blocks, as in knn. Null, odd-sized and all-zero vectors don't take part.
    """
    spark = items.sparkSession
    q = queries.filter(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    it = items.filter(F.col("vector").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "vector")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        t = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        rows = [(i, v) for i, v in zip(t["query_id"].to_pylist(), t["vector"].to_pylist()) if all(x is not None for x in v) and any(v)]
        dim = max((len(v) for _, v in rows), default=0)
        rows = [r for r in rows if len(r[1]) == dim]
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in rows], dtype=np.int64), np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), dim)))
        part = it.mapInArrow(_alike(shared, dim, least), "query_id long, item_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def _alike(shared, dim: int, least: float):
    def run(batches):
        ids, q = shared.value
        if not len(ids):
            return
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        for batch in batches:
            vec = batch.column("vector")
            at = np.flatnonzero(vec.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
            if not len(at):
                continue
            x = vec.take(pa.array(at)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            item, x = batch.column("item_id").to_numpy()[at[ok]], x[ok]
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for s in range(0, len(q), 512):
                sim = np.round(q[s : s + 512] @ x.T, 6)
                i, j = np.nonzero((sim >= least) & (ids[s : s + 512][:, None] != item[None, :]))
                yield pa.RecordBatch.from_pydict({"query_id": ids[s + i], "item_id": item[j], "similarity": sim[i, j]})

    return run


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, key: str, text: str, k: int) -> DataFrame:
    """(query_id, key, score, rank_no): the k best documents of each query by BM25 (k1 1.2, b 0.75), scores rounded to 6 digits, ties to the smaller key.

    Queries are a stated set: their tokens go to the tasks as posting lists, in blocks of QUERY_BLOCK queries; each
    task adds up the scores of its documents and keeps k a query, so a token that most documents hold is never a
    join key. Document frequencies are counted over all documents for the queries' tokens only. Documents that
    share no token with a query aren't hits; null texts count as documents without tokens.
    """
    spark = docs.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.array_distinct(X.tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("tokens"))
    d = spread(docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))).select("key", X.tokens(F.col("text")).alias("tokens"))
    d = materialize(d, "bm25-tokens")  # statistics, frequencies and scores of every block read them
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    size = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    parts = []
    for b in range(blocks):
        own = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        t = own.toArrow()
        ids = np.array(t["query_id"].to_pylist(), dtype=np.int64)
        lists: dict[str, list[int]] = {}
        for i, toks in enumerate(t["tokens"].to_pylist()):
            for w in toks:
                lists.setdefault(w, []).append(i)
        vocabulary = sorted(lists)
        df = _document_frequencies(d, vocabulary)
        idf = np.array([np.log(1 + (size.n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in vocabulary])
        shared = spark.sparkContext.broadcast((ids, vocabulary, [np.array(lists[w], dtype=np.int64) for w in vocabulary], idf, float(size.mean or 1.0) or 1.0))
        parts.append(d.mapInArrow(_score_bm25(shared, k), "query_id long, key long, score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_k(found, "query_id", [F.desc("score"), F.asc("key")], k).withColumnRenamed("key", key)


def _document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each token of a query block; one row for each token and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def count(batches):
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            doc, tok = _token_ids(batch.column("tokens"), shared.value)
            total += np.bincount(np.unique(doc * len(total) + tok) % len(total), minlength=len(total)) if len(tok) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": shared.value.take(pa.array(at)), "n": total[at]})

    rows = docs.select("tokens").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def _token_ids(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, token number) of every token of a list column that the vocabulary holds."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = pc.index_in(column.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows[ids >= 0], ids[ids >= 0]


def _score_bm25(shared, k: int):
    def run(batches):
        ids, vocabulary, lists, idf, mean = shared.value
        if not len(ids):
            return
        words = pa.array(vocabulary, pa.string())
        floor = np.zeros(len(ids))  # k documents of this task have as much
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                lengths = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                doc, tok = _token_ids(batch.column("tokens"), words)
                if not len(tok):
                    continue
                pair, tf = np.unique(tok * batch.num_rows + doc, return_counts=True)
                tok, doc = pair // batch.num_rows, pair % batch.num_rows
                weight = idf[tok] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
                score = np.zeros((len(ids), batch.num_rows))
                cuts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1], True])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    score[np.ix_(lists[tok[a]], doc[a:b])] += weight[a:b]
                score = np.round(score, 6)
                if score.shape[1] > k:
                    floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
                i, j = np.nonzero((score > 0) & (score >= floor[:, None]))
                yield pa.RecordBatch.from_pydict({"query_id": ids[i], "key": batch.column("key").take(pa.array(j)), "score": score[i, j]})

    return run


def deletions(token: Column) -> Column:
    """The token and all strings that lack one of its letters: two words are within one edit only if these sets meet."""
    cut = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.array_distinct(F.concat(F.array(token), cut))


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, longer_than: int = 5) -> DataFrame:
    """(term, token): the vocabulary tokens a query term matches: itself, and within one edit if it has more than longer_than letters.

    The edit distance is met by an equi-join of deletion neighbourhoods and then checked, so terms and vocabulary are never crossed.
    """
    exact = terms.join(vocabulary.select(F.col("token").alias("_v")), F.col("term") == F.col("_v")).select("term", F.col("_v").alias("token"))
    a = terms.filter(F.length("term") > longer_than).select("term", F.explode(deletions(F.col("term"))).alias("_d"))
    b = vocabulary.filter(F.length("token") >= longer_than).select("token", F.explode(deletions(F.col("token"))).alias("_d"))
    near = a.join(b, "_d").filter(F.levenshtein("term", "token") <= 1).select("term", "token")
    return exact.unionByName(near).distinct()


def fulltext(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, key: str, text: str, k: int | None = None, group: str | None = None) -> DataFrame:
    """(query_id, key, score): number of query terms (see X.query_terms) that a document matches, exactly or within one edit.

    The tokens that the terms of a block of queries match go to the tasks as posting lists, as in bm25, so a token that
    many documents and many queries hold is never a join key. With k each task keeps the k best hits of a query (ties
    of the last one included); the rank over all tasks is left to the caller. With group, a column of both sides, a query
    meets only the documents of its own group (null is no group): the lists are kept by group, so other pairs are never made.
    """
    spark = docs.sparkSession
    own = F.lit("") if group is None else F.col(group).cast("string")
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), own.alias("grp"), F.explode(X.query_terms(F.col(query_text))).alias("term")).filter("grp IS NOT NULL")
    tok = materialize(spread(docs.select(F.col(key).alias("key"), own.alias("grp"), F.coalesce(F.col(text), F.lit("")).alias("text"))).select("key", "grp", F.array_distinct(X.tokens(F.col("text"))).alias("tokens")), "fulltext-tokens")
    match = fuzzy_terms(q.select("term").distinct(), tok.select(F.explode("tokens").alias("token")).distinct())
    asked = materialize(q.join(match, "term").groupBy("query_id", "grp", "term").agg(F.collect_set("token").alias("tokens")), "fulltext-terms")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        t = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        number: dict[tuple[int, str], int] = {}
        owner: list[int] = []
        lists: dict[tuple[str, str], list[int]] = {}
        for n, (i, g, words) in enumerate(zip(t["query_id"].to_pylist(), t["grp"].to_pylist(), t["tokens"].to_pylist())):  # n numbers the (query, term) pairs of the block
            owner.append(number.setdefault((i, g), len(number)))
            for w in words:
                lists.setdefault((g, w), []).append(n)
        groups, vocabulary, order = sorted({g for g, _ in lists}), sorted({w for _, w in lists}), sorted(lists)
        place, word = {g: i for i, g in enumerate(groups)}, {w: i for i, w in enumerate(vocabulary)}
        codes = np.array([place[g] * len(vocabulary) + word[w] for g, w in order], dtype=np.int64)
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in number], dtype=np.int64), np.array(owner, dtype=np.int64), groups, vocabulary, codes, [np.array(lists[x], dtype=np.int64) for x in order]))
        part = tok.mapInArrow(_count_terms(shared, k), f"query_id long, key {tok.schema['key'].dataType.simpleString()}, score long")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key)


def _count_terms(shared, k: int | None):
    def run(batches):
        ids, owner, groups, vocabulary, codes, lists = shared.value
        if not vocabulary:
            return
        words, places = pa.array(vocabulary, pa.string()), pa.array(groups, pa.string())
        sizes = np.array([len(x) for x in lists])
        flat, start = np.concatenate(lists), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                doc, tok = _token_ids(batch.column("tokens"), words)
                place = pc.index_in(batch.column("grp"), value_set=places).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
                code = place * len(vocabulary) + tok  # of a list: its group's number, then its token's
                tok = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                held = (place >= 0) & (codes[tok] == code)
                doc, tok = doc[held], tok[held]
                if not len(tok):
                    continue
                n = sizes[tok]
                at = np.repeat(start[tok] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                term = np.unique(np.repeat(doc, n) * len(owner) + flat[at])  # a term counts once, whichever of its tokens matched
                hit, score = np.unique(term // len(owner) * len(ids) + owner[term % len(owner)], return_counts=True)
                doc, query = hit // len(ids), hit % len(ids)
                if k is not None:
                    order = np.lexsort((-score, query))
                    doc, query, score = doc[order], query[order], score[order]
                    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
                    last = np.minimum(first + k, np.r_[first[1:], len(query)]) - 1
                    keep = score >= np.repeat(score[last], np.diff(np.r_[first, len(query)]))
                    doc, query, score = doc[keep], query[keep], score[keep]
                yield pa.RecordBatch.from_pydict({"query_id": ids[query], "key": batch.column("key").take(pa.array(doc)), "score": score.astype(np.int64)})

    return run


def min_max(df: DataFrame, by: str, score: str, out: str, smaller_better: bool = False) -> DataFrame:
    """df with the score scaled to 0..1 within each query; a query whose scores are all equal has 1."""
    w = W.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    x = (hi - F.col(score)) / (hi - lo) if smaller_better else (F.col(score) - lo) / (hi - lo)
    return df.withColumn(out, F.when(hi > lo, x).otherwise(F.lit(1.0)))


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, weight: float, key: str) -> DataFrame:
    """(query_id, key, score): weight * vector + (1 - weight) * text, each min-max scaled per query, a missing side 0; distances count from the far end."""
    v = min_max(vector_hits, "query_id", "distance", "_v", True).select("query_id", key, "_v")
    t = min_max(text_hits, "query_id", "score", "_t").select("query_id", key, "_t")
    return v.join(t, ["query_id", key], "full_outer").select("query_id", key, F.round(weight * F.coalesce("_v", F.lit(0.0)) + (1 - weight) * F.coalesce("_t", F.lit(0.0)), 6).alias("score"))


def max_norm_fusion(branches: DataFrame) -> DataFrame:
    """(query_id, text_key, score, text) of branch hits (query_id, branch, ord, text, score): scores divided by the branch's best (or 1), summed by the first 120 characters; the text kept is the last in branch, then ord order."""
    best = F.max("score").over(W.partitionBy("query_id", "branch"))
    scaled = branches.withColumn("_s", F.col("score") / F.when(best != 0, best).otherwise(F.lit(1.0)))
    return scaled.groupBy("query_id", F.substring("text", 1, 120).alias("text_key")).agg(F.round(F.sum("_s"), 6).alias("score"), F.max_by("text", F.struct("branch", "ord")).alias("text"))


def coverage(query: Column, candidate: Column) -> Column:
    """The default reranker: distinct query tokens found in the candidate, as a share; 0 without query tokens."""
    q = F.array_distinct(X.tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.tokens(candidate))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, by: str, score: str, ties: list[str], top: int, threshold: float) -> DataFrame:
    """Hits with score >= threshold, best first, then cut to top (in that order); rank_no from 1."""
    return top_k(hits.filter(F.col(score) >= threshold), by, [F.desc(score), *map(F.asc, ties)], top)


def dedup_by_text(hits: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first hit of each text for each query, by order."""
    w = W.partitionBy(by, "text").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_by_text(hits: DataFrame, by: str) -> DataFrame:
    """(by, text, score): the best score of each text."""
    return hits.groupBy(by, "text").agg(F.max("score").alias("score"))


def path_of_text(reranked: DataFrame, hits: DataFrame) -> DataFrame:
    """Reranked rows (query_id, text, ...) with the path of the hit of that text; of repeated texts the last hit counts."""
    last = hits.groupBy("query_id", "text").agg(F.max_by("file_path", F.struct("rank_no", "hit_id")).alias("file_path"))
    return reranked.join(last, ["query_id", "text"], "left")


def phrase_matches(docs: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rel_path, token_pos): the first place where a document holds an alias (alias, rel_path) of each entity, its own excluded.

    Aliases and documents are cut into the same tokens; documents give their n-grams only for the lengths that
    aliases have, and these meet the aliases in an equi-join.
    """
    a = aliases.select("rel_path", X.tokens(F.col("alias")).alias("_t")).filter(F.size("_t") > 0)
    a = a.select("rel_path", F.array_join("_t", " ").alias("gram"), F.size("_t").alias("_n")).distinct()
    lengths = a.agg(F.array_sort(F.collect_set("_n")).alias("_lengths"))  # a handful of numbers
    d = spread(docs.select(key, text)).select(key, X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t")).crossJoin(F.broadcast(lengths))
    grams = F.flatten(
        F.transform(
            F.coalesce("_lengths", F.array().cast("array<int>")),
            lambda n: F.when(
                F.size("_t") >= n,
                F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("_t", i + 1, n), " ").alias("gram"))),
            ).otherwise(F.array().cast("array<struct<pos:int,gram:string>>")),
        )
    )
    g = d.select(key, F.explode(grams).alias("_g")).select(key, F.col("_g.pos").alias("pos"), F.col("_g.gram").alias("gram"))
    hits = g.join(a.select("rel_path", "gram"), "gram").filter(F.col(key) != F.col("rel_path"))
    return hits.groupBy(key, "rel_path").agg(F.min("pos").alias("token_pos"))


def within_span(sentence_lemmas: Column, lemmas: Column, head: Column, span: int = 15) -> Column:
    """Whether a sentence holds a phrase: its head, and of its distinct lemmas all (up to two) or three quarters, within span positions."""
    wanted = F.array_distinct(lemmas)
    need = F.when(F.size(wanted) <= 2, F.size(wanted)).otherwise(F.ceil(F.size(wanted) * 0.75).cast("int"))
    spots = F.filter(F.transform(sentence_lemmas, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: F.array_contains(wanted, s["w"]))
    held = lambda s: F.array_distinct(F.transform(F.filter(spots, lambda o: (o["i"] >= s["i"]) & (o["i"] - s["i"] <= span)), lambda o: o["w"]))
    hit = F.exists(spots, lambda s: (F.size(held(s)) >= need) & (head.isNull() | F.array_contains(held(s), head)))
    return (F.size(wanted) > 0) & F.coalesce(hit, F.lit(False))
