"""Most similar vectors for every vector (problem 3)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from skein.session import materialize

#: Rows of the sample that the trees over shards are built on: 32 a shard, at least and at most about so many.
SAMPLE_ROWS = (8192, 65_536)
_EPS = 2e-6  # what single precision may hide; everything within it is measured again in double precision


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the usable vectors of a list column: dim finite components, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten()
    m = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return at[ok], m[ok]


def _unit(m: np.ndarray) -> np.ndarray:
    w = m.astype(np.float64)
    w /= np.abs(w).max(axis=1, keepdims=True)
    return (w / np.linalg.norm(w, axis=1, keepdims=True)).astype(np.float32)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision, rounded to 6 decimals."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return np.round(dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 6)


class VantageTree:
    """A hierarchy of vantage points: each one splits its points by their angle to it into nearer and farther ones, down to leaves.

    By the triangle inequality a point within `reach` of a query lies on the query's side of a split, or the query's own
    angle is within reach of the split; so a query that goes both ways where it is that close misses nothing. With a
    smaller reach it may miss some. Vantage points (some of the points, and some random directions, which see even very
    close points apart) and splits are chosen from CANDIDATES so that few points lie within reach of the split for what it
    divides. overlap, where reach is relaxed, bounds the share of a node's points that may go both ways.
    """

    CANDIDATES, PROBE = 32, 2048
    WIDTH = 0.03  # radians about a split that should hold few points even where queries don't go both ways

    def __init__(self, unit: np.ndarray, leaf_rows: float, reach: float, overlap: float | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.members: list[np.ndarray] = []
        points, cuts, margins, child = [], [], [], []
        stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(unit)), -1, 0)]
        self.root = -1
        while stack:
            rows, above, side = stack.pop()
            split = self._split(unit, rows, reach, overlap, rng) if len(rows) > max(1.0, leaf_rows) else None
            if split is None:
                number = ~len(self.members)
                self.members.append(rows)
            else:
                number = len(points)
                point, cut, margin, near = split
                points.append(point)
                cuts.append(cut)
                margins.append(margin)
                child.append([0, 0])
                stack += [(rows[near], number, 0), (rows[~near], number, 1)]
            if above < 0:
                self.root = number
            else:
                child[above][side] = number
        self.points, self.cuts, self.margins, self.child = np.array(points, np.float32).reshape(len(points), unit.shape[1]), cuts, margins, child

    def _split(self, unit, rows, reach, overlap, rng):
        probe = unit[rows if len(rows) <= self.PROBE else rng.choice(rows, self.PROBE, replace=False)]
        far = rng.normal(size=(self.CANDIDATES // 4, unit.shape[1])).astype(np.float32)
        seen = np.concatenate([unit[rng.choice(rows, min(len(rows), self.CANDIDATES - len(far)), replace=False)], far / np.linalg.norm(far, axis=1, keepdims=True)])
        angles = np.sort(_angles(probe, seen), axis=0)
        n = len(probe)
        at = np.unique(np.linspace(0.1 * n, 0.9 * n, 49).astype(int).clip(1, n - 1))
        share = at / n
        divides = -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
        best = None
        for j in range(len(seen)):
            d = angles[:, j]
            cut = (d[at - 1] + d[at]) / 2
            close = max(reach, self.WIDTH)
            both = (np.searchsorted(d, cut + close) - np.searchsorted(d, cut - close)) / n
            cost = np.where(d[at] > d[at - 1], (both + 0.5 / n) / divides, np.inf)
            i = int(cost.argmin())
            if np.isfinite(cost[i]) and (best is None or cost[i] < best[0]):
                best = (cost[i], j, cut[i])
        if best is None:
            return None
        _, j, cut = best
        margin = reach
        if overlap is not None:
            margin = min(reach, float(np.sort(np.abs(angles[:, j] - cut))[min(n - 1, int(overlap * n))]))
        near = _angles(unit[rows], seen[j : j + 1])[:, 0] <= cut
        return None if near.all() or not near.any() else (seen[j], float(cut), margin, near)

    def route(self, q: np.ndarray):
        """(leaf, rows of q that visit it, whether it is their own side of every split) for all leaves that are visited."""
        stack = [(self.root, np.arange(len(q)), np.ones(len(q), bool))]
        while stack:
            node, rows, home = stack.pop()
            if node < 0:
                yield ~node, rows, home
                continue
            angle = _angles(q[rows], self.points[node : node + 1])[:, 0]
            near = angle <= self.cuts[node]
            for side, go, own in ((0, angle <= self.cuts[node] + self.margins[node], near), (1, angle > self.cuts[node] - self.margins[node], ~near)):
                if go.any():
                    stack.append((self.child[node][side], rows[go], (home & own)[go]))

    def nearest(self, unit: np.ndarray, q: np.ndarray, q_file: np.ndarray, files: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query number, point number) of all candidates for the k nearest of the points `unit` of other files with cosine >= least, in the leaves visited."""
        found_q, found_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        floor = np.full(len(q), least - _EPS, dtype=np.float32)
        for leaf, visitors, _ in self.route(q):
            x = self.members[leaf]
            points, x_file = unit[x].T, files[x]
            for begin in range(0, len(visitors), 2048):
                rows = visitors[begin : begin + 2048]
                s = q[rows] @ points
                i, j = np.nonzero(s >= floor[rows][:, None])
                other = q_file[rows[i]] != x_file[j]
                i, j = i[other], j[other]
                many = np.flatnonzero(np.bincount(i, minlength=len(rows)) > k)
                if len(many):  # the k-th of them raises what the query asks for from here on
                    own = s[many]
                    own[q_file[rows[many]][:, None] == x_file[None, :]] = -2.0
                    floor[rows[many]] = np.maximum(floor[rows[many]], np.partition(own, len(x) - k, axis=1)[:, len(x) - k] - _EPS)
                    good = s[i, j] >= floor[rows[i]]
                    i, j = i[good], j[good]
                found_q.append(rows[i])
                found_x.append(x[j])
        return np.concatenate(found_q), np.concatenate(found_x)


_SHARD_SCHEMA = "shard int, id long, file long, query boolean, target boolean, vec binary"


def _search_shard(k: int, least: float, reach: float, overlap: float | None, leaf_rows: int, dim: int):
    def search(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
        ids, files = table["id"].to_numpy(), table["file"].to_numpy()
        x, q = np.flatnonzero(table["target"].to_numpy(zero_copy_only=False)), np.flatnonzero(table["query"].to_numpy(zero_copy_only=False))
        if not len(x) or not len(q):
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        unit = _unit(raw)
        tree = VantageTree(unit[x], leaf_rows, reach, overlap, table["shard"][0].as_py())
        qi, xi = tree.nearest(unit[x], unit[q], files[q], files[x], k, least)
        qi, xi = q[qi], x[xi]
        cosine = _exact(raw[qi], raw[xi]) if len(qi) else np.zeros(0)
        keep = cosine >= least
        qi, xi, cosine = qi[keep], xi[keep], cosine[keep]
        order = np.lexsort((ids[xi], -cosine, qi))
        qi, xi, cosine = qi[order], xi[order], cosine[order]
        start = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, np.int64)
        rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)]))
        top = rank < k
        return pa.table({"id": ids[qi[top]], "other": ids[xi[top]], "cosine": cosine[top]})

    return search


def _blobs(raw: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def nearest_neighbours(
    df: DataFrame, key: str = "chunk_id", vector: str = "vector", file: str = "file_path", k: int = 5, least: float = 0.8, dim: int = 64,
    shard_rows: int = 49_152, leaf_rows: int = 2048, trees: int | None = None, relax_shard: float = 0.0, relax_leaf: float = 0.16, overlap: float = 0.5,
) -> DataFrame:
    """(id, other, cosine): for each row its k nearest rows with another file value, cosine rounded to 6 decimals and >= least; ties to the smaller key.

    Method: vantage-point trees. `trees` of them are built on a sample (SAMPLE_ROWS) with leaves that stand for at most
    about shard_rows rows; a leaf is a shard. A row is stored in its own leaf of each tree, and as a query visits the
    leaves that the triangle inequality with a search radius of relax_shard * acos(least) doesn't rule out: with 0 its
    own alone. Each shard holds a vantage-point tree of its rows down to leaf_rows, searched in the same way with
    relax_leaf. What one tree misses another finds: a split parts close rows now and then, so trees None takes three and
    one more for each doubling of the shards, by which the share of neighbours found stays the same. A factor of 1
    is exact search at its level (one tree is enough then). With smaller ones at most `overlap` of a node's rows go both
    ways, so that a dense spot doesn't draw every query of it into all its shards. Every row is indexed and every row is a
    query; the sample only places vantage points.

    Exact copies of a vector are collapsed first: at most 2k of them are targets (enough for any query's k nearest
    whichever file is left out), one row for each (vector, file) is a query and its answer counts for its copies;
    so a vector that a third of all rows share costs no more than any other.

    Rows whose vector isn't dim finite components, not all zero, are neither queries nor targets. A null file is
    a file of its own. Keys must be unique. An empty table gives an empty result.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(file), F.lit("\u0000null"))).alias("file"), F.col(vector).alias("vec"))
    hashed = base.select("id", "file", F.xxhash64("vec").alias("v1"), F.hash("vec").alias("v2"))
    repeated = hashed.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v1", "v2")
    again = hashed.join(repeated, ["v1", "v2"])
    in_file = W.partitionBy("v1", "v2", "file").orderBy("id")
    firsts = again.groupBy("v1", "v2", "file").agg(F.min("id").alias("rep"))
    capped = again.withColumn("_r", F.row_number().over(in_file)).filter(F.col("_r") <= k)
    shown = capped.withColumn("_t", F.row_number().over(W.partitionBy("v1", "v2").orderBy("id"))).filter(F.col("_t") <= 2 * k).select("id", F.lit(True).alias("target"))
    copies = again.join(firsts, ["v1", "v2", "file"]).join(shown, "id", "left").select("id", "rep", F.coalesce("target", F.lit(False)).alias("target"))
    copies = materialize(copies, "vector-copies")

    n = base.count()
    shards = max(1.0, n / shard_rows)
    wanted = int(min(max(SAMPLE_ROWS[0], 32 * shards), SAMPLE_ROWS[1]))
    # rows by their hash, about as many as wanted; they are ordered here, so that no task gathers candidates for them
    share = F.lit(int(min(1.0, wanted / max(1, n)) * (1 << 30)))
    sample = base.filter((F.size("vec") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share)).select("id", "vec").toArrow().sort_by("id")
    _, m = _vectors(sample["vec"], dim) if sample.num_rows else (None, np.zeros((0, dim), np.float32))
    m = _unit(m) if len(m) else m
    radius = math.acos(least)

    def factor(relax: float) -> tuple[float, float | None]:
        return (radius + 1e-3, None) if relax >= 1 else (relax * radius, overlap)

    count = 1 if relax_shard >= 1 else trees or round(3 + math.log2(shards))
    forest = [VantageTree(m, len(m) / shards, *factor(relax_shard), seed) for seed in range(count)]
    first = np.cumsum([0] + [len(t.members) for t in forest]).tolist()  # shards are numbered over all trees
    for t in forest:
        t.members = []  # only the sample's row numbers
    shared = spark.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            at, raw = _vectors(batch.column("vec"), dim)
            if not len(at):
                continue
            unit = _unit(raw)
            ids, files = batch.column("id").to_numpy()[at], batch.column("file").to_numpy()[at]
            rep, target = batch.column("rep").fill_null(-1).to_numpy(zero_copy_only=False)[at], batch.column("target").to_numpy(zero_copy_only=False)[at]
            query = ~batch.column("has").to_numpy(zero_copy_only=False)[at] | (rep == ids)
            for number, tree in enumerate(shared.value):
                for shard, rows, home in tree.route(unit):
                    keep = query[rows] | (home & target[rows])
                    rows, home = rows[keep], home[keep]
                    if len(rows):
                        yield pa.RecordBatch.from_pydict(
                            {"shard": pa.array(np.full(len(rows), first[number] + shard), pa.int32()), "id": ids[rows], "file": files[rows], "query": query[rows], "target": home & target[rows], "vec": _blobs(raw[rows])}
                        )

    marked = base.join(copies.withColumn("has", F.lit(True)), "id", "left").select("id", "file", "vec", "rep", F.coalesce("target", F.lit(True)).alias("target"), F.coalesce("has", F.lit(False)).alias("has"))
    placed = marked.mapInArrow(place, _SHARD_SCHEMA).repartitionById(first[-1], F.col("shard"))  # one shard a task
    found = placed.groupBy("shard").applyInArrow(_search_shard(k, least, *factor(relax_leaf), leaf_rows, dim), "id long, other long, cosine double")
    # a pair that several trees find has one rank
    best = found.withColumn("_r", F.dense_rank().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("_r") <= k).select("id", "other", "cosine").distinct()
    # copies hold their representative as well, so one join gives its answer to all of them
    same = copies.select(F.col("id").alias("_copy"), F.col("rep").alias("_rep"))
    return best.join(same, F.col("id") == F.col("_rep"), "left").select(F.coalesce("_copy", "id").alias("id"), "other", "cosine")


def similar_pairs(df: DataFrame, **options) -> DataFrame:
    """(chunk_id_a, chunk_id_b): unordered pairs, smaller key first, in which one row is among the k nearest of the other."""
    near = nearest_neighbours(df, **options)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()
