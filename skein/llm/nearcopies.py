"""Clusters of near copies of texts."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skein.operators.graph import connected_components
from skein.session import materialize, spread

# Words are runs without white space; in scripts that set no spaces every letter is one.
_WORD = re.compile("[฀-๿぀-ヿ㐀-鿿]|[^\\s฀-๿぀-ヿ㐀-鿿]+")
_UNSPACED = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
WORDS = 5
#: Counters that shingles are ordered by, as powers of two: about COUNTERS for each text between these bounds, so what comes to the driver is bounded.
LEAST_BITS, MOST_BITS, COUNTERS = 18, 24, 64
#: Counters that one row of a task's counts has; they count up to FULL.
BLOCK, FULL = 1 << 16, (1 << 16) - 1


def shingles(text: str, known: dict[str, int]) -> np.ndarray:
    """The distinct hashes of WORDS consecutive words of a text, ascending; a shorter text is one shingle. known: hashes of words so far."""
    words = text.split() if text.isascii() or not _UNSPACED.search(text) else _WORD.findall(text)
    h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    if len(h) > WORDS:
        out = np.zeros(len(h) - WORDS + 1, np.uint64)
        for i in range(WORDS):
            out = out * _BASE + h[i : i + len(out)]
    else:
        out = np.zeros(min(len(h), 1), np.uint64)
        for x in h:
            out = out * _BASE + x
    return np.unique(out.view(np.int64))


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _over(texts, f) -> list:
    known: dict[str, int] = {}
    out = []
    for t in texts:
        if len(known) > 200_000:
            known.clear()
        out.append(f(shingles(t, known)))
    return out


def _bucket(s: np.ndarray, bits: int) -> np.ndarray:
    return ((s.view(np.uint64) * _BASE) >> np.uint64(64 - bits)).astype(np.int64)


#: Words of 64 bits in a sketch that goes with a prefix, at most.
SKETCH = 4


def _words(n: np.ndarray, most: int) -> np.ndarray:
    """64-bit words of a sketch for n shingles: about a bit for each, a power of two."""
    return np.minimum(2 ** np.round(np.log2(np.maximum(n, 64) / 64)).astype(np.int64), most)


def _sketch(s: np.ndarray, words: int) -> np.ndarray:
    """One bit for each of 64 * words classes of shingles: whether their number is odd. Halves of a sketch, added, are the sketch of half its size."""
    odd = np.bincount((s & (64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """The number of bits that two sketches differ in, the larger one folded to the size of the other."""
    words = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, words), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def describe(texts: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep..., set_id, block, seen) of texts (doc_id, folded, keep...), in one pass and written once.

    One row for each text with the number of its shingle set (equal sets have the same; null without words); and, with
    a block, rows that say how many texts of a task hold a shingle of each counter of that block.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (COUNTERS * texts.count()).bit_length()))
    texts = spread(texts.select("doc_id", "folded", *keep))
    own = ["doc_id", *keep]
    fields = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    out = ", ".join(f"{c} {fields[c]}" for c in own) + ", set_id long, block int, seen binary"

    def run(batches):
        total = np.zeros(1 << bits, np.uint32)
        kinds = None
        for batch in batches:
            sets = _over(batch.column("folded").to_pylist(), lambda s: s)
            if sets:
                at, n = np.unique(_bucket(np.concatenate(sets), bits), return_counts=True)
                total[at] += n.astype(np.uint32)
            rows = {c: batch.column(c) for c in own}
            kinds = {c: x.type for c, x in rows.items()}
            rows["set_id"] = pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_pydict(rows | {"block": pa.nulls(len(sets), pa.int32()), "seen": pa.nulls(len(sets), pa.binary())})
        blocks = [(i, b) for i, b in enumerate(total.reshape(-1, BLOCK)) if b.any()]
        if blocks:
            rows = {c: pa.nulls(len(blocks), t) for c, t in kinds.items()} | {"set_id": pa.nulls(len(blocks), pa.int64())}
            yield pa.RecordBatch.from_pydict(rows | {"block": pa.array([bits * BLOCK + i for i, _ in blocks], pa.int32()), "seen": pa.array([_gaps(b) for _, b in blocks], pa.binary())})

    return materialize(texts.mapInArrow(run, out), "near-texts")


def _gaps(block: np.ndarray) -> bytes:
    """A block of counters as the gaps between those that aren't 0 and their counts, low bytes and high bytes apart."""
    at = np.flatnonzero(block)
    both = np.concatenate([np.diff(at, prepend=0), np.minimum(block[at], FULL)]).astype("<u2")
    return zlib.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 2).T).tobytes(), 6)


def _ungaps(packed: bytes) -> np.ndarray:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, -1).T).view("<u2").ravel()
    out = np.zeros(BLOCK, np.int64)
    out[np.cumsum(both[: len(both) // 2], dtype=np.int64)] = both[len(both) // 2 :]
    return out


def _counts(described: DataFrame) -> dict[int, bytes]:
    """The counters of all tasks together, packed, by block."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(map(_ungaps, rows["seen"].to_pylist()))
        return pa.table({"block": rows["block"][:1], "seen": pa.array([_gaps(total)], pa.binary())})

    blocks = described.filter("block IS NOT NULL").select("block", "seen").groupBy("block").applyInArrow(add, "block int, seen binary").toArrow()
    return dict(zip(blocks["block"].to_pylist(), blocks["seen"].to_pylist()))


def _table(blocks: dict[int, bytes]) -> tuple[int, np.ndarray]:
    """The counters, and the power of two of their number."""
    bits = next(iter(blocks)) // BLOCK if blocks else LEAST_BITS
    out = np.zeros(1 << bits, np.uint16)
    for k, b in blocks.items():
        out[k % BLOCK * BLOCK : (k % BLOCK + 1) * BLOCK] = _ungaps(b)
    return bits, out


#: Rows of prefixes that one task puts together at a time, and about as many that one part has.
PART_ROWS = 250_000


def _row_words(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Words of the sketch at a place: the more shingles come before it, the fewer may differ behind it."""
    return _words(n - 5 * pos, SKETCH)


def _rest(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """At each of the first places (their indices in order), the sketch of the shingles that come after it, in SKETCH words of which it has _row_words."""
    words = int(_words(np.array(len(s)), SKETCH))
    kind = (s & (64 * words - 1)).astype(np.int64)
    gone = np.zeros((len(first), 64 * words), np.uint8)
    gone[np.arange(len(first)), kind[first]] = 1
    odd = (np.bincount(kind, minlength=64 * words) & 1).astype(np.uint8) ^ np.bitwise_xor.accumulate(gone, axis=0)
    out = np.zeros((len(first), SKETCH), np.uint64)
    out[:, :words] = np.packbits(odd, axis=1).view(np.uint64)
    need = _row_words(len(s), np.arange(len(first)))
    while words > 1:
        words //= 2
        less = need <= words
        out[less, :words] ^= out[less, words : 2 * words]
        out[less, words : 2 * words] = 0
    return out


def _planes(x: np.ndarray) -> bytes:
    """The low bytes first, then the next: small numbers leave planes of zeros, which compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _packed(key: np.ndarray, own: np.ndarray, n: np.ndarray, pos: np.ndarray, sketch: np.ndarray) -> bytes:
    """Rows of prefixes in few bytes: the key, the set's number, its size, the place, and of the sketch (SKETCH words) of what follows those it has."""
    used = np.arange(SKETCH) < _row_words(n, pos)[:, None]
    return b"".join([np.int64(len(key)).tobytes(), key.astype("<u4").tobytes(), own.astype("<i8").tobytes(), _planes(n), _planes(pos), sketch[used].tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    m = int(np.frombuffer(blob, np.int64, 1)[0])
    key, own = np.frombuffer(blob, "<u4", m, 8), np.frombuffer(blob, "<i8", m, 8 + 4 * m)
    n, pos = (np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * m, 8 + k * m).reshape(4, m).T).view("<u4").ravel().astype(np.int64) for k in (12, 16))
    sketch = np.zeros((m, SKETCH), np.uint64)
    sketch[np.arange(SKETCH) < _row_words(n, pos)[:, None]] = np.frombuffer(blob, np.uint64, -1, 8 + 20 * m)
    return key, own, n, pos, sketch


def _meet(key: np.ndarray, own: np.ndarray, n: np.ndarray, pos: np.ndarray, sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, size of both) of the sets that share a key and may be similar by their sizes, their places and their sketches.

    The shared key counts as the first that two sets share, so all before it differ; where it isn't the first, they meet at
    that one. Keys are ordered by size, so a set is done where the others become too large; nothing but pairs that pass is kept.
    """
    order = np.lexsort((n, key))
    key, own, n, pos, sketch = key[order], own[order], n[order], pos[order], sketch[order]
    words = _row_words(n, pos)
    by_words = {SKETCH: sketch}  # as they are compared with smaller ones
    for w in (2, 1):
        last = by_words[2 * w]
        by_words[w] = np.where((words >= 2 * w)[:, None], last[:, :w] ^ last[:, w:], last[:, :w])
    end = np.searchsorted(key, key, "right")
    found, i, step = [], np.arange(len(key)), 0
    while len(i):
        step += 1
        i = i[i + step < end[i]]
        i = i[n[i] >= least * n[i + step] - 1e-9]
        both = n[i] + n[i + step]
        ok = np.minimum(n[i] - pos[i], n[i + step] - pos[i + step]) >= least / (1 + least) * both - 1e-9
        ok &= own[i] != own[i + step]
        x, y, both = i[ok], i[ok] + step, both[ok]
        most = (1 - least) / (1 + least) * both - pos[x] - pos[y] + 1e-9
        at = np.minimum(words[x], words[y])
        for w, rows in by_words.items():
            of = np.flatnonzero(at == w)
            of = of[np.bitwise_count(rows[x[of]] ^ rows[y[of]]).sum(axis=1) <= most[of]]
            found.append(np.stack([np.minimum(own[x[of]], own[y[of]]), np.maximum(own[x[of]], own[y[of]]), both[of]]))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1)) if found else tuple(np.zeros((3, 0), np.int64))


def near_sets(texts: DataFrame, least: float = 0.8, described: DataFrame | None = None, hot_list: int = 2000) -> DataFrame:
    """(a, b): pairs of shingle sets, a < b, with a Jaccard similarity of at least `least`, of texts (doc_id, folded), doc_id unique.

    All pairs come out, but for two sets of a list of more than hot_list that are both near to the least set of that list:
    through it they are in one class, and a third of all texts can be such sets. So classes are exact, and no list is gathered.

    Exact, by prefixes: in any one order of all shingles, two sets so similar share one of the first
    n - ceil(least * n) + 1 of their n shingles. The order is rare ones first, by counters over all texts whose number grows with
    them, so a phrase that many texts hold is hardly ever in a prefix; a shingle whose counter says that one text holds it has a place but
    is left out. A prefix moves once, packed, with sketches of what follows each place; where sets meet, those that their sizes, the
    place of the shared shingle or the sketches rule out (sets differ in at least as many shingles as their sketches in bits)
    aren't written, so what moves grows with the texts and not with the pairs. Of the pairs left the whole sets meet; those of long
    texts, for which these sketches are too small, by larger ones before. Equal sets are one, so many copies form no pairs.
    """
    described = describe(texts) if described is None else described
    texts = spread(texts.select("doc_id", "folded"))
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(_counts(described))
    hot_from = min(hot_list, FULL - 1)
    parts = max(64, -(-described.filter("set_id IS NOT NULL").count() * 27 // PART_ROWS))

    def prefixes(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        bits, total = _table(shared.value)

        def flush():
            h, own, n, pos, hot, sketch = (np.concatenate(x) for x in zip(*held))
            held.clear()
            mixed = (h.view(np.uint64) ^ (h.view(np.uint64) >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
            where = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            where[hot] = own[hot] % parts  # a long list isn't gathered
            key = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.lexsort((hot, where))
            group = 2 * where[order] + hot[order]
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            rows = [order[i:j] for i, j in zip(cuts, cuts[1:])]
            blobs = [_packed(key[r], own[r], n[r], pos[r], sketch[r]) for r in rows]
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(where[r[0]]) for r in rows], pa.int32()), "rows": pa.array(blobs, pa.binary()), "h": pa.array([h[r].tobytes() if hot[r[0]] else None for r in rows], pa.binary())})

        for batch in batches:
            for s in _over(batch.column("folded").to_pylist(), lambda s: s):
                n, own = len(s), _set_id(s)
                if not n or own in seen:  # copies of a set give nothing new
                    continue
                seen.add(own)
                p = n - int(np.ceil(least * n - 1e-9)) + 1
                rare = total[_bucket(s, bits)]
                first = np.lexsort((s, rare))[:p]
                pos = np.flatnonzero(rare[first] > 1)
                if not len(pos):
                    continue
                sketch = _rest(s, first)[pos]
                first = first[pos]
                held.append((s[first], np.full(len(pos), own, np.int64), np.full(len(pos), n), pos, rare[first] > hot_from, sketch))
            if sum(len(x[0]) for x in held) > PART_ROWS:
                yield from flush()
        if held:
            yield from flush()

    def meet(rows: pa.Table) -> pa.Table:
        blobs, hashes = rows["rows"].to_pylist(), rows["h"].to_pylist()
        lists = [_unpacked(b) for b, h in zip(blobs, hashes) if h is None]
        a, b, both = _meet(*(np.concatenate(x) for x in zip(*lists)), least) if lists else np.zeros((3, 0), np.int64)
        hot = [(np.frombuffer(h, np.int64), *_unpacked(b)[1:4]) for b, h in zip(blobs, hashes) if h is not None]
        h, own, n, pos = (np.concatenate(x) for x in zip(*hot)) if hot else np.zeros((4, 0), np.int64)
        none = pa.nulls(len(a), pa.int64())
        of = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "both": pa.array(both, pa.int64()), "h": none, "n": none, "pos": none})
        none = pa.nulls(len(h), pa.int64())
        return pa.concat_tables([of, pa.table({"a": pa.array(own, pa.int64()), "b": none, "both": none, "h": pa.array(h, pa.int64()), "n": pa.array(n, pa.int64()), "pos": pa.array(pos, pa.int64())})])

    packed = texts.select("folded").mapInArrow(prefixes, "part int, rows binary, h binary")
    met = materialize(packed.groupBy("part").applyInArrow(meet, "a long, b long, both long, h long, n long, pos long"), "near-met")
    pairs = materialize(met.filter("h IS NULL").select("a", "b", "both").distinct(), "near-pairs")
    small = _may_be(pairs.filter(F.col("both") > LONG).select("a", "b"), described, texts, least).unionByName(pairs.filter(F.col("both") <= LONG).select("a", "b"))
    near = _same(small, described, texts, least)
    prefix = met.filter("h IS NOT NULL").select(F.col("a").alias("set_id"), "h", "n", "pos")
    if prefix.isEmpty():
        return near
    hot = materialize(prefix.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("_many"), F.min("set_id").alias("_first")).filter(F.col("_many") > hot_list), "near-hot")

    def may(a, b) -> Column:
        most = F.least(a["n"] - a["pos"], b["n"] - b["pos"])  # what they can share from this place on, if it is the first
        return (F.least(a["n"], b["n"]) >= least * F.greatest(a["n"], b["n"]) - 1e-9) & (most + F.least(a["pos"], b["pos"]) >= least / (1 + least) * (a["n"] + b["n"]) - 1e-9)

    lists = prefix.join(hot, "h", "left_anti").groupBy("h").agg(F.collect_set(F.struct("set_id", "n", "pos")).alias("_p")).filter(F.size("_p") > 1)
    x = F.col("_a")
    others = F.transform(F.filter("_p", lambda b: (b["set_id"] > x["set_id"]) & may(x, b)), lambda b: b["set_id"])
    pairs = lists.select("_p", F.explode("_p").alias("_a")).select(x["set_id"].alias("a"), F.explode(others).alias("b"))
    similar = lambda p: _same(_may_be(p, described, texts, least), described, texts, least)
    if hot.isEmpty():
        return near.unionByName(similar(pairs)).distinct()
    # long lists: each set with the first of its list, then those that aren't near to it with all others, spread over SALTS places
    members = prefix.distinct().join(hot.select("h", "_first"), "h")
    first = members.filter("set_id <> _first").select(F.col("_first").alias("a"), F.col("set_id").alias("b"))
    near = materialize(near.unionByName(similar(pairs.unionByName(first))).distinct(), "near-first")
    linked = near.select(F.col("a").alias("_first"), F.col("b").alias("set_id"))
    apart = members.filter("set_id <> _first").join(linked, ["_first", "set_id"], "left_anti")
    side = lambda df, name: df.select("h", "_salt", F.struct("set_id", "n", "pos").alias(name))
    far = side(apart.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "_x")
    rest = far.join(side(members.withColumn("_salt", F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int")), "_y"), ["h", "_salt"])
    rest = rest.filter((F.col("_x.set_id") != F.col("_y.set_id")) & may(F.col("_x"), F.col("_y")))
    rest = rest.select(F.least("_x.set_id", "_y.set_id").alias("a"), F.greatest("_x.set_id", "_y.set_id").alias("b"))
    return near.unionByName(similar(rest)).distinct()


SALTS = 16
#: Sizes of two sets together from which sketches of SKETCH words tell little.
LONG = 4 * 64 * SKETCH
#: Texts that are asked for by broadcast, at most; more are joined.
ASKED = 1_000_000


def _of(pairs: DataFrame, described: DataFrame, texts: DataFrame, get) -> DataFrame:
    """(set_id, columns that get makes of folded) of the sets in pairs (a, b), each from one text of it."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "near-asked")
    hint = F.broadcast if asked.count() <= ASKED else lambda df: df
    docs = described.filter("set_id IS NOT NULL").join(hint(asked), "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    return materialize(texts.join(hint(materialize(docs, "near-docs")), "doc_id").select("set_id", get(F.col("folded")).alias("_s")), "near-sets")


def _both(pairs: DataFrame, own: DataFrame) -> DataFrame:
    for side, name in (("a", "_x"), ("b", "_y")):
        pairs = pairs.join(own.select(F.col("set_id").alias(side), F.col("_s").alias(name)), side)
    return pairs


def _may_be(pairs: DataFrame, described: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets that can be as similar as that by sketches of a bit for each shingle."""

    def wide(s: np.ndarray) -> bytes:
        return np.int64(len(s)).tobytes() + _sketch(s, int(_words(np.array([len(s)]), 1 << 40)[0])).tobytes()

    @F.pandas_udf(T.BinaryType())
    def get(t: pd.Series) -> pd.Series:
        return pd.Series(_over(t, wide))

    @F.pandas_udf(T.BooleanType())
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        both = ((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y))
        return pd.Series([_differ(a[1:], b[1:]) <= (1 - least) / (1 + least) * (int(a[0]) + int(b[0])) + 1e-9 for a, b in both], dtype=bool)

    pairs = materialize(pairs.distinct(), "near-long")
    if pairs.isEmpty():
        return pairs
    return _both(pairs, _of(pairs, described, texts, get)).filter(near("_x", "_y")).select("a", "b")


def _same(pairs: DataFrame, described: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets that are as similar as that, by the whole sets."""
    get = F.pandas_udf(lambda t: pd.Series(_over(t, lambda s: s)), T.ArrayType(T.LongType()))
    pairs = materialize(pairs, "near-pairs")
    if pairs.isEmpty():
        return pairs
    same = F.size(F.array_intersect("_x", "_y"))
    return _both(pairs, _of(pairs, described, texts, get)).filter(same >= least * (F.size("_x") + F.size("_y") - same) - 1e-9).select("a", "b")


def near_clusters(texts: DataFrame, least: float = 0.8, described: DataFrame | None = None) -> DataFrame:
    """(set_id, near) of the sets with a near one: components of near_sets."""
    edges = materialize(near_sets(texts, least, described).select(F.col("a").alias("src"), F.col("b").alias("dst")), "near-edges")
    return connected_components(edges).select(F.col("node").alias("set_id"), F.col("component").alias("near"))
