"""Top N, Borda ranking, vector neighbours, packing and mixing, against brute force."""

import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import session
from skein.llm import borda, mixing, nearcopies, neighbours, packing, topn


def test_top_n_against_brute_force(spark):
    rng = random.Random(5)
    score = lambda: rng.choice([None, float("nan"), 0.0, -1.0, 0.5, 1e12, float("inf"), round(rng.random(), 2)])
    data = [(f"g{min(rng.randrange(9), rng.randrange(9))}", i, score()) for i in range(900)] + [(None, 1000 + i, 1.0) for i in range(8)] + [("tied", 2000 + i, 7.0) for i in range(300)]
    want = defaultdict(list)
    for g, i, s in data:
        if s is not None and not math.isnan(s):
            want[g].append((-s, i))
    want = {(g, n + 1, i) for g, v in want.items() for n, (_, i) in enumerate(sorted(v)[:5])}
    df = spark.createDataFrame(data, "source_path string, pair_id int, reranker_score double").withColumn("rank_no", F.lit("clash")).withColumn("_g", F.lit(0))
    assert {tuple(r) for r in topn.top_n(df, "source_path", "reranker_score", "pair_id", 5).collect()} == want
    assert topn.top_n(df.limit(0), "source_path", "reranker_score", "pair_id").count() == 0
    twice = spark.createDataFrame([("a", 1, 1.0)] * 7, "source_path string, pair_id int, reranker_score double")
    assert [tuple(r) for r in topn.top_n(twice, "source_path", "reranker_score", "pair_id", 5).orderBy("rank_no").collect()] == [("a", n, 1) for n in range(1, 6)]


def test_borda_points(spark):
    data = [("g", 1, 0.1, 90.0), ("g", 2, 0.1, 10.0), ("g", 3, 5.0, 90.0), ("g", 4, None, 50.0), ("g", 5, float("nan"), None)]
    df = spark.createDataFrame(data, "source_path string, pair_id int, d double, s double")
    scores = [("d", False, F.lit(0.5)), ("s", True, F.lit(0.5))]
    got = {r.pair_id: r.points for r in borda.borda_points(df, "source_path", "pair_id", scores, "mid").collect()}
    # d: 1 and 2 share 1.5 of 3 rows, 3 has 0, missing 1; s: 1 and 3 share 2.5 of 4, 4 has 1, 2 has 0, missing 1.5
    assert got == {1: 0.5 * 1.5 + 0.5 * 2.5, 2: 0.75, 3: 1.25, 4: 0.5 * 1 + 0.5 * 1, 5: 0.5 * 1 + 0.5 * 1.5}
    first = borda.borda_rank(df, "source_path", "pair_id", scores, "drop", first=1).collect()
    assert [(r.pair_id, r.rank_no) for r in first] == [(1, 1)]
    scaled = df.withColumn("d", F.col("d") * 1e6 - 3)
    assert {r.pair_id: r.points for r in borda.borda_points(scaled, "source_path", "pair_id", scores, "mid").collect()} == got
    with pytest.raises(ValueError):
        borda.borda_points(df, "source_path", "pair_id", scores, "other")


def test_rank_candidates_weights(spark):
    c = spark.createDataFrame([("a", 1, "v", 0.1, 1.0), ("a", 2, "v", 0.2, 9.0), ("b", 3, "w", 0.1, 1.0), ("b", 4, "w", 0.2, 9.0), ("c", 5, "?", 0.1, None)], "source_path string, pair_id int, vault string, vector_distance double, reranker_score double")
    v = spark.createDataFrame([("v", 0.9), ("w", 0.1), ("x", float("nan"))], "vault string, vector_search_weight double")
    assert {tuple(r) for r in borda.rank_candidates(c, v, first=1).select("source_path", "pair_id").collect()} == {("a", 1), ("b", 4)}
    assert borda.rank_candidates(c.limit(0), v).count() == 0


def brute(data, k=5, least=0.8):
    ok = [(i, f, np.array(v, float)) for i, f, v in data if v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = set()
    for i, f, a in ok:
        near = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), j) for j, g, b in ok if j != i and g != f)
        out |= {(min(i, j), max(i, j)) for s, j in [x for x in near if -x[0] >= least][:k]}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 64))
    data = [(i, f"f{i % 40}", [float(np.float32(x)) for x in (centers[i % 6] + rng.normal(scale=0.35, size=64)) * rng.uniform(0.1, 50)]) for i in range(300)]
    data += [(1000 + i, f"f{i}", data[0][2]) for i in range(40)] + [(2000 + i, "f0", data[1][2]) for i in range(30)]  # many copies
    data += [(5000, "z", None), (5001, "z", [1.0] * 32), (5002, "z", [0.0] * 64), (5003, "z", [float("nan")] * 64), (5004, "z", [float("inf")] * 64), (5005, "y", [1.0] * 64)]
    df = spark.createDataFrame(data, "chunk_id long, file_path string, vector array<float>")
    want = brute(data)
    for rows, leaf in ((16_384, 2048), (60, 2048), (10, 2048), (200, 20)):  # one shard, several, many, trees of several leaves in them
        got = {tuple(r) for r in neighbours.similar_pairs(df, shard_rows=rows, leaf_rows=leaf, relax_shard=1.0, relax_leaf=1.0).collect()}
        assert got == want, (rows, leaf, len(got), len(want))
    relaxed = {tuple(r) for r in neighbours.similar_pairs(df, shard_rows=60, leaf_rows=30).collect()}
    assert len(relaxed & want) >= 0.9 * len(want)
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def test_vantage_tree_splits_a_dense_spot():
    rng = np.random.default_rng(2)
    spot = np.ones(64) / 8 + rng.normal(scale=1e-5, size=(4000, 64))
    unit = neighbours._unit(np.concatenate([spot, rng.normal(size=(4000, 64))]).astype(np.float32))
    tree = neighbours.VantageTree(unit, 500, 0.05, 0.5, 1)
    assert max(map(len, tree.members)) <= 500 and sorted(np.concatenate(tree.members)) == list(range(8000))
    visits = sum(len(rows) for _, rows, _ in tree.route(unit))
    home = sum(int(h.sum()) for _, _, h in tree.route(unit))
    assert home == 8000 and visits < 8 * 8000


def test_neighbours_found_stay_with_the_number_of_shards(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(60, 64))
    v = (centers[np.arange(3000) % 60] + rng.normal(scale=0.3, size=(3000, 64))).astype(np.float32)
    data = [(i, f"f{i}", [float(x) for x in v[i]]) for i in range(3000)]
    df = spark.createDataFrame(data, "chunk_id long, file_path string, vector array<float>")
    exact = {tuple(r) for r in neighbours.similar_pairs(df).collect()}  # one shard of one leaf
    for rows in (1000, 250):
        got = {tuple(r) for r in neighbours.similar_pairs(df, shard_rows=rows, leaf_rows=200).collect()}
        assert len(got & exact) >= 0.9 * len(exact), (rows, len(got & exact), len(exact))


def test_best_fit_keeps_copies_apart():
    sizes, clusters, sources = [60, 50, 50, 40, 30, 20, 10, 0], [-1, 7, 7, -1, -1, -1, -1, -1], [1, 1, 2, 2, 1, 2, 1, 1]
    bins = packing.best_fit(sizes, clusters, sources, 100)
    load = defaultdict(int)
    for s, b in zip(sizes, bins):
        load[b] += s
    assert max(load.values()) <= 100 and bins[1] != bins[2] and len(load) == 3
    apart = packing.best_fit(sizes, clusters, sources, 100, source_share=0)
    assert all(apart[i] != apart[j] for i in range(8) for j in range(i) if sources[i] == sources[j])


def test_a_source_with_its_share_gets_nothing_more_into_a_container():
    sizes, sources = [30] * 12, [1] * 6 + [2] * 6
    bins = packing.best_fit(sizes, [-1] * 12, sources, 120, source_share=0.5)
    held = defaultdict(list)
    for b, s in zip(bins, sources):
        held[b].append(s)
    assert all(sorted(v) == [1, 1, 2, 2] for v in held.values())
    free = packing.best_fit(sizes, [-1] * 12, sources, 120, source_share=1)
    assert [free[i] for i in range(4)] == [0] * 4


def test_pack_documents(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["mill", "river", "wheel"]) for _ in range(rng.randrange(1, 400))), rng.choice("ab")) for i in range(200)]
    docs += [(500, None, None), (501, "", "a"), (502, "word " * 3000, "a"), (503, "same text here", "a"), (504, "Same  text here", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("container_id", F.lit("clash"))
    limits = spark.createDataFrame([("small", 256), ("large", 2048), ("none", 0)], "container_kind string, capacity_tokens int")
    rows = packing.pack_documents(df, limits, group_rows=60).collect()
    cap = {"small": 256, "large": 2048}
    load, per, where = defaultdict(int), defaultdict(list), {}
    for r in rows:
        load[r.container_kind, r.container_id] += r.n_tokens
        per[r.container_kind, r.doc_id].append((r.part_no, r.n_tokens))
        where[r.container_kind, r.doc_id, r.part_no] = r.container_id
    assert all(n <= cap[k] for (k, _), n in load.items()) and {k for k, _ in load} == set(cap)
    assert len(per) == 2 * len(docs)
    for (k, _), parts in per.items():
        assert [p for p, _ in sorted(parts)] == list(range(len(parts)))
        assert len(parts) == max(1, math.ceil(sum(n for _, n in parts) / cap[k]))
    assert where["large", 503, 0] != where["large", 504, 0]
    for k in cap:
        bins = [n for (kk, _), n in load.items() if kk == k]
        assert sum(bins) / (len(bins) * cap[k]) > 0.9
    assert packing.pack_documents(df.limit(0), limits).count() == 0


def classes(pairs):
    top = {x: x for p in pairs for x in p}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(a)] = find(b)
    groups = defaultdict(set)
    for x in top:
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


def test_near_copies_of_one_text_are_one_class(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"x{i}"] + base[k + 1 :]) for i in range(120) for k in [rng.randrange(200)]] + ["quite another text of more than five words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, folded string")
    all_, some = ({tuple(r) for r in nearcopies.near_sets(df, hot_list=h).collect()} for h in (2000, 20))
    assert classes(all_) == classes(some) and len(some) < len(all_) / 4


def test_near_sets_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = ["common phrase in every one of them " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 120))) for _ in range(60)]
    for t in texts[:40]:
        w = t.split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += ["blah " * 9, "blah " * 20, "a b c", "a b d", "種子庫的記錄顯示潮汐鐘每天早上都要手動調整一次才行，而且必須寫下來。", "種子庫的記錄顯示潮汐鐘每天早上都要手動調整一次才行，而且必須寫下來！"]
    sets = [frozenset(nearcopies.shingles(t, {}).tolist()) for t in texts]
    ids = [nearcopies._set_id(nearcopies.shingles(t, {})) for t in texts]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(texts)) for j in range(i) if ids[i] != ids[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(zip(range(len(texts)), texts)), "doc_id long, folded string")
    assert {tuple(r) for r in nearcopies.near_sets(df).collect()} == want and len(want) > 8
    for hot in (0, 1, 3):  # long lists lose pairs but no class
        got = {tuple(r) for r in nearcopies.near_sets(df, hot_list=hot).collect()}
        assert got <= want and classes(got) == classes(want)
    assert len({ids[-6], ids[-5]}) == 1 and ids[-4] != ids[-3] and (min(ids[-2:]), max(ids[-2:])) in want


def moved(spark, run):
    """Bytes that the stages of run() write for others, and those of the tables it writes."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before, tables = shuffled(), len(session._written)
    run()
    after = shuffled()
    files = [os.path.getsize(os.path.join(where, f)) for path in session._written[tables:] for where, _, names in os.walk(path.removeprefix("file:")) for f in names]
    return sum(n for k, n in after.items() if k not in before) + sum(files)


def test_what_near_copies_move_grows_with_the_texts_not_with_their_pairs(spark):
    rng = random.Random(7)
    phrases = [" ".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(300)]  # every text is made of these, so all share shingles
    short = [" ".join(rng.sample(phrases, 12)) for _ in range(1600)]
    long_ = [" ".join(["one phrase that they have in common", *(f"w{rng.randrange(10**9)}" for _ in range(2500))]) for _ in range(60)]
    for texts, k in ((long_, 3), (short, 4)):
        frames = [spark.createDataFrame(list(enumerate(t)), "doc_id long, folded string").repartition(4).cache() for t in (texts[: len(texts) // k], texts)]
        small, large = (moved(spark, lambda df=df: nearcopies.near_sets(df).collect()) for df in frames)
        assert large < 1.5 * k * small, (k, small, large)
        assert large < 4 * sum(map(len, texts)), (k, small, large)


def test_counters_and_sketches_of_near_copies():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(1, 1 << 40, rng.integers(1, 3000)))
        b = np.union1d(rng.choice(a, max(1, int(len(a) * 0.9)), replace=False), rng.integers(1, 1 << 40, rng.integers(0, 200)))
        for x, y in ((1, 1), (4, 1), (2, 8), (16, 16)):
            assert nearcopies._differ(nearcopies._sketch(a, x), nearcopies._sketch(b, y)) <= len(np.setxor1d(a, b))
    n, pos = np.array([3, 90, 200, 70_000]), np.array([0, 4, 40, 1])
    sketch = np.where(np.arange(4) < nearcopies._row_words(n, pos)[:, None], np.arange(1, 17, dtype=np.uint64).reshape(4, 4), np.uint64(0))
    rows = np.array([7, 7, 8, 2**32 - 1], np.uint32), np.array([-5, 5, 2**62, 1]), n, pos, sketch
    assert all((x == y).all() for x, y in zip(nearcopies._unpacked(nearcopies._packed(*rows)), rows))
    s = np.unique(rng.integers(1, 1 << 40, 300))
    first = rng.permutation(len(s))[:60]
    for k, row in enumerate(nearcopies._rest(s, first)):
        words = int(nearcopies._row_words(len(s), np.array(k)))
        assert (row == np.append(nearcopies._sketch(np.delete(s, first[: k + 1]), words), np.zeros(4 - words, np.uint64))).all()
    block = np.zeros(nearcopies.BLOCK, np.uint32)
    block[[0, 1, 700, nearcopies.BLOCK - 1]] = 1, 300, 99_999, 2
    assert (nearcopies._ungaps(nearcopies._gaps(block)) == np.minimum(block, nearcopies.FULL)).all()


def test_near_copies_never_share_a_container(spark):
    base = [f"word{i}" for i in range(100)]
    docs = [(i, " ".join([*base[: 50 + i], "other", *base[51 + i :]]), "a") for i in (0, 20, 40)] + [(9, "quite another text of a few words", "a")]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([("one", 4096)], "container_kind string, capacity_tokens int")).collect()
    assert len({r.container_id for r in rows}) == 3 and len(rows) == 4


def test_subset_counts_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        lengths = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(4)}
        budget = rng.randrange(0, 90)
        sums = {0}
        for n, c in lengths.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = mixing.subset_counts(lengths, budget)
        assert all(got.get(n, 0) <= c for n, c in lengths.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= budget)
    passes, extra = mixing.choose_counts({100_000: 3, 7: 5}, 400_040, 2)
    assert passes == 1 and sum(n * c for n, c in extra.items()) <= 400_040 - 300_035


def test_mix_sources(spark):
    rng = random.Random(9)
    docs = [(i, "word " * rng.randrange(5, 60), s) for s, lo, hi in (("big", 0, 400), ("mid", 400, 500), ("tiny", 500, 520)) for i in range(lo, hi)]
    docs += [(900, "x y z", "unlisted"), (901, None, "big"), (902, "a b", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("times", F.lit("clash"))
    w = spark.createDataFrame([("big", 0.6, 2), ("mid", 0.25, 2), ("tiny", 0.1, 3), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, w)
    rows = mix.collect()
    used = defaultdict(int)
    for r in rows:
        assert 1 <= r.times <= {"big": 2, "mid": 2, "tiny": 3}[r.source]
        used[r.source] += r.n_tokens * r.times
    total = sum(used.values())
    for s, share in (("big", 0.6), ("mid", 0.25), ("tiny", 0.1)):
        assert abs(used[s] / total - share / 0.95) < 0.005
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(abs(r.actual_share - used[r.source] / total) < 1e-9 for r in rows)
    again = {(r.doc_id, r.times) for r in mixing.mix_sources(df, w).collect()}
    assert again == {(r.doc_id, r.times) for r in rows}
    report = {r.source: (r.target_share, r.n_docs) for r in mixing.mix_report(mix, df, w).collect()}
    assert report["gone"] == (0.05, 0) and report["unlisted"] == (0.0, 0) and report[None] == (0.0, 0) and report["big"][1] > 0
    small = mixing.mix_sources(df, w, total_tokens=1000).agg(F.sum(F.col("n_tokens") * F.col("times"))).first()[0]
    assert 950 <= small <= 1000
    assert mixing.mix_sources(df.limit(0), w).count() == 0


def test_choose_counts_is_exact_at_every_size():
    rng = random.Random(3)
    for scale in (1, 50, 20_000):
        lengths = {n: scale * rng.randrange(1, 6) for n in (3, 17, 120, 731, 5_003)}
        whole = sum(n * c for n, c in lengths.items())
        for share in (0.13, 0.5, 0.97, 1.4):
            budget = int(whole * share)
            passes, extra = mixing.choose_counts(lengths, budget, 2)
            assert all(0 <= extra[n] <= lengths[n] for n in extra)
            used = passes * whole + sum(n * c for n, c in extra.items())
            missed = budget - used
            if scale == 1:
                sums = {0}
                for n, c in lengths.items():
                    sums = {s + n * k for s in sums for k in range(c + 1)}
                left = budget - passes * whole
                assert missed == left - max(s for s in sums if s <= left)
            else:
                assert 0 <= missed <= 1e-6 * budget + 1, (scale, share, missed)
    assert mixing.choose_counts({10: 4}, 35, 1) == (0, {10: 3})  # no sum comes nearer


def test_short_sources_are_used_up_and_their_share_goes_to_the_others(spark):
    docs = [(i, "word " * (5 + i % 40), s) for s, lo, hi in (("big", 0, 600), ("mid", 600, 900), ("tiny", 900, 903)) for i in range(lo, hi)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    w = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.2, 3)], "source string, target_share double, max_repeats int")
    used, stock = defaultdict(int), defaultdict(int)
    for r in mixing.mix_sources(df, w).collect():
        used[r.source] += r.n_tokens * r.times
        stock[r.source] += r.n_tokens
    assert used["tiny"] == 3 * stock["tiny"]
    assert abs(used["big"] / used["mid"] - 5 / 3) < 1e-3
    twice = df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 10_000))
    n = mixing.mix_sources(twice, w).agg(F.sum(F.col("n_tokens") * F.col("times"))).first()[0]
    assert abs(n - 2 * sum(used.values())) <= 4  # the size follows the input
