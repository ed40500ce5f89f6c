"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from skein.llm.tokens import token_count
from skein.session import materialize, spread

def subset_counts(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes as near to budget as can be without exceeding it.

    Bounded knapsack over reachable sums; multiplicities are split into powers of two. For every sum the step that
    reached it first is kept, so memory is a few bytes a token of budget however many lengths there are.
    """
    budget = max(0, int(budget))
    reached = np.zeros(budget + 1, dtype=bool)
    first = np.full(budget + 1, -1, dtype=np.int32)
    reached[0] = True
    steps: list[tuple[int, int]] = []
    for n, c in sorted(lengths.items(), reverse=True):
        if n <= 0:
            continue
        power, c = 1, min(c, budget // n)
        while c > 0 and not reached[budget]:
            k = min(power, c)
            new = np.flatnonzero(reached[: budget + 1 - n * k] & ~reached[n * k :]) + n * k
            first[new] = len(steps)
            reached[new] = True
            steps.append((n, k))
            c -= k
            power *= 2
    at = int(np.flatnonzero(reached)[-1])
    out: dict[int, int] = {}
    while at:
        n, k = steps[first[at]]
        out[n] = out.get(n, 0) + k
        at -= n * k
    return out


def even_counts(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """The same share of every length, together at most budget: what a length can't use up is carried to the shorter ones."""
    whole = sum(n * c for n, c in lengths.items())
    out, carry = {}, 0
    for n, c in sorted(lengths.items(), reverse=True):
        carry += n * c * budget  # in units of 1 / whole
        out[n] = min(c, carry // (n * whole))
        carry -= out[n] * n * whole
    return out


def choose_counts(lengths: dict[int, int], budget: int, max_repeats: int, precision: float = 1e-6) -> tuple[int, dict[int, int]]:
    """(passes, extra): every document is used passes times, and extra[n] documents of length n once more.

    What whole passes leave of the budget is met by an even share of all lengths up to a reserve of one longest
    document, and the reserve by the knapsack programme over all documents left. Where the sum misses the budget by more
    than precision of it, the reserve grows fourfold, at last to the whole budget, which is the exact optimum.
    """
    whole = sum(n * c for n, c in lengths.items())
    if whole <= 0 or budget <= 0 or max_repeats <= 0:
        return 0, {}
    passes = min(budget // whole, max_repeats)
    left = budget - passes * whole
    if passes >= max_repeats or left <= 0:
        return int(passes), {}
    reserve, unit = max(lengths), math.gcd(*lengths)
    while True:
        extra = even_counts(lengths, max(0, left - reserve))
        rest = left - sum(n * c for n, c in extra.items())
        more = subset_counts({n: c - extra[n] for n, c in lengths.items()}, rest)
        missed = rest - sum(n * k for n, k in more.items())
        if missed <= max(precision * budget, left % unit) or reserve >= left:
            break
        reserve *= 4
    for n, k in more.items():
        extra[n] += k
    return int(passes), {n: c for n, c in extra.items() if c}


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths = dict(zip(pdf["n_tokens"].tolist(), pdf["n_docs"].tolist()))
    passes, extra = choose_counts(lengths, int(pdf["budget"].iat[0]), int(pdf["max_repeats"].iat[0]))
    return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "n_docs": pdf["n_docs"], "passes": passes, "extra": [extra.get(n, 0) for n in pdf["n_tokens"]]})


def _plan(documents: DataFrame, weights: DataFrame, total_tokens: int | None, tokenizer: str | None) -> tuple[DataFrame, DataFrame]:
    sized = spread(documents.select("doc_id", "text", "source")).select(F.col("doc_id").cast("long").alias("doc_id"), "source", token_count(F.col("text"), tokenizer).alias("n_tokens"))
    sized = materialize(sized, "mix-sizes")
    want = weights.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source IS NOT NULL")
    have = sized.filter("n_tokens > 0 AND source IS NOT NULL").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    stock = have.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    usable = stock.join(want.filter("target_share > 0 AND max_repeats > 0"), "source").withColumn("cap", F.col("tokens") * F.col("max_repeats"))
    # shares of sources without documents fall to the others in proportion, and so does what a source at its cap can't give:
    # sources are filled in the order in which they reach their caps; the table has one row a listed source
    short = W.orderBy(F.col("cap") / F.col("target_share"), "source")
    past = short.rowsBetween(W.unboundedPreceding, -1)
    size = F.lit(total_tokens).cast("double") if total_tokens is not None else F.sum("tokens").over(W.partitionBy()).cast("double")
    level = (size - F.coalesce(F.sum("cap").over(past), F.lit(0))) / (F.sum("target_share").over(W.partitionBy()) - F.coalesce(F.sum("target_share").over(past), F.lit(0.0)))
    # the first source that stays below its cap has the highest level of those that do, and it is common to them
    levels = usable.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("target_share") >= F.col("cap") * (1 - 1e-12))
    common = levels.agg(F.max(F.when(~F.col("_full"), F.col("_level"))).alias("_common"))
    budget = levels.crossJoin(F.broadcast(common)).select("source", "max_repeats", F.when(F.col("_full"), F.col("cap")).otherwise(F.floor(F.col("_common") * F.col("target_share") + 1e-6)).cast("long").alias("budget"))
    picks = have.join(budget, "source").groupBy("source").applyInPandas(_choose, "source string, n_tokens long, n_docs long, passes long, extra long")
    return sized, materialize(picks, "mix-picks")


def mix_sources(documents: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, times, target_share, actual_share): the documents of the mix and how often each is used.

    Method: documents are counted by (source, exact token length); each source's budget is met by whole passes over
    it and a subset of lengths, found by bounded-knapsack dynamic programming over the counts (see choose_counts); documents
    of a length are then taken in the order of a seeded hash. times never exceeds max_repeats.

    total_tokens None makes the mix as large as the listed sources that have documents, each counted once, so it grows with
    them. A source whose stock times max_repeats is less than its part of the size is used up; what it can't give, like the
    shares of listed sources without documents, goes to the others in proportion, and actual_share says what each
    reached. Sources that aren't listed contribute nothing. Null sources, and texts without tokens, don't take part.
    Repeated weight rows count once (largest).
    """
    sized, picks = _plan(documents, weights, total_tokens, tokenizer)
    used = picks.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("passes") * F.col("n_docs") + F.col("extra"))).alias("_used"))
    total = used.agg(F.sum("_used").alias("_all"))
    shares = used.crossJoin(F.broadcast(total)).select("source", F.when(F.col("_all") > 0, F.col("_used") / F.col("_all")).alias("actual_share"))
    want = weights.groupBy("source").agg(F.max("target_share").alias("target_share"))
    rows = sized.join(picks.filter("passes > 0 OR extra > 0"), ["source", "n_tokens"])
    # the first `extra` documents of a length by seeded hash, found by counts of hash ranges: only the range on the edge is ranked
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = rows.withColumn("_h", h).withColumn("_range", F.shiftright(h, 52))
    ranges = rows.filter("extra > 0 AND extra < n_docs").groupBy("source", "n_tokens", "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("source", "n_tokens").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    rows = rows.join(ranges, ["source", "n_tokens", "_range"], "left")
    edge = F.col("_n").isNotNull() & (F.col("_before") < F.col("extra")) & (F.col("_before") + F.col("_n") > F.col("extra"))
    inside = rows.filter(~edge).withColumn("_more", F.when(F.col("_n").isNull(), F.col("extra") > 0).otherwise(F.col("_before") < F.col("extra")))
    rank = F.row_number().over(W.partitionBy("source", "n_tokens", "_range").orderBy("_h", "doc_id"))
    at_edge = rows.filter(edge).withColumn("_more", F.col("_before") + rank <= F.col("extra"))
    taken = inside.unionByName(at_edge).withColumn("times", (F.col("passes") + F.col("_more").cast("int")).cast("int")).filter("times > 0")
    return taken.select("doc_id", "source", "n_tokens", "times").join(shares, "source").join(want, "source").select("doc_id", "source", "n_tokens", "times", "target_share", "actual_share")


def mix_report(mix: DataFrame, documents: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_docs, n_tokens) of every source, listed or not; those that contribute nothing have share 0."""
    named = weights.groupBy("source").agg(F.max("target_share").alias("target_share"))
    all_ = documents.select("source").distinct().join(named, "source", "full_outer")
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("n_tokens"))
    total = got.agg(F.sum("n_tokens").alias("_all"))
    rows = all_.join(got, all_["source"].eqNullSafe(got["source"]), "left").drop(got["source"]).crossJoin(F.broadcast(total))
    return rows.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.col("n_tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
