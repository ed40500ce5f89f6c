"""Model steps behind small interfaces, with deterministic defaults that need no network."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skein.functions import text as X, vectors as V
from skein.operators.search import coverage

T = TypeVar("T")


def retrying(call: Callable[[], T], attempts: int = 3, backoff: float = 1.0, every: bool = False, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of call(); errors that pass by themselves (all, with every) are tried again after the delay their message asks for, else a doubling one. The last error is raised."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 >= attempts or not (every or re.search(X.TRANSIENT, str(e))):
                raise
            asked = re.search(X.RETRY_DELAY, str(e))
            sleep(float(asked.group(1)) + 1.0 if asked else backoff * 2**n)
    raise ValueError("attempts must be positive")


class Lemmatizer(Protocol):
    def lemmas(self, text: Column) -> Column: ...


class Embedder(Protocol):
    dim: int

    def vector(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, candidate: Column) -> Column: ...


class Classifier(Protocol):
    def classify(self, pairs: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    def answer(self, question: Column, contexts: Column) -> Column: ...


class TokenLemmatizer:
    """Lemma = lower-case token."""

    def lemmas(self, text: Column) -> Column:
        return X.tokens(text)


class ModelReranker:
    """A scorer of text pairs that works on batches; load() makes it once in each worker.

    The model gets lists of at most `batch` (query, candidate) pairs and returns their scores; a null on either side
    scores 0 without being sent.
    """

    def __init__(self, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16):
        self.load, self.batch = load, batch

    def score(self, query: Column, candidate: Column) -> Column:
        load, batch = self.load, self.batch

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for q, c in parts:
                out = np.zeros(len(q))
                at = np.flatnonzero((q.notna() & c.notna()).to_numpy())
                for s in range(0, len(at), batch):
                    own = at[s : s + batch]
                    pairs = [(q.iat[i], c.iat[i]) for i in own]
                    out[own] = retrying(lambda: model(pairs))
                yield pd.Series(out)

        return F.pandas_udf(run, "double")(query, candidate)


class ModelEmbedder:
    """A text encoder that works on batches; load() makes it once in each worker. Null texts have no vector."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch: int = 128):
        self.load, self.dim, self.batch = load, dim, batch

    def vector(self, text: Column) -> Column:
        load, batch = self.load, self.batch

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for t in parts:
                out: list = [None] * len(t)
                at = np.flatnonzero(t.notna().to_numpy())
                for s in range(0, len(at), batch):
                    own = at[s : s + batch]
                    texts = [t.iat[i] for i in own]
                    for i, v in zip(own, retrying(lambda: model(texts))):
                        out[i] = list(map(float, v))
                yield pd.Series(out, dtype=object)

        return F.pandas_udf(run, "array<float>")(text)


class HashEmbedder:
    """Hashed term frequencies scaled to length one; a token's slot is the first eight hexadecimal digits of its MD5, modulo dim."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def vector(self, text: Column) -> Column:
        slots = F.transform(X.tokens(F.coalesce(text, F.lit(""))), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % self.dim)
        counts = lambda own: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.dim - 1).cast("long")), lambda i: (F.size(own) - F.size(F.array_remove(own, i))).cast("double"))
        return V.unit(V.let(slots, counts))


class CoverageReranker:
    """Share of the distinct query tokens that the candidate holds."""

    def score(self, query: Column, candidate: Column) -> Column:
        return coverage(query, candidate)


# Cue phrases of the relation types, tried in this order (fixed values).
CUES = [("contradict|opposed|confuse", "contradicts"), ("compare|versus| vs", "compared with"), ("grew out of|originat|comes from", "originates from"), ("part of|belongs to", "part of"), ("before|precede|came before", "precedes"), ("solve|fixes|replaces|replaced", "solves"), ("depends on|uses|used|needs", "uses"), ("influence|led to", "influences"), (" is an? | are the same", "is a"), ("mention|link|see ", "mentions")]


class CueClassifier:
    """Types a pair by the first cue phrase in its contexts, else "no link"."""

    def classify(self, pairs: DataFrame) -> DataFrame:
        """pairs (source_path, target_path, contexts) with relation_type and reasoning."""
        joined = F.lower(F.array_join("contexts", " "))
        kind = F.lit("no link")
        for cue, name in reversed(CUES):
            kind = F.when(joined.rlike(cue), F.lit(name)).otherwise(kind)
        return pairs.select("source_path", "target_path", kind.alias("relation_type"), F.lit("cue phrase").alias("reasoning"))


class ExtractiveGenerator:
    """The answer is the best contexts themselves."""

    def __init__(self, contexts: int = 3):
        self.contexts = contexts

    def answer(self, question: Column, contexts: Column) -> Column:
        return X.join_contexts(F.slice(contexts, 1, self.contexts))


def extract_triples(chunks: DataFrame, aliases: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Default graph extraction: (nodes, rels) of a chunk are the entities it names and a MENTIONS edge to each; ids are prefixed by the vault and in Title Case."""
    from skein.operators.search import phrase_matches

    hits = phrase_matches(chunks, aliases, key, text).join(chunks.select(key, "vault"), key)
    entity = F.concat_ws(":", "vault", X.node_id(F.col("rel_path")))
    nodes = hits.select(entity.alias("id"), "vault", F.lit("Entity").alias("type"), X.spaced(F.col("rel_path")).alias("display_name")).distinct()
    rels = hits.select(F.col(key).cast("string").alias("src_id"), entity.alias("dst_id"), F.lit("MENTIONS").alias("type"), "vault").distinct()
    return nodes, rels
