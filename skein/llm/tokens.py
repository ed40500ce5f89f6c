"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column, functions as F, types as T

#: How byte-level BPE vocabularies of this family cut text before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_file(path: str | None = None) -> str:
    """Path of a vocabulary in ranks format: the parameter, else SKEIN_TOKENIZER, else the usual folder."""
    return path or os.environ.get("SKEIN_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text; 0 for null and empty texts. The vocabulary is loaded once in each worker."""
    file = ranks_file(path)

    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(file)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)
