"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut_lineage

#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, path: str = DEFAULT) -> Column:
    """Tokens of a text column; null counts as 0. `path` is a vocabulary file that every executor can read."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def sized_documents(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """doc_id, source, n_tokens of every document; null ids are left out, repeated ids count once.

    The sizes are written to the checkpoint folder, so that the sums and orders built on them don't tokenize again.
    """
    sized = docs.where("doc_id is not null").select("doc_id", "source", token_count("text", path).alias("n_tokens"))
    return cut_lineage(sized.groupBy("doc_id").agg(F.max_by("source", "n_tokens").alias("source"), F.max("n_tokens").alias("n_tokens")))
