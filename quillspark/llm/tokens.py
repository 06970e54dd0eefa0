"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place of the vocabulary on every machine; read there, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cached(key: object, build: Callable[[], object]) -> object:
    """What build() gives, kept for the life of the Python worker (functions shipped by value have no lasting globals)."""
    kept = sys.__dict__.setdefault("_quillspark_cache", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def encoder(path: str):
    def build():
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return cached(("tokenizer", path), build)


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)
