"""Encoders: text to weighted tokens and to vectors. Each is a function that an own model can replace."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: (table, key column, text column) -> (key, token, weight), the weight above 0
SparseEncoder = Callable[[DataFrame, str, str], DataFrame]
#: (table, key column, text column) -> (key, embedding array<double>)
DenseEncoder = Callable[[DataFrame, str, str], DataFrame]

BATCH_BYTES = 1 << 23  # of texts that are counted at a time
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))  # what tokens() tells apart, of ASCII


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def pooled(activations: DataFrame, key: str) -> DataFrame:
    """(key, token, weight) of (key, token, activation), one row per place in the text: the largest activation of a token,
    negative ones cut off, log-saturated; tokens without weight have no row."""
    weight = F.log1p(F.greatest(F.max("activation"), F.lit(0.0)))
    return activations.groupBy(key, "token").agg(weight.alias("weight")).where("weight > 0")


class _Codes(dict):
    """Numbers of words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def split_words(text: bytes) -> list[bytes]:
    """The tokens() of a text in UTF-8."""
    return (text if text.isascii() else text.decode(errors="replace").lower().encode()).translate(_WORDS).split()


def counted(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Of stretches of the texts, begin and end and, sorted by token and row: rows from the begin, tokens as places in the
    sorted list of distinct tokens, how often, that list."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for begin, end in zip(cuts, cuts[1:]):
        codes, what, lengths = _Codes(), array("q"), []
        for text in texts[begin:end].cast(pa.binary()).to_pylist():
            words = split_words(text) if text else ()
            lengths.append(len(words))
            what.extend(map(codes.__getitem__, words))
        known = list(codes)
        by_token = sorted(range(len(known)), key=known.__getitem__)
        rank = np.empty(len(known), dtype=np.int64)
        rank[by_token] = np.arange(len(known))
        places, count = np.unique(rank[np.frombuffer(what, dtype=np.int64)] * (end - begin) + np.repeat(np.arange(end - begin), lengths), return_counts=True)
        token, row = np.divmod(places, max(1, end - begin))
        yield begin, end, row, token, count, [known[k] for k in by_token]


def _whole_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _text): one row a key, as the tokens of all its texts count together."""
    return docs.groupBy(key).agg(F.concat_ws(" ", F.collect_list(text)).alias("_text"))


def token_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Default sparse encoder: the activation of a token is its frequency.

    Texts are counted in batches, sorted by token, without a row for every place in a text.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            part = part.take(pc.sort_indices(part.column(0)))
            for begin, end, row, token, count, known in counted(part.column(1)):
                words = pa.array(known, pa.binary()).cast(pa.string()).take(pa.array(token))
                yield pa.RecordBatch.from_arrays([part.column(0)[begin:end].take(pa.array(row)), words, pa.array(np.log1p(count))], [key, "token", "weight"])

    return _whole_texts(docs, key, text).mapInArrow(batches, StructType([docs.schema[key], StructField("token", StringType()), StructField("weight", DoubleType())]))


def model_weights(predict: Callable[[list[str]], list[dict[str, float]]]) -> SparseEncoder:
    """A sparse encoder from a model's batch function, texts to {token: activation}; the same for questions and documents."""

    def encode(docs: DataFrame, key: str, text: str) -> DataFrame:
        def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([list(map(tuple, d.items())) for d in predict([t or "" for t in part])])

        out = F.pandas_udf(batches, "array<struct<token string, activation double>>")(F.col(text))
        return pooled(docs.select(key, F.inline(out)), key)

    return encode


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds: halves away from 0, and no -0."""
    return np.copysign(np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits, x) + 0.0


def hashed_vectors(docs: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """Default dense encoder: token weights hashed to `size` places with signs, brought to unit length and rounded to 6 digits.

    A text without a token has no vector.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin, end, row, token, count, known in counted(part.column(1)):
                code = np.array([int.from_bytes(hashlib.md5(word).digest()[:4]) for word in known], dtype=np.int64)
                place, sign = code % size, np.where(code // size % 2 == 0, 1.0, -1.0)
                x = rounded(np.bincount(row * size + place[token], sign[token] * np.log1p(count), (end - begin) * size), 9).reshape(-1, size)
                norm = np.sqrt((x * x).sum(1))
                kept = np.flatnonzero(norm > 0)
                values = rounded(x[kept] / norm[kept, None], 6)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * size), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0)[begin:end].take(pa.array(kept)), lists], [key, "embedding"])

    return _whole_texts(docs, key, text).mapInArrow(batches, StructType([docs.schema[key], StructField("embedding", ArrayType(DoubleType()))]))


def model_vectors(predict: Callable[[list[str]], list[list[float]]]) -> DenseEncoder:
    """A dense encoder from a model's batch function."""

    def encode(docs: DataFrame, key: str, text: str) -> DataFrame:
        def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([[float(x) for x in v] for v in predict([t or "" for t in part])])

        return docs.select(key, F.pandas_udf(batches, "array<double>")(F.col(text)).alias("embedding"))

    return encode
