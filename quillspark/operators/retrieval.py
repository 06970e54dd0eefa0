"""Sparse and dense retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.encode import token_weights

GROUP_VALUES = 1 << 22  # numbers of the vectors that one task holds at a time, and of the queries that meet them
BROADCAST_ROWS = 200_000  # token rows of questions whose tokens are broadcast at most; more go through a shuffle join
JOINED_ROWS = 2000  # token rows of questions that are joined with the postings at most; more are worked out in blocks
GROUP_CHUNKS = 1 << 14  # chunks whose postings one task holds at a time
BLOCK_ROWS = 1 << 20  # token rows of the questions that meet them
MERGED_LISTS = 64  # lists of one question that are merged at a time

postings = token_weights


def sparse_top(queries: DataFrame, docs: DataFrame, n: int = 100, chunks: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rnk) by the dot product of token weights; queries and docs are postings.

    An inverted-index join. For few questions, and docs bucketed by chunk_id, sums and the first cut to n stay within the
    scan's tasks, and only n rows of every question leave them. Many questions, whose products are a multiple of the
    postings, go through sparse_lists; chunks is the number of chunks, where it is known.
    """
    asked = queries.withColumnRenamed("weight", "query_weight")
    n_asked = asked.count()
    if n_asked > JOINED_ROWS:
        return merged_top(*sparse_lists(asked, docs, n, n_asked, docs.select("chunk_id").distinct().count() if chunks is None else chunks), n, "score")
    pairs = docs.join(F.broadcast(asked), "token")
    scored = pairs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), 6).alias("score")).where("score > 0")
    return top_ranked(scored, "score", n)


def _best_sums(codes: list[int], weights: list[float], rows: np.ndarray, weight: np.ndarray, start: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows of largest sum over the tokens' postings, ties by row, and their sums, rounded to 6 places and above 0."""
    sums.fill(0.0)
    for c, w in zip(codes, weights):
        sums[rows[start[c] : start[c + 1]]] += w * weight[start[c] : start[c + 1]]
    least = 4e-7  # rounds to 0
    if n < len(sums):
        least = max(least, np.partition(sums, len(sums) - n)[len(sums) - n] - 2e-6)  # equal sums after rounding are ties
    few = np.flatnonzero(sums >= least)
    found = sums[few].round(6)
    first = np.argsort(-found, kind="stable")[:n]
    first = first[found[first] > 0]
    return few[first], found[first]


def sparse_lists(asked: DataFrame, docs: DataFrame, n: int, n_asked: int, n_chunks: int) -> tuple[DataFrame, int]:
    """(query_id, g, ids, scores): of every group g of chunks the n best of each question, ties by id; and the number of
    groups. asked: (query_id, token, query_weight).

    Chunks fall into groups and questions into blocks of a size that one task holds, by hash of their ids; every block
    meets every group once. A task sorts its postings by token and adds up whole posting lists; questions of the same
    tokens are worked out once. Postings of tokens that no question has are left out before they are sent.
    """
    groups = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_chunks // GROUP_CHUNKS))
    blocks = -(-n_asked // BLOCK_ROWS)
    spread = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    tokens = asked.select("token").distinct()
    stored = docs.select("chunk_id", "token", F.col("weight").cast("double").alias("weight")).join(F.broadcast(tokens) if n_asked <= BROADCAST_ROWS else tokens, "token", "left_semi")
    left = stored.select("chunk_id", "token", "weight", spread("chunk_id", groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = asked.select("query_id", "token", F.col("query_weight").cast("double").alias("query_weight"), spread("query_id", blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def best(group: tuple[pa.Scalar, ...], near: pa.Table, ask: pa.Table) -> pa.Table:
        names, keys, found = [], [], []
        if near.num_rows and ask.num_rows:
            token = near["token"].combine_chunks().dictionary_encode()
            ids, rows = np.unique(near["chunk_id"].to_numpy(), return_inverse=True)
            place = token.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + rows
            order = np.argsort(place, kind="stable")
            place, weight = place[order], near["weight"].to_numpy()[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # an encoder may give a token of a chunk in parts
            place, weight = place[first], np.add.reduceat(weight, first)
            code, rows = np.divmod(place, len(ids))
            start = np.searchsorted(code, np.arange(len(token.dictionary) + 1))
            known = pc.index_in(ask["token"].combine_chunks(), value_set=token.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
            who, what, how = ask["query_id"].to_numpy(), known, ask["query_weight"].to_numpy()
            sorted_ = np.lexsort((what, who))
            sorted_ = sorted_[what[sorted_] >= 0]
            who, what, how = who[sorted_], what[sorted_], how[sorted_]
            ends = np.flatnonzero(np.r_[who[1:] != who[:-1], True]) + 1 if len(who) else []
            sums, done, at = np.zeros(len(ids)), {}, 0
            for end in ends:
                codes, weights = what[at:end].tolist(), how[at:end].tolist()
                same = (*codes, *weights)
                if same not in done:
                    done[same] = _best_sums(codes, weights, rows, weight, start, sums, n)
                chosen, score = done[same]
                names.append(who[at])
                keys.append(ids[chosen])
                found.append(score)
                at = end
        return _lists(group, names, keys, found)

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(best, LISTS), groups


LISTS = "query_id bigint, g int, ids array<bigint>, scores array<double>"


def _lists(group: tuple[pa.Scalar, ...], names: list, keys: list[np.ndarray], found: list[np.ndarray]) -> pa.Table:
    """A row for each question's list of a group."""
    ends = pa.array(np.cumsum([0, *map(len, keys)]).astype("int32"))
    listed = lambda parts, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).astype(kind) if parts else np.array([], dtype=kind)))
    return pa.table({"query_id": np.array(names, dtype="int64"), "g": np.full(len(names), group[0].as_py(), dtype="int32"), "ids": listed(keys, "int64"), "scores": listed(found, "float64")})


def merged_top(lists: DataFrame, groups: int, n: int, score: str, descending: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rnk): the n best of each question's lists, ties by id. A list is one row, so that sorts
    and exchanges don't see its places; so many lists of a question are merged at a time that their row stays small."""

    def merge(last: bool):
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                each = part.column("lists")
                inner = each.flatten()
                ids, scores = (pc.list_flatten(inner.field(name)).to_numpy() for name in ("ids", "scores"))
                ends = np.r_[0, np.cumsum(pc.list_value_length(inner.field("ids")).to_numpy())]
                ends = ends[np.r_[0, np.cumsum(pc.list_value_length(each).to_numpy())]].tolist()
                who, chosen = part.column("query_id").to_numpy(), []
                for begin, end in zip(ends, ends[1:]):
                    found = scores[begin:end]
                    chosen.append(begin + np.lexsort((ids[begin:end], -found if descending else found))[:n])
                sizes = np.array([len(x) for x in chosen], dtype="int64")
                places = np.concatenate(chosen) if chosen else np.array([], dtype="int64")
                if last:
                    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, sizes)), pa.array(ids[places]), pa.array(scores[places]), pa.array((np.arange(len(places)) - starts + 1).astype("int32"))], ["query_id", "chunk_id", score, "rnk"])
                else:
                    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype("int32"))
                    yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("g"), pa.ListArray.from_arrays(ends, pa.array(ids[places])), pa.ListArray.from_arrays(ends, pa.array(scores[places]))], ["query_id", "g", "ids", "scores"])

        return batches

    while True:
        groups = -(-groups // MERGED_LISTS)
        keys = ["query_id", (F.col("g") / MERGED_LISTS).cast("int").alias("g")] if groups > 1 else ["query_id"]
        gathered = lists.groupBy(*keys).agg(F.collect_list(F.struct("ids", "scores")).alias("lists"))
        if groups <= 1:
            return gathered.mapInArrow(merge(True), f"query_id bigint, chunk_id bigint, {score} double, rnk int")
        lists = gathered.mapInArrow(merge(False), LISTS)


def top_ranked(scored: DataFrame, score: str, n: int, descending: bool = True, key: str = "chunk_id") -> DataFrame:
    order = F.col(score).desc() if descending else F.col(score).asc()
    return scored.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id").orderBy(order, key))).where(F.col("rnk") <= n)


def nearest_rows(squared: np.ndarray, x: np.ndarray, query: np.ndarray, keys: np.ndarray, n: int, slack: float = 0.0, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x that are the n nearest to the query, ties by key, and their distances, rounded to 6 places.

    squared: the squared distances by the product form, which is a little inexact: it only leaves out what is certainly
    farther than the n-th. With slack, rows whose half squared distance is up to so much larger than the n-th's come too,
    at most n of each distance. norms: the rows' own squared lengths.
    """
    few = np.arange(len(x))
    if n < len(x):
        norms = (x**2).sum(1) if norms is None else norms
        error = (1e-11 if squared.dtype == np.float64 else 4 * (len(query) + 8) * 1.2e-7) * (1 + (query**2).sum() + norms.max())  # of the product form, amply
        limit = np.sqrt(max(0.0, float(np.partition(squared, n - 1)[n - 1]) + error)) + 2e-6  # equal distances after rounding are ties
        few = np.flatnonzero(~(squared > limit**2 + 2 * slack + error))  # keeps what is not a number, which comes last
    exact = np.sqrt(((x[few] - query) ** 2).sum(1)).round(6)
    order = np.lexsort((keys[few], exact))
    if slack and n < len(order):
        sorted_ = exact[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)  # within its distance
        order = order[~(sorted_**2 / 2 > sorted_[n - 1] ** 2 / 2 + slack) & (place < n)]
    else:
        order = order[:n]
    return few[order], exact[order]


def dense_lists(queries: DataFrame, vectors: DataFrame, n: int, slack: float = 0.0) -> tuple[DataFrame, int]:
    """(query_id, g, ids, scores): of every group g of vectors the n nearest to each query, by exact L2 distance, ties by
    id; and the number of groups. slack as in nearest_rows. Null vectors, and those of another length than the longest query's, are near to nothing.

    The stated queries meet all vectors in blocks: vectors fall into groups, queries into blocks of a size that one task
    holds, by hash of their ids; every block is sent once to every group. Nothing goes through the driver but counts.
    """
    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    n_asked, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    empty = queries.sparkSession.createDataFrame([], LISTS)
    if not n_asked or not width:
        return empty, 1
    stored = vectors.select("chunk_id", "embedding").where(F.size("embedding") == width)
    n_stored = stored.count()
    if not n_stored:
        return empty, 1
    rows = max(256, GROUP_VALUES // width)  # more rows than that share a group only by chance
    groups = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n_stored // rows))
    blocks = -(-n_asked // rows)
    spread = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    left = stored.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), spread("chunk_id", groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = asked.where(F.size("embedding") == width).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), spread("query_id", blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def matrix(table: pa.Table) -> np.ndarray:
        return table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def nearest(group: tuple[pa.Scalar, ...], near: pa.Table, ask: pa.Table) -> pa.Table:
        names, keys, found = [], [], []
        if near.num_rows and ask.num_rows:
            x, ids = matrix(near), near["chunk_id"].to_numpy()
            norms = (x**2).sum(1)
            who, q = ask["query_id"].to_numpy(), matrix(ask)
            q, copy = np.unique(q, axis=0, return_inverse=True)  # equal queries are worked out once
            members = np.split(np.argsort(copy, kind="stable"), np.cumsum(np.bincount(copy, minlength=len(q)))[:-1])
            light = np.float32 if max(norms.max(), (q**2).sum(1).max()) < 1e6 else np.float64  # a first look, also false for what is not a number
            x_light, norms_light = x.astype(light), norms.astype(light)
            step = max(1, GROUP_VALUES // len(x))
            for at in range(0, len(q), step):  # bounds the matrix of distances
                part = q[at : at + step]
                squared = part.astype(light) @ x_light.T
                squared *= -2
                squared += norms_light
                squared += (part**2).sum(1)[:, None].astype(light)
                for k, one in enumerate(part):
                    chosen, distance = nearest_rows(squared[k], x, one, ids, n, slack, norms)
                    for m in members[at + k]:
                        names.append(who[m])
                        keys.append(ids[chosen])
                        found.append(distance)
        return _lists(group, names, keys, found)

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(nearest, LISTS), groups


def dense_top(queries: DataFrame, vectors: DataFrame, n: int = 100) -> DataFrame:
    """(query_id, chunk_id, distance, rnk): the n nearest, ties by id."""
    return merged_top(*dense_lists(queries, vectors, n), n, "distance", descending=False)


def dense_above(queries: DataFrame, vectors: DataFrame, threshold: float = 0.7, n: int = 100) -> DataFrame:
    """(query_id, chunk_id, similarity, rnk): the nearest whose similarity 1 - distance^2 / 2 (the cosine of unit vectors) reaches the threshold.

    Different distances may round to the same similarity, in which the id decides; the slack covers that rounding.
    """
    lists, _ = dense_lists(queries, vectors, n, slack=2e-6)
    near = lists.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("scores").alias("distance")))).withColumn("similarity", F.round(1 - F.col("distance") * F.col("distance") / 2, 6))
    return top_ranked(near.where(F.col("similarity") >= threshold), "similarity", n).drop("distance")
