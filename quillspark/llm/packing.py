"""Problem 7: fill containers of fixed capacity, planned on the histogram of lengths.

Best fit runs over counts of equal lengths, not over documents: its input has at most `capacity` rows and its plan a number
of rows that depends on the capacity alone. Documents then take the planned slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ranking import with_rank
from quillspark.llm.tokens import VOCABULARY, n_tokens
from quillspark.plans.lineage import materialize

CAPACITY = 2048


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, last_rank, first_container, per_container) of a best-fit-decreasing packing of length counts.

    The containers with the same space left form ranges of consecutive ids. An item goes to the least space that holds it;
    as that space only shrinks, a container takes as many items of the length in a row as it can.
    """
    spaces: list[int] = []  # ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # space left -> (first id, number of containers)
    slots, new = [], 0

    def put(space: int, first: int, number: int) -> None:
        if number and space:
            if space not in ranges:
                ranges[space] = []
                insort(spaces, space)
            ranges[space].append((first, number))

    for length in sorted(histogram, reverse=True):
        if length <= 0:
            continue
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, number = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space]
                    spaces.pop(at)
            else:
                space, first = capacity, new
                number = -(-(count - rank) // (capacity // length))
                new += number
            per = space // length
            full = min(number, (count - rank) // per)
            if full:
                slots.append((length, rank, rank + full * per - 1, first, per))
                rank += full * per
                put(space - per * length, first, full)
            if full < number and rank < count:
                rest = count - rank  # fewer than one container takes
                slots.append((length, rank, count - 1, first + full, rest))
                rank = count
                put(space - rest * length, first + full, 1)
                full += 1
            put(space, first + full, number - full)
    return slots


def items(df: DataFrame, key: str, text: str, capacity: int, path: str) -> DataFrame:
    """(key, doc_tokens, piece_no, start_token, n_tokens): a text is one item; one over the capacity gives full pieces and a rest."""
    sized = df.select(F.col(key), n_tokens(F.col(text), path).alias("doc_tokens"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("doc_tokens") / capacity)).cast("int")
    out = sized.select(key, "doc_tokens", F.explode(F.sequence(F.lit(1), pieces)).alias("piece_no"))
    start = (F.col("piece_no") - 1).cast("bigint") * capacity
    return out.select(key, "doc_tokens", "piece_no", start.alias("start_token"), F.least(F.lit(capacity), F.col("doc_tokens") - start).cast("int").alias("n_tokens"))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(key, doc_tokens, piece_no, start_token, n_tokens, container): every text assigned to a container.

    Containers are numbered from 0. Texts without a token (null or empty) take no space and go to container 0. A text is
    cut, every `capacity` tokens, only if it alone exceeds a container. Copies are items of their own.
    """
    sized = materialize(items(df, key, text, capacity, path))  # lengths are read twice; texts are tokenized once
    histogram = {r["n_tokens"]: r["n"] for r in sized.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    slots = plan_slots(histogram, capacity)
    plan = df.sparkSession.createDataFrame([*slots, (0, 0, (1 << 62), 0, 1 << 62)], "n_tokens int, first_rank bigint, last_rank bigint, first_container bigint, per bigint")
    ranked = with_rank(sized, ["n_tokens"], key)
    fits = (ranked["n_tokens"] == plan["n_tokens"]) & ranked["_rank"].between(plan["first_rank"], plan["last_rank"])
    container = plan["first_container"] + F.floor((ranked["_rank"] - plan["first_rank"]) / plan["per"])
    return ranked.join(F.broadcast(plan), fits).select(key, "doc_tokens", "piece_no", "start_token", ranked["n_tokens"], container.cast("bigint").alias("container"))


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, the fewest that could hold all tokens, tokens, and the share of space left unused."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
    return total.select("containers", F.ceil(F.col("tokens") / capacity).alias("fewest_possible"), "items", "tokens", "fullest", (1 - F.try_divide(F.col("tokens"), F.col("containers") * capacity)).alias("unused_share"))
