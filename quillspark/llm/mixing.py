"""Problem 8: mix sources to target shares of all tokens, by systematic sampling.

A document of a source is expected rate times, the same rate all over the source. Its place in the prefix sum of the
expected copies, plus one random offset per source, tells how many integer boundaries it crosses, and so its copies.
Documents are summed in order of their length by steps of a quarter of a doubling, so that short and long ones are drawn
alike and the tokens drawn stay close to the tokens expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ranking import fixed_uniform, with_rank
from quillspark.llm.tokens import VOCABULARY, n_tokens
from quillspark.plans.lineage import materialize


def plan_rates(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Expected copies of a document, by source.

    Without a total, the largest collection in which every source that has tokens reaches its share exactly: one source
    is then repeated max_repeats times and none is short. With a total, a source that cannot fill its share gives all it
    may, and the others share the rest by their targets. Sources without tokens get 0, and the shares are of the others.
    """
    live = [(s, p, m) for s, p, m in targets if p > 0 and m > 0 and available.get(s, 0) > 0]
    rates = {s: 0.0 for s, _, _ in targets}
    if not live:
        return rates
    whole = sum(p for _, p, _ in live)
    if total is None:
        size = min(m * available[s] / (p / whole) for s, p, m in live)
        return rates | {s: min(float(m), size * (p / whole) / available[s]) for s, p, m in live}
    rest, left = float(total), live
    while left:
        whole = sum(p for _, p, _ in left)
        short = [(s, p, m) for s, p, m in left if rest * p / whole > m * available[s]]
        if not short:
            return rates | {s: rest * p / whole / available[s] for s, p, m in left}
        for s, _, m in short:
            rates[s] = float(m)
            rest -= m * available[s]
        left = [x for x in left if x not in short]
    return rates


def _sized(df: DataFrame, targets: DataFrame, key: str, source: str, text: str, path: str) -> DataFrame:
    listed = df.select(key, F.col(source).alias("source"), text).join(targets.select("source").distinct(), "source", "left_semi")
    return materialize(listed.select(key, "source", n_tokens(F.col(text), path).alias("n_tokens")))


def _mix(sized: DataFrame, targets: DataFrame, key: str, seed: int, total: int | None) -> DataFrame:
    wanted = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").collect()]  # the targets are given by hand
    available = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # as many rows as targets
    rates = plan_rates(wanted, available, total)
    rated = sized.sparkSession.createDataFrame([*rates.items()], "source string, rate double")
    steps = F.floor(F.log2("n_tokens") * 4)  # as many as a length has doublings, times four
    ranked = with_rank(sized.where("n_tokens > 0"), ["source"], key, steps)
    at = F.col("_rank") * F.col("rate") + fixed_uniform(F.col("source"), seed=seed)
    copies = (F.floor(at + F.col("rate")) - F.floor(at)).cast("int")
    return ranked.join(F.broadcast(rated), "source").select(key, "source", "n_tokens", "rate", copies.alias("copies"))  # as many rows as targets


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, total: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens, copy_no): the collection; a document stands in it up to max_repeats times, copy_no from 1.

    Documents of sources that the targets don't list stay out, and so do those with a null source or without a token.
    """
    drawn = _mix(_sized(df, targets, key, source, text, path), targets, key, seed, total)
    return drawn.where("copies > 0").select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def report(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, total: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """One row per target: documents and tokens there are and taken, most copies of a document, share wanted and reached."""
    drawn = _mix(_sized(df, targets, key, source, text, path), targets, key, seed, total)
    sums = drawn.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("n_tokens").alias("tokens_available"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_repeats"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
    )
    all_tokens = sums.agg(F.sum("tokens")).first()[0] or 0
    joined = targets.select("source", "target_share", "max_repeats").join(sums, "source", "left").na.fill(0, ["documents", "tokens_available", "copies", "most_repeats", "tokens"])
    return joined.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.lit(float(all_tokens))), F.lit(0.0)))
