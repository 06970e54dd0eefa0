"""Ranks within groups of any size: a group is spread over salted parts, and a prefix sum over the parts' counts joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64  # parts of a group at least; as many more as the session has shuffle partitions, four for each


def with_rank(df: DataFrame, group: list[str], key: str, bucket: Column | None = None, salts: int | None = None) -> DataFrame:
    """df with _rank, from 0 within `group`, by bucket first and else in a fixed but arbitrary order of the key.

    Prefix sums on three levels, none of which holds a group: rows are numbered within (group, bucket, salt), where the salt
    is a hash of the key; the parts' counts are summed over the salts of a bucket, and the buckets' over the buckets of a
    group, of which there must be few. Ties on everything are numbered anyhow.
    """
    salts = salts or max(SALTS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inner = [*group, "_bucket"]
    part = [*inner, "_salt"]
    salted = df.withColumn("_bucket", F.lit(0) if bucket is None else bucket).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    before = lambda groups, order: F.coalesce(F.sum("_c").over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = salted.groupBy(*part).agg(F.count("*").alias("_c"))
    within = counts.select(*part, before(inner, "_salt").alias("_within"))
    totals = counts.groupBy(*inner).agg(F.sum("_c").alias("_c")).select(*inner, before(group, "_bucket").alias("_before"))
    offsets = within.join(totals, inner).select(*part, (F.col("_within") + F.col("_before")).alias("_offset"))
    numbered = salted.withColumn("_row", F.row_number().over(Window.partitionBy(*part).orderBy(key)))
    return numbered.join(offsets, part).withColumn("_rank", F.col("_offset") + F.col("_row") - 1).drop("_salt", "_row", "_offset", "_bucket")


def fixed_uniform(*keys: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) drawn from the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
