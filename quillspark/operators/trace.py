"""Propagation of the asking user through a tree of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.lineage import materialize


def inherit_email(runs: DataFrame) -> DataFrame:
    """(run_id, email): a run's own email, else the nearest ancestor's. Pointers double, so rounds are the logarithm of the depth."""
    state = runs.select("run_id", F.when(F.col("email") != "", F.col("email")).alias("email"), F.col("parent_run_id").alias("up"))
    while True:
        up = state.select(F.col("run_id").alias("up"), F.col("email").alias("_email"), F.col("up").alias("_up"))
        state = materialize(state.join(up, "up", "left").select("run_id", F.coalesce("email", "_email").alias("email"), F.when(F.coalesce("email", "_email").isNull(), F.col("_up")).alias("up")))
        if state.where("up IS NOT NULL AND email IS NULL").isEmpty():
            return state.select("run_id", "email")


def tag_runs(runs: DataFrame) -> DataFrame:
    """(run_id, tags): tags with user:<email> added once where an email is known."""
    known = runs.select("run_id", F.coalesce("tags", F.array()).alias("tags")).join(inherit_email(runs), "run_id")
    return known.select("run_id", F.when(F.col("email").isNotNull(), F.array_union("tags", F.array(F.concat(F.lit("user:"), "email")))).otherwise(F.col("tags")).alias("tags"))
