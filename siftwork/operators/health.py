"""Source health and recipe counters as folds over attempt logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_health(attempts: DataFrame) -> DataFrame:
    """State of each source after its attempts (source_id, seq, outcome, error).

    outcome: ok, degraded, blocked, running or cancelled. A cancelled attempt restores the last stable
    state and its error; a running one shows as running. Sources start as ready.
    """
    stable = F.col("outcome").isin("ok", "degraded", "blocked")
    folds = attempts.groupBy("source_id").agg(
        F.max_by("outcome", "seq").alias("last"),
        F.max_by(F.when(stable, F.struct("outcome", F.when(F.col("outcome") != "ok", F.col("error")).alias("error"))), F.when(stable, F.col("seq"))).alias("stable"),
        F.count("*").alias("attempts"),
    )
    state = F.when(F.col("last") == "running", "running").otherwise(F.coalesce("stable.outcome", F.lit("ready")))
    return folds.select("source_id", state.alias("status"), F.col("stable.error").alias("error"), "attempts")


def default_error(outcome, error):
    """SOURCE_BLOCKED and SOURCE_PARTIAL where an outcome names no error."""
    return F.coalesce(error, F.when(outcome == "blocked", "SOURCE_BLOCKED").when(outcome == "degraded", "SOURCE_PARTIAL"))


def recipe_failures(runs: DataFrame) -> DataFrame:
    """Failures of each recipe since its last success, and that success. Input: recipe_id, seq, success."""
    last = F.max(F.when(F.col("success"), F.col("seq")))
    w = Window.partitionBy("recipe_id")
    return runs.withColumn("last_success", last.over(w)).groupBy("recipe_id").agg(F.sum(F.when(~F.col("success") & (F.col("seq") > F.coalesce("last_success", F.lit(-1))), 1).otherwise(0)).alias("failures"), F.max("last_success").alias("last_success"))


def next_version(recipes: DataFrame) -> DataFrame:
    return recipes.groupBy("domain", "goal").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
