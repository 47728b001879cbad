"""Folding of task outcomes into coverage, collection status and discovery outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_blocking(code: Column) -> Column:
    return F.coalesce(code.endswith("_BLOCKED"), F.lit(False))


def coverage_status(blocked: Column, partial: Column, n_errors: Column, observations: Column) -> Column:
    """blocked, then partial, then error (errors and no observation), then ok."""
    return F.when(blocked, "blocked").when(partial, "partial").when((n_errors > 0) & (observations == 0), "error").otherwise("ok")


def coverage(outcomes: DataFrame) -> DataFrame:
    """Per task outcome: its status and its first error code."""
    return outcomes.select(
        "collection_id",
        "seq",
        "source_id",
        coverage_status(F.col("blocked"), F.col("partial"), F.size("error_codes"), F.col("observations")).alias("status"),
        F.col("observations"),
        F.get("error_codes", F.lit(0)).alias("error_code"),
    )


def collection_status(outcomes: DataFrame, budget_left: Column | None = None, allow_partial: Column | None = None) -> DataFrame:
    """Per collection: status, partial flag, observation count. Folds merge, so large collections aggregate in every task."""
    cov = coverage_status(F.col("blocked"), F.col("partial"), F.size("error_codes"), F.col("observations"))
    left = F.lit(False) if budget_left is None else budget_left
    allow = F.lit(True) if allow_partial is None else allow_partial
    folds = outcomes.groupBy("collection_id").agg(
        F.sum("observations").alias("observations"),
        F.bool_or(F.col("blocked")).alias("blk"),
        F.bool_or(cov == "partial").alias("part"),
        F.bool_or(F.exists("error_codes", lambda c: ~is_blocking(c))).alias("err"),
        F.bool_or(left).alias("bud"),
        F.bool_and(allow).alias("allow"),
    )
    obs = F.col("observations") > 0
    degraded = F.col("part") | F.col("err") | F.col("bud")
    status = (
        F.when(obs & (F.col("blk") | degraded), F.when(F.col("allow"), "partial").otherwise("failed"))
        .when(~obs & F.col("blk") & ~(F.col("err") | F.col("bud")), "blocked")
        .when(~obs & degraded, "failed")
        .otherwise("completed")
    )
    return folds.select("collection_id", status.alias("status"), (status == "partial").alias("is_partial"), "observations")


def progress(processed: Column, max_pages: Column) -> Column:
    return F.least(F.lit(99), F.floor(100 * processed / max_pages)).cast("int")


def startup_outcome(n_tasks: Column, n_visited: Column, discovery_blocked: Column) -> Column:
    """Status of a collection that has nothing to run, else null."""
    return F.when((n_tasks == 0) & (n_visited == 0), F.when(discovery_blocked, "blocked").otherwise("failed"))


def failure_outcome(allow_partial: Column, has_data: Column) -> Column:
    return F.when(allow_partial & has_data, "partial").otherwise("failed")


def discovery_outcome(providers: DataFrame) -> DataFrame:
    """Per search: error codes in order. Input: search, provider, rank, blocked, failed, n_tasks."""
    folds = providers.groupBy("search").agg(
        F.sort_array(F.collect_list(F.when(F.col("blocked") | F.col("failed"), F.struct("rank", F.when(F.col("blocked"), "DISCOVERY_BLOCKED").otherwise("DISCOVERY_ERROR").alias("code"))))).alias("own"),
        F.bool_or("blocked").alias("blocked"),
        F.sum("n_tasks").alias("n_tasks"),
    )
    last = F.when((F.col("n_tasks") == 0) & F.col("blocked"), F.array(F.lit("DISCOVERY_INCOMPLETE"))).when((F.col("n_tasks") == 0) & (F.size("own") == 0), F.array(F.lit("DISCOVERY_NO_RESULTS"))).otherwise(F.array().cast("array<string>"))
    return folds.select("search", "n_tasks", F.array_join(F.concat(F.transform("own", lambda x: x["code"]), last), ",").alias("codes"))
