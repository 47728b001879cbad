"""First-seen, latest, previous and budgeted rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def task_key(key: Column, source_id: Column, url: Column) -> Column:
    """An explicit key, else source and URL."""
    return F.coalesce(F.nullif(key, F.lit("")), F.concat_ws(":", source_id, url))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order. Aggregates whole rows, so equal keys fold before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(row, F.struct(*order)).alias("row")).select("row.*")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.lag(value).over(w))


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts each task's rows before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_success(hits: DataFrame, group: str, provider_rank: str) -> DataFrame:
    """Rows of each group's first provider that has any valid row."""
    best = hits.groupBy(group).agg(F.min(provider_rank).alias("_best"))
    return hits.join(best, group).where(F.col(provider_rank) == F.col("_best")).drop("_best")


def merge_tasks(existing: DataFrame, additions: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed union; existing rows win, then the earlier addition (column seq)."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(additions.withColumn("_side", F.lit(1)))
    return first_seen(both, keys, ["_side", "seq"]).drop("_side")
