"""Tables of the evidence store: keyed merge, look-ups, result bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import latest

TERMINAL = ["completed", "partial", "blocked", "failed", "cancelled"]


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key, the last write (largest `order`) wins; the result replaces the table."""
    return latest(table.unionByName(rows), keys, [order])


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append rows whose key is new; a key that exists is an error of the caller, shown by duplicate_keys()."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def duplicate_keys(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).join(table.select(key), key, "left_semi")


def update_existing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace rows by key; keys that the table lacks change nothing."""
    changed = rows.join(table.select(key), key, "left_semi")
    return table.join(rows.select(key), key, "left_anti").unionByName(changed)


def of_collections(table: DataFrame, collections: DataFrame) -> DataFrame:
    """Rows of the given collections, in no order."""
    return table.join(collections.select("collection_id").distinct(), "collection_id", "left_semi")


def append_snapshots(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshots are only ever added; a row whose id is known is the same snapshot, written again after a restart."""
    return insert_new(table, rows.dropDuplicates(["snapshot_id"]), "snapshot_id")


def recoverable(collections: DataFrame) -> DataFrame:
    return collections.where(F.col("status").isin("queued", "running"))


def recovered(collections: DataFrame) -> DataFrame:
    """Restart: running collections are queued again."""
    was = F.col("status") == "running"
    return recoverable(collections).withColumn("stage", F.when(was, "recovered").otherwise(F.col("stage"))).withColumn("status", F.lit("queued"))


def cancelled(status: Column) -> Column:
    return F.when(status.isin(TERMINAL), status).otherwise("cancelled")


def save_recipes(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Last write wins on recipe_id, and again on (domain, goal, version)."""
    once = latest(table.unionByName(rows), ["recipe_id"], ["seq"])
    return latest(once, ["domain", "goal", "version"], ["seq"])


def result_bundle(collections: DataFrame, observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """A record with its observations and evidence, ids sorted."""
    many = lambda df, key, name: df.groupBy("collection_id").agg(F.sort_array(F.collect_list(key)).alias(name))
    out = collections.join(many(observations, "observation_id", "observations"), "collection_id", "left").join(many(evidence, "evidence_id", "evidence"), "collection_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("observations", F.coalesce("observations", empty)).withColumn("evidence", F.coalesce("evidence", empty))
