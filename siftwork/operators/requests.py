"""Collection requests: validation, submission, and the row of what a deployment can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTOCOL = "1.0.0"


def _between(value: Column, least: float, most: float) -> Column:
    return value.isNull() | value.between(least, most)


def broken_rules() -> Column:
    """Names of the rules that a request breaks, in order. Input: protocol_version, consumer, analysis_id, city, address,
    geometry, latitude, longitude, radius_meters, intents, max_pages, max_depth; nulls of the last five take defaults."""
    c = F.col
    filled = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    named = lambda x: F.coalesce(F.length(x).between(1, 128), F.lit(False))
    point = c("latitude").isNotNull() & c("longitude").isNotNull()
    rules = {
        "protocol_version": F.coalesce(c("protocol_version"), F.lit(PROTOCOL)) == PROTOCOL,
        "consumer": named(c("consumer")),
        "analysis_id": named(c("analysis_id")),
        "territory": filled(c("city")) | filled(c("address")) | filled(c("geometry")) | point,
        "point": _between(c("latitude"), -90, 90) & _between(c("longitude"), -180, 180) & (c("latitude").isNull() == c("longitude").isNull()),
        "radius_meters": _between(c("radius_meters"), 1, 100_000),
        "intents": F.coalesce(F.size("intents").between(1, 50), F.lit(False)),
        "max_pages": _between(c("max_pages"), 1, 500),
        "max_depth": _between(c("max_depth"), 0, 5),
    }
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def validated(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with `broken`). Both keep all columns."""
    judged = requests.withColumn("broken", broken_rules())
    return judged.where(F.size("broken") == 0).drop("broken"), judged.where(F.size("broken") > 0)


def submitted(requests: DataFrame, collection_id: Column, at: Column) -> DataFrame:
    """Queued collections of accepted requests."""
    accepted, _ = validated(requests)
    return accepted.select(collection_id.alias("collection_id"), F.lit("queued").alias("status"), F.lit("queued").alias("stage"), F.lit(0).alias("progress_percent"), F.lit(False).alias("partial"), at.alias("created_at"), at.alias("updated_at"))


def capabilities(providers: DataFrame) -> DataFrame:
    """One row: names of the configured providers by kind. Input: kind, name, configured; an empty table has empty lists."""
    names = lambda kind: F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & F.col("configured"), F.col("name")))).alias(f"{kind}_providers")
    return providers.agg(*[names(k) for k in ("discovery", "geocoding", "archive", "map")]).select(F.lit(PROTOCOL).alias("protocol_version"), "*")
