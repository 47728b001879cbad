"""Archive index payloads: JSON rows under a header row to captures, observations and page tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, urls, values

MOST_CAPTURES = 20


def provider_outcome(status: Column) -> Column:
    """Error code of a provider's HTTP status, null if it answered."""
    return F.when(status.isin(403, 429), "ARCHIVE_PROVIDER_BLOCKED").when((status < 200) | (status >= 300), "ARCHIVE_PROVIDER_ERROR")


def captures(payloads: DataFrame, limit: int = 5, base: str = "https://web.archive.org/web") -> DataFrame:
    """Rows (url, rank, timestamp, captured_at, original, mimetype, status, digest, length, capture_url).

    Columns are found by the names in the header row. Rows need a timestamp and an http(s) original; equal
    (timestamp, original) count once. Input: url, payload.
    """
    parsed = payloads.select("url", F.from_json("payload", "array<array<string>>").alias("rows")).where(F.size("rows") > 1)
    head = F.get("rows", F.lit(0))
    names = ("timestamp", "original", "mimetype", "statuscode", "digest", "length")
    each = parsed.select("url", *[F.array_position(head, n).cast("int").alias(f"at_{n}") for n in names], F.posexplode("rows").alias("seq", "row")).where("seq > 0")
    cell = lambda n: F.btrim(F.coalesce(F.get("row", F.col(f"at_{n}") - 1), F.lit("")))
    cells = each.select("url", "seq", *[cell(n).alias(n) for n in names]).where((F.col("timestamp") != "") & urls.is_http(F.col("original")))
    once = cells.groupBy("url", "timestamp", "original").agg(F.min_by(F.struct("seq", "mimetype", "statuscode", "digest", "length"), "seq").alias("c")).select("url", "timestamp", "original", "c.*")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where(F.col("rank") <= max(1, min(MOST_CAPTURES, limit)))
    return ranked.select(
        "url",
        "rank",
        "timestamp",
        values.archive_time(F.col("timestamp")).alias("captured_at"),
        "original",
        F.nullif("mimetype", F.lit("")).alias("mimetype"),
        values.optional_int(F.col("statuscode")).alias("status"),
        F.nullif("digest", F.lit("")).alias("digest"),
        values.optional_int(F.col("length")).alias("length"),
        F.concat(F.lit(base), F.lit("/"), "timestamp", F.lit("id_/"), "original").alias("capture_url"),
    )


def page_tasks(found: DataFrame) -> DataFrame:
    return found.select("url", "rank", F.concat(F.lit("generic_web:wayback:"), "timestamp", F.lit(":"), "original").alias("task_key"), F.col("capture_url").alias("task_url"))


def observations(found: DataFrame, collection_id: Column) -> DataFrame:
    facts = values.canonical_json(digest=F.col("digest"), length=F.col("length"), mimetype=F.col("mimetype"), original=F.col("original"), status=F.col("status"), timestamp=F.col("timestamp"))
    out = found.withColumn("text", facts).withColumn("content_hash", ids.sha256(facts)).withColumn("entity_id", F.concat_ws(":", "timestamp", "original"))
    oid = ids.observation_id(collection_id, F.lit("wayback_cdx"), F.lit("archive_capture"), F.col("entity_id"), F.col("capture_url"), F.col("content_hash"))
    return out.select(oid.alias("observation_id"), "entity_id", F.col("capture_url").alias("source_url"), "text", "content_hash")
