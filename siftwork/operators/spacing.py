"""Start times of requests that must keep a distance: a max-plus prefix scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schedule(log: DataFrame, provider: str, at: str, order: list[str], gap_seconds: float, chunks: int = 64) -> DataFrame:
    """The log with start_micros, the earliest start of each request, and waited_micros: requests of a provider start in the
    order in which they arrive, each at its arrival or `gap_seconds` after the start before it, whichever is later.

    start = max(arrival, start before + gap) unrolls to n * gap + the running maximum of arrival - n * gap. Times are cut
    into chunks at quantiles of all arrivals. A chunk of a provider is scanned alone, and what it leaves for the next
    is one number and its count, so a provider with a third of all requests is scanned by many tasks. Requests at one
    instant are one chunk. Rows without a time are left out; no gap, or a negative one, lets each start as it arrives.
    """
    gap = max(0, round(gap_seconds * 1_000_000))
    rows = log.where(F.col(at).isNotNull()).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    cuts = rows.agg(F.percentile_approx("_at", [i / chunks for i in range(1, chunks)])).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    dealt = rows.withColumn("_chunk", F.size(F.filter(bounds, lambda c: c < F.col("_at"))))
    turn = Window.partitionBy(provider, "_chunk").orderBy("_at", *order)
    numbered = dealt.withColumn("_n", F.row_number().over(turn) - 1).withColumn("_late", F.max(F.col("_at") - F.col("_n") * gap).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    of_chunk = dealt.withColumn("_n", F.row_number().over(turn) - 1).groupBy(provider, "_chunk").agg(F.count("*").alias("_c"), F.max(F.col("_at") - F.col("_n") * gap).alias("_most"))
    before = Window.partitionBy(provider).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # of as many rows as there are chunks
    counted = of_chunk.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    free: Column = F.max(F.col("_most") - F.col("_before") * gap).over(before) + F.col("_before") * gap
    entered = counted.select(F.col(provider).alias("_provider"), F.col("_chunk").alias("_of"), free.alias("_free"))
    both = numbered.join(entered, F.col(provider).eqNullSafe(F.col("_provider")) & (F.col("_chunk") == F.col("_of")))
    start = F.col("_n") * gap + F.greatest("_late", "_free")
    return both.withColumn("start_micros", start).withColumn("waited_micros", start - F.col("_at")).drop("_at", "_chunk", "_n", "_late", "_provider", "_of", "_free")
