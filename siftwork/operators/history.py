"""Snapshot chains: previous snapshot, change flag, line diff."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.ids import sha256


def snapshot_chain(captures: DataFrame, key: str = "source_url", order: tuple[str, ...] = ("collected_at", "seq"), content: str = "content", snapshot_id: str = "snapshot_id") -> DataFrame:
    """Each capture with its content hash, the key's previous snapshot and whether the content changed (null at first)."""
    w = Window.partitionBy(key).orderBy(*order)
    hashed = captures.withColumn("content_hash", sha256(F.col(content)))
    return hashed.withColumn("previous_snapshot_id", F.lag(snapshot_id).over(w)).withColumn("changed", F.lag("content_hash").over(w) != F.col("content_hash"))


def with_previous_content(captures: DataFrame, key: str, capture_id: str, content: str) -> DataFrame:
    """Each capture (ids are unique) with before_id and before: the id and content of its key's previous capture.

    Only ids are sorted by key; contents meet by the id that they are wanted for, so a key with many captures
    gathers none of them.
    """
    order = captures.select(key, capture_id).withColumn("before_id", F.lag(capture_id).over(Window.partitionBy(key).orderBy(capture_id)))
    wanted = order.where("before_id is not null").select("before_id", F.col(capture_id).alias("for_id"))
    given = captures.select(F.col(capture_id).alias("before_id"), F.col(content).alias("before")).join(wanted, "before_id")
    return captures.join(given, F.col(capture_id) == F.col("for_id"), "left").drop("for_id")


DIFF_ROWS = 64  # rows whose texts and diffs a task holds as Python strings at once


@arrow_udf(T.StringType())
def unified_diff(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Unified line diff of the columns before, after and name with three lines of context; null where nothing precedes or
    changes. Diffs leave in small slices, so a batch of long texts is never held with all its diffs."""

    def diff(a: str | None, b: str | None, n: str | None) -> str | None:
        if a is None or b is None or a == b:
            return None
        return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), fromfile=n or "previous", tofile="current", lineterm=""))

    for batch in batches:
        for at in range(0, len(batch[0]), DIFF_ROWS):
            part = (column.slice(at, DIFF_ROWS).to_pylist() for column in batch)
            yield pa.array([diff(*x) for x in zip(*part, strict=True)], pa.string())
