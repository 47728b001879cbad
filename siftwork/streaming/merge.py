"""Streams merged into versioned tables, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.versions import VersionedTable


def merged_into(table: VersionedTable, order: str, stream: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts a batch, the largest `order` of a key wins. The batch's number goes with the commit, so a batch
    that is given again after a lost driver changes nothing, whether or not its first try was committed."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if table.manifest()["notes"].get(stream, -1) < batch_id:
            table.upsert(batch, order, notes={stream: batch_id})

    return merge
