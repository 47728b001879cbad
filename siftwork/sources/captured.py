"""A Python data source over captured payload files: rows (name, body, charset, error), in batches and as a stream.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPayloads)
    spark.read.format("captured").option("path", folder).load()
    spark.readStream.format("captured").option("path", folder).load()

Files are packed into partitions by size, so many small files are few tasks. A body is decoded by its byte order mark, else
by `content_type` (an option, as files have no header), else by its meta tag, else as UTF-8. A file of more than max_bytes bytes
has no body and the error RESPONSE_TOO_LARGE. Filters on names are pushed down to the listing.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..functions.text import decode_bytes

PARTITION_BYTES, PARTITION_FILES, FILE_COST = 32 << 20, 4096, 4096  # of a partition; what opening a file costs, in bytes
BATCH_BYTES = 4 << 20
SETTLE_SECONDS = 2.0  # a file this young may still be written, or have others of its instant beside it


class CapturedPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "name string, body string, charset string, error string"

    def reader(self, schema) -> DataSourceReader:
        return CapturedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CapturedStreamReader(dict(self.options))


class _Files:
    """Files are listed and read through pyarrow's file systems, so the folder may lie in any store these know."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("max_bytes", 5 << 20))
        self.content_type = options.get("content_type")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def listed(self) -> list[tuple[str, int, int]]:
        """(name, bytes, nanoseconds of its last change) of the files that fit the pattern, by name."""
        from pyarrow import fs

        system, top = self._system()
        found = [(i.base_name, i.size or 0, i.mtime_ns or 0) for i in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.is_file]
        return sorted(f for f in found if fnmatch.fnmatch(f[0], self.pattern))

    @staticmethod
    def packed(files: Iterable[tuple[str, int, int]]) -> list[InputPartition]:
        """Partitions of whole files, of about PARTITION_BYTES."""
        out, size = [[]], 0
        for name, n, _ in files:
            if out[-1] and (size + n + FILE_COST > PARTITION_BYTES or len(out[-1]) >= PARTITION_FILES):
                out.append([])
                size = 0
            out[-1].append(name)
            size += n + FILE_COST
        return [InputPartition(names) for names in out if names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, top = self._system()
        rows, size = [], 0
        for name in partition.value:
            with system.open_input_file(f"{top}/{name}") as f:
                body = f.read(self.most + 1)
            if len(body) <= self.most:
                rows.append((name, *decode_bytes(body, self.content_type), None))
                size += len(body)
            else:
                rows.append((name, None, None, "RESPONSE_TOO_LARGE"))
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["name", "body", "charset", "error"])


class CapturedReader(_Files, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.equal: list[str] = []
        self.prefix: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.equal.append(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.prefix.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.packed(f for f in self.listed() if all(f[0] == e for e in self.equal) and all(f[0].startswith(p) for p in self.prefix))


class CapturedStreamReader(_Files, DataSourceStreamReader):
    """An offset is an instant: a batch holds the files that changed after its start and up to its end. The end lies
    `settle_seconds` in the past, so no file of a batch can appear after it was listed, and a batch that is given again has the
    same files."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.settle = float(options.get("settle_seconds", SETTLE_SECONDS))

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        upto = time.time_ns() - int(self.settle * 1e9)
        return {"ns": max((ns for _, _, ns in self.listed() if ns <= upto), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.packed(f for f in self.listed() if start["ns"] < f[2] <= end["ns"])
