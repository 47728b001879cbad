"""A keyed table in versions: manifests of Parquet folders, atomic commits, merges that rewrite touched buckets only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files
from .dedupe import latest

#: Tables of the evidence store: columns, key, and the column they are laid out by.
TABLES = {
    "collections": ("collection_id string, status string, body string, seq bigint", ["collection_id"], "collection_id"),
    "observations": ("collection_id string, observation_id string, body string, seq bigint", ["collection_id", "observation_id"], "collection_id"),
    "evidence": ("collection_id string, evidence_id string, body string, seq bigint", ["collection_id", "evidence_id"], "collection_id"),
    "snapshots": ("source_url string, snapshot_id string, body string, seq bigint", ["source_url", "snapshot_id"], "source_url"),
    "site_recipes": ("domain string, goal string, version int, recipe_id string, body string, seq bigint", ["domain", "goal", "version"], "domain"),
}


class Conflict(Exception):
    """Another writer has committed to the same buckets again and again."""


class VersionedTable:
    """Rows by key in buckets of a layout column of the key. A version is one manifest, a file that names the folder of each
    bucket and is created at most once; it counts as soon as it is whole. Data folders never change, so a reader keeps
    its version while writers go on, and what a lost writer left is in no manifest.

    An upsert reads and rewrites the buckets of its rows alone. If another writer was first, the manifest is made anew:
    with the folders written already where the other touched other buckets, else after a new merge."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], layout: str, buckets: int = 64):
        if layout not in keys:
            raise ValueError("a table is laid out by a column of its key, or a row could move to another bucket")
        self.spark, self.folder, self.keys, self.layout, self.buckets = spark, folder.rstrip("/"), keys, layout, buckets
        self.schema = StructType.fromDDL(schema)

    @classmethod
    def of_store(cls, spark: SparkSession, folder: str, name: str, buckets: int = 64) -> VersionedTable:
        schema, keys, layout = TABLES[name]
        return cls(spark, f"{folder}/{name}", schema, keys, layout, buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.layout).cast("string")), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest version; 0 is the empty table."""
        known = [int(n.removeprefix("v")) for n in files.names(self.spark, f"{self.folder}/manifests")]
        newest = max(known, default=0)
        return newest if not newest or self._manifest(newest) is not None else newest - 1

    def _manifest(self, version: int) -> dict | None:
        text = files.read_whole(self.spark, f"{self.folder}/manifests/v{version:09d}")
        return None if text is None else json.loads(text)

    def manifest(self, version: int | None = None) -> dict:
        """version, folders (bucket to folder) and notes of a version."""
        version = self.version() if version is None else version
        found = self._manifest(version) if version else {"version": 0, "folders": {}, "notes": {}}
        if found is None:
            raise ValueError(f"there is no version {version}")
        return found

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = sorted(folders)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, only: list | None = None) -> DataFrame:
        """The rows of a version, the newest by default; `only`: those of these layout values, from their buckets alone."""
        folders = self.manifest(version)["folders"]
        if only is None:
            return self._read(folders.values())
        kind = self.schema[self.layout].dataType
        wanted = self.spark.createDataFrame([(v,) for v in only], StructType([self.schema[self.layout]]))
        buckets = {str(r[0]) for r in wanted.select(self.bucket()).distinct().collect()}
        return self._read(f for b, f in folders.items() if b in buckets).where(F.col(self.layout).isin([F.lit(v).cast(kind) for v in only]))

    def upsert(self, rows: DataFrame, order: str, notes: dict | None = None, tries: int = 10) -> int:
        """Rows by key, the largest `order` wins; gives the new version. `notes` are kept in the manifest and go with the
        commit. Rows without change make a version all the same."""
        commit = uuid.uuid4().hex
        top = f"{self.folder}/data/{commit}"
        rows.select(*self.schema.names, self.bucket().alias("bucket")).write.parquet(f"{top}/rows")
        staged = self.spark.read.parquet(f"{top}/rows")
        touched = {str(r[0]) for r in staged.select("bucket").distinct().collect()}  # as many as there are buckets at most
        base, mine = None, {}
        for turn in range(tries):
            now = self.manifest()
            if base is None or any(base["folders"].get(b) != now["folders"].get(b) for b in touched):
                mine = self._merged(staged, now, touched, order, f"{top}/merged-{turn}")
            base = now
            text = json.dumps({"version": now["version"] + 1, "folders": {**now["folders"], **mine}, "notes": {**now["notes"], **(notes or {})}})
            if files.write_once(self.spark, f"{self.folder}/manifests/v{now['version'] + 1:09d}", text):
                files.remove(self.spark, f"{top}/rows")
                return now["version"] + 1
            if self._manifest(now["version"] + 1) is None:
                files.remove(self.spark, f"{self.folder}/manifests/v{now['version'] + 1:09d}")  # left by a lost writer
        raise Conflict(self.folder)

    def _merged(self, staged: DataFrame, base: dict, touched: set[str], order: str, path: str) -> dict[str, str]:
        """Write the touched buckets with the staged rows, and name their folders. A large bucket is written by several tasks."""
        old = self._read(f for b, f in base["folders"].items() if b in touched)
        rows = latest(old.unionByName(staged.drop("bucket")), self.keys, [order]).withColumn("bucket", self.bucket())
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return {b: f"{path}/bucket={b}" for b in touched}

    def vacuum(self, keep: int = 1) -> None:
        """Remove manifests but for the last `keep`, and data that these do not name."""
        newest = self.version()
        kept = [self.manifest(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        used = {f.split("/data/")[1].split("/")[0] for m in kept for f in m["folders"].values()}
        for n in files.names(self.spark, f"{self.folder}/manifests"):
            if int(n.removeprefix("v")) <= newest - keep:
                files.remove(self.spark, f"{self.folder}/manifests/{n}")
        for n in files.names(self.spark, f"{self.folder}/data"):
            if n not in used:
                files.remove(self.spark, f"{self.folder}/data/{n}")
