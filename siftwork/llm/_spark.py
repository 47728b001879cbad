"""Shared folder, saved tables, a bounded id filter and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: the folders of the innermost interim() block
_INTERIM: ContextVar[list[str] | None] = ContextVar("interim", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share.

    Where the setting is absent (tests, a local session) a temporary folder stands in; a cluster
    without the setting is refused. The folder goes when the driver ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = getattr(sc, "_siftwork_local", None)
        if top is None:
            top = sc._siftwork_local = "file://" + tempfile.mkdtemp(prefix="siftwork-")
    folder = f"{top.rstrip('/')}/siftwork-{sc.applicationId}"
    if not getattr(sc, "_siftwork_cleanup", False):
        sc._siftwork_cleanup = True
        atexit.register(_remove, sc, folder)
    return folder


def _remove(sc, folder: str) -> None:
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone at exit
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def interim(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside the block are removed when it ends, but for lasting ones."""
    paths: list[str] = []
    outer = _INTERIM.set(paths)
    try:
        yield
    finally:
        _INTERIM.reset(outer)
        for path in paths:
            _remove(spark.sparkContext, path)


BATCH_BYTES = 4 << 20  # of an Arrow batch while a table is saved


def saved(df: DataFrame, name: str, batch_rows: int | None = None, lasting: bool = False) -> DataFrame:
    """Write to the shared folder and read again: later jobs neither recompute nor depend on an executor.

    The shuffle files of this write go when it ends, as the table replaces them.
    Arrow batches have about BATCH_BYTES at most, so neither a Python worker nor its executor holds 10,000 long texts at once;
    rows without texts go in batches as large as ever.
    batch_rows: rows per Arrow batch while this table is made, for rows that hold long values.
    lasting: the table outlives an interim() block.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if (paths := _INTERIM.get()) is not None and not lasting:
        paths.append(path)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    if batch_rows:
        settings[key] = str(min(batch_rows, rows) if rows > 0 else batch_rows)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


SALTS = 8


def joined_in_parts(many: DataFrame, one: DataFrame, key: str, salt: str, how: str) -> DataFrame:
    """many joined with one (each key at most once) on key. Rows of a key in `many`, however many, are dealt over SALTS
    parts by a hash of `salt`, and `one` is repeated for each part; Spark may broadcast it where its size allows."""
    parts = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_part", F.pmod(F.xxhash64(F.col(salt)), F.lit(SALTS)).cast("int")).join(parts, [key, "_part"], how).drop("_part")


def joined_by_share(many: DataFrame, one: DataFrame, key: str, salt: str, counted: DataFrame | None = None, rows: int = 512) -> DataFrame:
    """many joined with one (each key at most once, long values) on key. A key with c rows in `many`, more than `rows`, is
    dealt over c / rows parts by a hash of `salt`, and its row of `one` is repeated for these only; without such a key
    this is the plain join. counted: a saved table with as many rows of each key as `many`, where that is costly to make."""
    hot = (many if counted is None else counted).groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > rows).select(key, F.ceil(F.col("c") / rows).cast("int").alias("_parts"))
    if not hot.take(1):
        return many.join(one, key)
    dealt = joined_in_parts(many, hot, key, salt, how="left").withColumn("_share", F.pmod(F.xxhash64(F.col(salt)), F.coalesce("_parts", F.lit(1)).cast("bigint"))).drop("_parts")
    spread = one.join(hot, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1))).drop("_parts")
    return dealt.join(spread, [key, "_share"]).drop("_share")


class IdFilter:
    """A bit table over 64-bit ids with about eight bits for each: no id that was put in is ever missed.

    It has 2**22 to 2**28 bits (half a MB to 32 MB), so it can be broadcast at any scale; with more than
    3 * 10**7 ids it lets more through. What comes through is joined or only costs time.
    """

    def __init__(self, ids: DataFrame, column: str):
        bits = min(28, max(22, (8 * ids.count()).bit_length()))
        h = F.xxhash64(F.col(column))
        where = h.bitwiseAND(F.lit((1 << bits) - 1))
        words = (
            ids.select(F.shiftright(where, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), where.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
            .groupBy("w")
            .agg(F.bit_or("b").alias("b"))
        )
        got = words.toArrow()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[got["w"].to_numpy()] = got["b"].to_numpy()
        self.bits = bits
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def keep(self, df: DataFrame, column: str, work, schema: str) -> DataFrame:
        """What `work`, a function over Arrow batches, makes of the rows of df that may have an id of the filter."""
        bits, table = self.bits, self.table

        def some(batches):
            import pyarrow as pa

            for batch in batches:
                where = batch.column(batch.num_columns - 1).to_numpy()
                hit = (table.value[where >> 6] >> (where & 63)) & 1
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(hit.astype(bool)))

        where = F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << bits) - 1))
        return df.select("*", where.alias("_where")).mapInArrow(lambda batches: work(some(batches)), schema)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reachable.

    Each round links every node to the smallest label around it and then jumps to that label's own
    label; rounds grow with the logarithm of a component's diameter. Each round is one saved table.
    Groups are pre-aggregated before they are shuffled, joins deal a hot node over several parts, and no
    component is ever gathered.
    """
    both = saved(edges.select("a", "b").where("a <> b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{name}-edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = joined_in_parts(both, labels.select(F.col("node").alias("b"), "label"), "b", "a", how="inner").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # hooking: the old label's own node also takes the smaller label
        hook = low.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        low = low.join(hook, "node", "left").select("node", "label", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("to"))
        after = saved(joined_in_parts(low, jump, "low", "node", how="left").select("node", F.least("low", F.coalesce("to", "low")).alias("new"), "label"), f"{name}-{turn}")
        if not after.where("new <> label").take(1):
            return after.select("node", F.col("new").alias("label"))
        labels = after.select("node", F.col("new").alias("label"))
