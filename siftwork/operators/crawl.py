"""Bounded breadth-first expansion of a link graph, one saved level at a time."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .turns import Turns


def expand_links(tasks: DataFrame, links: DataFrame, max_depth: int, max_links: int, in_scope: Column) -> DataFrame:
    """Child tasks of fetched tasks: feed links keep the depth and know no limit of it; page links add one, below max_depth
    only, from the first max_links of a page before scope is judged. tasks: collection_id, url, depth; links: url, seq, link, is_feed."""
    j = tasks.join(links, "url")
    feed = j.where("is_feed").select("collection_id", "seq", F.col("link").alias("url"), "depth")
    page = j.where(~F.col("is_feed") & (F.col("depth") < max_depth) & (F.col("seq") <= max_links)).where(in_scope).select("collection_id", "seq", F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"))
    return feed.unionByName(page)


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int, save=None, turns: Turns | None = None) -> DataFrame:
    """Rows (node, depth) reachable from seeds (node) over edges (src, dst), each at its smallest depth.

    One job per level: the frontier joins the edges, and nodes seen before are taken out. `save` cuts the
    lineage of each level; by default DataFrame.checkpoint(), which writes to the shared checkpoint folder. With `turns`,
    level d is turn d + 1, and the loop goes on from the newest whole one.
    """
    if turns is None:
        save = save or checkpointed(edges.sparkSession)
        edges = save(edges.select("src", "dst"))  # read by every level

    def keep(depth: int, rows: DataFrame) -> DataFrame:
        if turns is None:
            return save(rows)
        found = turns.write(depth + 1, "frontier", rows)
        turns.mark(depth + 1)
        return found

    first = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    done = min(turns.newest(), max_depth + 1) if turns else 0
    if done:
        frontier = turns.read(done, "frontier")
        seen = turns.upto(done, "frontier", first.limit(0))
    else:
        frontier = seen = keep(0, first)
        done = 1
    for depth in range(done, max_depth + 1):
        if not frontier.take(1):
            break
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = keep(depth, found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def checkpointed(spark):
    """DataFrame.checkpoint(), which writes to spark.checkpoint.dir."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        _local_checkpoints(spark.sparkContext)
    return lambda df: df.checkpoint()


def _local_checkpoints(sc) -> None:
    """A checkpoint folder for a session without spark.checkpoint.dir whose executor is the driver; it goes when that ends."""
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="siftwork-levels-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(f"file://{folder}")


def within_budget(tasks: DataFrame, budget: Column) -> DataFrame:
    """The first tasks of each collection in queue order, as many as its page budget; the rest are left over."""
    n = F.row_number().over(Window.partitionBy("collection_id").orderBy("seq"))
    return tasks.withColumn("turn", n).withColumn("in_budget", F.col("turn") <= budget)
