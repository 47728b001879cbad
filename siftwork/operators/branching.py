"""The historical loop: labels of observations become queries, their hits tasks, and these observations again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crawl import checkpointed
from .planning import BRANCHES, PER_COLLECTION, PER_EXPANSION, clean_label, usable_label
from .turns import Turns

#: Kinds of sources whose observations name no entities.
NON_ENTITY_KINDS = ["archive_capture_index"]


def entity_labels(observations: DataFrame, label_columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """Rows (collection_id, task_seq, seq, label) of the labels of observations, but for kinds that name no entities.
    Input: collection_id, task_seq, seq, source_kind and the label columns, in order."""
    some = observations.where(~F.coalesce(F.col("source_kind").isin(NON_ENTITY_KINDS), F.lit(False)))
    each = some.select("collection_id", "task_seq", "seq", F.posexplode(F.array(*label_columns)).alias("j", "label")).where("label is not null")
    return each.select("collection_id", "task_seq", (F.col("seq") * len(label_columns) + F.col("j")).alias("seq"), "label")


def expand_tasks(labels: DataFrame, collections: DataFrame, seen: DataFrame) -> DataFrame:
    """New queries (collection_id, task_seq, n, query): of each task the first PER_EXPANSION that its collection has not
    seen, tasks in turn, until the collection has PER_COLLECTION with those seen.

    labels: collection_id, task_seq, seq, label; collections: collection_id, territory, language; seen:
    collection_id, query. A task needs no more candidates than both limits together, so what is gathered of a
    collection is bounded by its page budget; the fold itself is one native aggregate.
    """
    need = PER_EXPANSION + PER_COLLECTION
    cleaned = labels.join(collections, "collection_id").withColumn("entity", clean_label(F.col("label"))).where(usable_label(F.col("entity")) & (F.lower("entity") != F.lower("territory")))
    firsts = cleaned.groupBy("collection_id", "task_seq", F.lower("entity").alias("k")).agg(F.min_by(F.struct("entity", "territory", "language", "seq"), "seq").alias("e")).select("collection_id", "task_seq", "e.*")
    forms = {lang: F.array(*map(F.lit, b)) for lang, b in BRANCHES.items()}
    each = firsts.select("collection_id", "task_seq", "seq", "entity", "territory", F.posexplode(F.when(F.col("language") == "ru", forms["ru"]).otherwise(forms["en"])).alias("j", "form"))
    query = F.replace(F.replace(F.col("form"), F.lit("%1"), F.col("entity")), F.lit("%2"), F.col("territory"))
    new = each.select("collection_id", "task_seq", "seq", "j", query.alias("query")).join(seen, ["collection_id", "query"], "left_anti")
    few = new.groupBy("collection_id", "task_seq").agg(F.slice(F.sort_array(F.collect_list(F.struct("seq", "j", "query"))), 1, need).alias("q"))
    turns = few.groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("task_seq", "q"))).alias("turns"))
    used = seen.groupBy("collection_id").agg(F.count("*").cast("int").alias("used"))
    none = F.array().cast("array<struct<task_seq: bigint, query: string>>")

    def turn(taken: Column, task: Column) -> Column:
        known = F.transform(taken, lambda x: x["query"])
        fresh = F.filter(F.array_distinct(F.transform(task["q"], lambda x: x["query"])), lambda x: ~F.array_contains(known, x))
        left = F.least(F.lit(PER_EXPANSION), F.greatest(F.lit(0), PER_COLLECTION - F.col("used") - F.size(taken)))
        return F.concat(taken, F.transform(F.slice(fresh, F.lit(1), left), lambda x: F.struct(task["task_seq"].cast("bigint").alias("task_seq"), x.alias("query"))))

    both = turns.join(used, "collection_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return both.select("collection_id", F.posexplode(F.aggregate("turns", none, turn)).alias("n", "x")).select("collection_id", "x.task_seq", "n", "x.query")


def historical_branches(starts: DataFrame, collections: DataFrame, hits: DataFrame, observed: DataFrame, max_depth: int, save=None, turns: Turns | None = None) -> tuple[DataFrame, DataFrame]:
    """The loop over captured search results: (tasks, queries).

    starts: collection_id, task_seq, seq, url, source_kind, title of the first observations; collections: collection_id,
    territory, language, only of those that ask for history; hits: query, rank, url; observed: url, seq, source_kind,
    title. tasks: collection_id, depth, task_seq, url, from_query; queries: collection_id, depth, query. A URL is a
    task of its collection once; a query without hits gives no task and no error. Each level is saved as the
    frontier of the next, so a lost executor costs at most one level. With `turns`, levels are its turns, and the loop
    goes on from the newest whole one, so a lost driver costs at most one level as well.
    """
    spark = starts.sparkSession
    if turns is None:
        save = save or checkpointed(spark)
        keep = lambda depth, name, rows: save(rows)
    else:
        keep = turns.write
    done = turns.newest() if turns else 0
    queries = spark.createDataFrame([], "collection_id string, depth int, query string")
    tasks = spark.createDataFrame([], "collection_id string, depth int, task_seq bigint, url string, from_query string")
    visited = starts.select("collection_id", "url").distinct()
    level = starts.join(collections.select("collection_id"), "collection_id", "left_semi").select("collection_id", "task_seq", "seq", "source_kind", "title")
    observations = lambda frontier: frontier.join(observed, "url").select("collection_id", "task_seq", "seq", "source_kind", "title")
    if done:
        queries, tasks = (turns.upto(min(done, max_depth), name, none) for name, none in (("queries", queries), ("tasks", tasks)))
        visited = visited.unionByName(tasks.select("collection_id", "url"))
        frontier = turns.read(done, "tasks")
        if not frontier.take(1):
            return tasks, queries
        level = observations(frontier)
    for depth in range(done + 1, max_depth + 1):
        new = keep(depth, "queries", expand_tasks(entity_labels(level), collections, queries.select("collection_id", "query")).withColumn("depth", F.lit(depth)))
        found = new.join(hits, "query").groupBy("collection_id", "url").agg(F.min(F.struct("n", "rank", "query")).alias("at"))
        fresh = found.join(visited, ["collection_id", "url"], "left_anti")
        order = F.struct("at.n", "at.rank", "url")
        ranked = fresh.groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("url"), F.col("at.query").alias("from_query")))).alias("t"))
        frontier = keep(depth, "tasks", ranked.select("collection_id", F.lit(depth).alias("depth"), F.posexplode("t").alias("p", "x")).select("collection_id", "depth", F.col("p").cast("bigint").alias("task_seq"), "x.url", "x.from_query"))
        if turns:
            turns.mark(depth)
        queries = queries.unionByName(new.select("collection_id", "depth", "query"))
        if not frontier.take(1):
            break
        tasks = tasks.unionByName(frontier)
        visited = visited.unionByName(frontier.select("collection_id", "url"))
        level = observations(frontier)
    return tasks, queries


def checkpoint_tables(tasks: DataFrame, done: DataFrame, turns: Turns, turn: int) -> None:
    """The state of a collection's loop as the two tables of a turn: `visited` (task keys that were processed) and `pending`
    (the rest). tasks and done: collection_id, task_key, ..."""
    keys = ["collection_id", "task_key"]
    turns.write(turn, "visited", done.select(*keys).distinct())
    turns.write(turn, "pending", tasks.join(done.select(*keys), keys, "left_anti"))
    turns.mark(turn)


def restored(turns: Turns) -> tuple[DataFrame, DataFrame] | None:
    """(pending, visited) of the newest whole turn; None before the first."""
    turn = turns.newest()
    return (turns.read(turn, "pending"), turns.read(turn, "visited")) if turn else None
