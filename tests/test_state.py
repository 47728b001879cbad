"""Schedules, place searches, loops that go on after a loss, versions, and merges of streams."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_operators import plain_branches

from siftwork.operators import branching, crawl, files, planning, spacing, versions
from siftwork.operators.turns import Turns
from siftwork.operators.versions import TABLES, Conflict, VersionedTable
from siftwork.sources import places
from siftwork.streaming.merge import merged_into


@pytest.mark.parametrize("chunks", [1, 3, 64])
def test_schedule_equals_a_gate(spark, chunks):
    rng = random.Random(chunks)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([rng.randint(0, 400), 100, 250])) for i in range(200)] + [("a", 900, None), ("c", 901, 5)]
    df = spark.createDataFrame(rows, "provider string, seq int, t int").withColumn("at", F.timestamp_seconds("t"))
    for gap in (3.5, 0, -1):
        got = {r.seq: (r.start_micros, r.waited_micros) for r in spacing.schedule(df, "provider", "at", ["seq"], gap, chunks).collect()}
        free, want = {}, {}
        for p, i, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
            start = max(t * 1e6, free.get(p, 0))
            free[p] = start + max(0, gap) * 1e6
            want[i] = (int(start), int(start - t * 1e6))
        assert got == want
    assert spacing.schedule(df.limit(0), "provider", "at", ["seq"], 1).count() == 0


def meters(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_places_near_requests(spark):
    rng = random.Random(5)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), 89.99, -89.9, 90.0, -90.0, 0.0, 45.0]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0, 179.999, -179.99, 0.0]))
    made = [(i, rng.choice(["Old Mill", "mill", "Quay", None]), *spot()) for i in range(400)] + [(900, "Mill", None, 1.0), (901, "Mill", 95.0, 1.0)]
    asked = [(i, *spot(), rng.choice([0.0, 50.0, 3e4, 4e5, 3e6, 2.1e7]), rng.choice(["", None, "MILL"])) for i in range(120)] + [(900, None, 1.0, 5.0, ""), (901, 0.0, 0.0, -1.0, "")]
    asked += [(1000 + i, made[i][2], made[i][3], 0.0, "") for i in range(5)]
    requests = spark.createDataFrame(asked, "request_id int, latitude double, longitude double, radius double, text string")
    found = spark.createDataFrame(made, "place_id int, name string, latitude double, longitude double")
    want = {(r, p): d for r, a, b, m, t in asked if a is not None for p, n, c, e in made if c is not None and c <= 90 and (d := meters(a, b, c, e)) <= m and (t or "").lower() in (n or "").lower()}
    got = [((r.request_id, r.place_id), r.meters) for r in places.near_each(requests, found).collect()]
    assert len(got) == len(set(k for k, _ in got)) and {k for k, _ in got} == set(want) and len(want) > 500
    first = {}
    for (r, p), d in sorted(want.items(), key=lambda x: (x[0][0], round(x[1], 3), x[0][1])):
        first.setdefault(r, []).append((round(d, 3), p))
    near = {}
    for r in places.near_each(requests, found, limit=2).collect():
        near.setdefault(r.request_id, []).append(round(r.meters, 3))
    assert {k: sorted(v) for k, v in near.items()} == {k: [d for d, _ in v[:2]] for k, v in first.items()}
    plan = places.near_each(requests, found)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert places.near_each(requests.limit(0), found).count() == 0


class Lost(Exception):
    pass


def branch_case(spark):
    rng = random.Random(3)
    names = ["Old Mill", "Town Hall", "old mill", "x", "Bridge - ", '"Quay"', "Ghost", "Hill"]
    observed = [(f"u{i}", s, rng.choice(["web_page", "archive_capture_index", "web_page"]), rng.choice([*names, None])) for i in range(30) for s in range(rng.randint(1, 3))]
    territories = {"c1": "Ghost", "c2": "Elsewhere"}
    starts = [(c, t, s, f"u{t}", k, n) for c in territories for t in range(3) for u, s, k, n in observed if u == f"u{t}"]
    labels = ["Old Mill", "old mill", "Town Hall", "Bridge", "Quay", "Hill"]
    hits = list({(f.replace("%1", x).replace("%2", t), r, f"u{rng.randint(0, 29)}") for x in labels for t in territories.values() for f in planning.BRANCHES["en"] for r in range(2)})
    frames = (
        spark.createDataFrame(starts, "collection_id string, task_seq long, seq long, url string, source_kind string, title string"),
        spark.createDataFrame([(c, t, "en") for c, t in territories.items()], "collection_id string, territory string, language string"),
        spark.createDataFrame(hits, "query string, rank int, url string"),
        spark.createDataFrame(observed, "url string, seq long, source_kind string, title string"),
    )
    return frames, sorted(plain_branches(starts, territories, hits, observed, 3)[0])


@pytest.mark.parametrize("name,turn", [("queries", 1), ("tasks", 1), ("tasks", 2), ("mark", 2), ("queries", 3)])
def test_historical_loop_goes_on_after_a_loss(spark, tmp_path, name, turn):
    """A driver that is lost before, between or after the two writes of a level costs that level alone."""
    frames, want = branch_case(spark)

    class Losing(Turns):
        def write(self, at, table, rows):
            if (table, at) == (name, turn):
                rows.limit(1).write.mode("overwrite").parquet(self.path(at, table))  # part of it
                raise Lost
            return super().write(at, table, rows)

        def mark(self, at):
            if ("mark", at) == (name, turn):
                raise Lost
            super().mark(at)

    with pytest.raises(Lost):
        branching.historical_branches(*frames, max_depth=3, turns=Losing(spark, str(tmp_path)))
    turns = Turns(spark, str(tmp_path))
    assert turns.newest() == turn - 1
    tasks, queries = branching.historical_branches(*frames, max_depth=3, turns=turns)
    assert sorted(map(tuple, tasks.collect())) == want
    again, _ = branching.historical_branches(*frames, max_depth=3, turns=Turns(spark, str(tmp_path)))  # all is done: only read
    assert sorted(map(tuple, again.collect())) == want
    assert queries.count() == queries.distinct().count()


def test_breadth_first_goes_on_after_a_loss(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 1), (0, 5)], "src int, dst int")
    seeds = spark.createDataFrame([(0,), (0,)], "node int")
    want = sorted(map(tuple, crawl.breadth_first(edges, seeds, 20).collect()))
    turns = Turns(spark, str(tmp_path))
    crawl.breadth_first(edges, seeds, 3, turns=turns)
    turns.write(5, "frontier", seeds.withColumn("depth", F.lit(9)))  # written, but not marked
    assert turns.newest() == 4
    assert sorted(map(tuple, crawl.breadth_first(edges, seeds, 20, turns=Turns(spark, str(tmp_path))).collect())) == want
    assert sorted(map(tuple, crawl.breadth_first(edges, seeds, 1, turns=Turns(spark, str(tmp_path))).collect())) == [w for w in want if w[1] <= 1]


ROWS = "collection_id string, observation_id string, body string, seq bigint"


def rows(spark, *found):
    return spark.createDataFrame(list(found), ROWS)


def all_of(df):
    return sorted(map(tuple, df.select(*ROWS.replace(" string", "").replace(" bigint", "").split(", ")).collect()), key=str)


def test_versions(spark, tmp_path):
    table = VersionedTable.of_store(spark, str(tmp_path), "observations", buckets=8)
    assert table.version() == 0 and table.read().count() == 0
    one = [(f"c{i}", f"o{j}", "old", 1) for i in range(20) for j in range(2)] + [(None, "o", "null key", 1)]
    assert table.upsert(rows(spark, *one, one[0]), "seq") == 1
    before = table.manifest()
    assert table.upsert(rows(spark, ("c3", "o0", "new", 2), ("c3", "o9", "added", 2), ("c3", "o1", "late", 0)), "seq") == 2
    after = table.manifest()
    changed = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert len(changed) == 1 and len(after["folders"]) > 1  # only the bucket of c3 was written again
    want = sorted([r for r in one if r[:2] != ("c3", "o0")] + [("c3", "o0", "new", 2), ("c3", "o9", "added", 2)], key=str)
    assert all_of(table.read()) == want and all_of(table.read(1)) == sorted(one, key=str)
    assert all_of(table.read(only=["c3", "c4"])) == [r for r in want if r[0] in ("c3", "c4")]
    files_read = table.read(only=["c3"]).inputFiles()
    assert all(f"bucket={next(iter(changed))}/" in f for f in files_read)
    table.vacuum()
    assert all_of(table.read()) == want
    with pytest.raises(ValueError):
        table.read(1)


def test_a_lost_commit_is_no_version(spark, tmp_path):
    table = VersionedTable.of_store(spark, str(tmp_path), "observations", buckets=4)
    table.upsert(rows(spark, ("c", "o", "a", 1)), "seq")
    with open(f"{table.folder}/manifests/v000000002", "w") as f:
        f.write('{"version": 2, "fol')  # lost while it wrote
    assert table.version() == 1 and all_of(table.read()) == [("c", "o", "a", 1)]
    assert table.upsert(rows(spark, ("c", "o", "b", 2)), "seq") == 2 and all_of(table.read()) == [("c", "o", "b", 2)]


def test_two_writers(spark, tmp_path, monkeypatch):
    """A second writer commits while the first one is at work: neither's rows are lost, in one bucket or in several."""
    mine = VersionedTable.of_store(spark, str(tmp_path), "observations", buckets=4)
    other = VersionedTable.of_store(spark, str(tmp_path), "observations", buckets=4)
    real, merges = files.write_once, []

    def late(session, path, text):
        if "/manifests/" in path and len(merges) < 2:
            merges.append(path)
            monkeypatch.setattr(versions.files, "write_once", real)
            other.upsert(rows(spark, *[(f"c{i}", "o", "theirs", len(merges) * 10) for i in (range(40) if len(merges) == 1 else [0])]), "seq")
            monkeypatch.setattr(versions.files, "write_once", late)
        return real(session, path, text)

    monkeypatch.setattr(versions.files, "write_once", late)
    assert mine.upsert(rows(spark, ("c0", "o", "mine", 5), ("c1", "p", "mine", 5)), "seq") == 3
    assert all_of(mine.read()) == sorted([(f"c{i}", "o", "theirs", 20 if i == 0 and len(merges) > 1 else 10) for i in range(40)] + [("c1", "p", "mine", 5)], key=str)
    monkeypatch.setattr(versions.files, "write_once", lambda *a: False)
    with pytest.raises(Conflict):
        mine.upsert(rows(spark, ("x", "y", "z", 1)), "seq", tries=2)


def test_tables_of_the_store(spark, tmp_path):
    for name, (schema, keys, layout) in TABLES.items():
        table = VersionedTable.of_store(spark, str(tmp_path), name, buckets=2)
        values = [("1" if kind == "string" else 1) for kind in (c.split()[1] for c in schema.split(", "))]
        made = spark.createDataFrame([tuple(values)], schema)
        table.upsert(made, "seq")
        table.upsert(made, "seq")
        assert table.read().count() == 1 and layout in keys
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path), ROWS, ["observation_id"], "collection_id")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = VersionedTable.of_store(spark, str(tmp_path / "t"), "observations", buckets=4)
    merge = merged_into(table, "seq", "landing")
    landed = tmp_path / "landed"
    stream = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(landed)).writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    first = rows(spark, ("c", "o", "a", 1), ("d", "o", "a", 1)).coalesce(1)
    first.write.mode("append").parquet(str(landed))
    stream()
    rows(spark, ("c", "o", "b", 2)).coalesce(1).write.mode("append").parquet(str(landed))
    stream()
    want = [("c", "o", "b", 2), ("d", "o", "a", 1)]
    assert all_of(table.read()) == want and table.manifest()["notes"] == {"landing": 1} and table.version() == 2
    merge(rows(spark, ("c", "o", "again", 9)), 1)  # the driver was lost before the stream noted the batch
    merge(first, 0)
    assert all_of(table.read()) == want and table.version() == 2
    merged_into(table, "seq", "other")(rows(spark, ("e", "o", "e", 1)), 0)  # another stream has numbers of its own
    assert table.manifest()["notes"] == {"landing": 1, "other": 0}


def test_place_searches_of_one_cell_are_many_tasks(spark, monkeypatch):
    """A hot cell's rows meet in blocks; the number of partitions follows the pairs."""
    monkeypatch.setattr(places, "BLOCK", 50, raising=False)
    monkeypatch.setattr(places, "TASK_PAIRS", 1000, raising=False)
    at = lambda n, k: [(i, "x", 10 + i % 7 * 1e-6, 20 + i * k * 1e-6) for i in range(n)]
    asked = spark.createDataFrame(at(120, 1), "request_id int, n string, latitude double, longitude double").drop("n").withColumn("radius", F.lit(20.0))
    made = spark.createDataFrame(at(300, 2), "place_id int, name string, latitude double, longitude double")
    found = places.near_each(asked, made)
    got = [(r.request_id, r.place_id) for r in found.collect()]
    want = {(r, p) for r, _, a, b in at(120, 1) for p, _, x, y in at(300, 2) if meters(a, b, x, y) <= 20}
    assert len(got) == len(want) and set(got) == want and 0 < len(want) < 120 * 300
    used = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) > 4 and max(r["count"] for r in used) < len(want) / 2


def test_place_searches_send_no_rows_through_the_driver(spark):
    """Rows of cells are many more than the rows that they come from, so Spark's guess at their size is far too low."""
    point = lambda a, b: [(F.col("id") * a % 1801 / 10 - 90).alias("latitude"), (F.col("id") * b % 3601 / 10 - 180).alias("longitude")]
    asked = spark.range(200).select(F.col("id").alias("request_id"), *point(37, 1213), F.when(F.col("id") % 2 == 0, 5e5).otherwise(2e4).alias("radius"))
    made = spark.range(1000).select(F.col("id").alias("place_id"), F.lit("x").alias("name"), *point(53, 7919))
    store = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: [x.apply(i) for x in [store.executionsList()] for i in range(x.size())]
    first = max([-1, *(x.executionId() for x in runs())])
    got = [(r.request_id, r.place_id) for r in places.near_each(asked, made).collect()]
    placed = made.collect()
    want = {(r.request_id, p.place_id) for r in asked.collect() for p in placed if meters(r.latitude, r.longitude, p.latitude, p.longitude) <= r.radius}
    assert len(got) == len(want) and set(got) == want and len(want) > 100
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in runs() if x.executionId() > first]
    assert any("Join" in x for x in plans) and not any("Broadcast" in x for x in plans)
