"""Behaviour that no table shows: ids, redaction, status table, streams, data source, chains."""

import itertools
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.functions import ids, text, urls, values
from siftwork.operators import branching, crawl, history, planning, status
from siftwork.operators.turns import Turns
from siftwork.sources.captured import CapturedPayloads
from siftwork.streaming.health import event_counts, health_updates


def test_stable_ids_are_uuid5(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("ü", "b")], "a string, b string")
    got = [r[0] for r in rows.select(ids.stable_id("k", F.col("a"), F.col("b"))).collect()]
    name = uuid.UUID(ids.NAMESPACE)
    assert got == [str(uuid.uuid5(name, "\x1f".join(("k", a, b)))) for a, b in (("a", ""), ("a", ""), ("ü", "b"))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(secret=st.from_regex(r"[A-Za-z0-9]{12,20}", fullmatch=True), form=st.sampled_from(["token={}", "Password : {}", "x Bearer {} y", "https://u:{}@h.example/p", "http://h/p?k={}#z"]))
def test_secrets_never_survive(spark, secret, form):
    row = spark.createDataFrame([(form.format(secret),)], "t string").select(text.redact(F.col("t")).alias("t")).first()
    assert secret not in row.t


def test_redaction_cuts_long_text(spark):
    row = spark.createDataFrame([("x" * 50,)], "t string").select(text.redact(F.col("t"), 10).alias("t")).first()
    assert row.t == "x" * 10 + "…"


def test_status_table(spark):
    cases = list(itertools.product([0, 2], [False, True], [False, True], [False, True], [False, True], [False, True]))
    rows = [(i, obs, blk, part and not blk, ["SOURCE_ERROR"] if err else [], bud, allow) for i, (obs, blk, part, err, bud, allow) in enumerate(cases)]
    df = spark.createDataFrame(rows, "collection_id int, observations long, blocked boolean, partial boolean, error_codes array<string>, bud boolean, allow boolean")
    got = {r.collection_id: (r.status, r.is_partial) for r in status.collection_status(df, F.col("bud"), F.col("allow")).collect()}
    for i, obs, blk, part, codes, bud, allow in rows:
        bad = blk or part or bool(codes) or bud
        if obs and bad:
            want = ("partial", True) if allow else ("failed", False)
        elif not obs and blk and not (codes or bud):
            want = ("blocked", False)
        elif not obs and (part or codes or bud):
            want = ("failed", False)
        else:
            want = ("completed", False)
        assert got[i] == want


def test_blocking_codes_do_not_degrade(spark):
    df = spark.createDataFrame([("c", 1, False, False, ["DISCOVERY_BLOCKED"])], "collection_id string, observations long, blocked boolean, partial boolean, error_codes array<string>")
    assert status.collection_status(df).first().status == "completed"


def test_unified_diff(spark):
    rows = spark.createDataFrame([("u", 1, "a\nb"), ("u", 2, "a\nc"), ("u", 3, "a\nc")], "source_url string, seq int, content string")
    chain = history.snapshot_chain(rows.withColumn("snapshot_id", F.col("seq")), order=("seq",)).orderBy("seq").collect()
    assert [(r.previous_snapshot_id, r.changed) for r in chain] == [(None, None), (1, True), (2, False)]
    got = spark.createDataFrame([("a\nb", "a\nc", "s1"), ("a", "a", "s"), (None, "x", None)], "a string, b string, n string").select(history.unified_diff("a", "b", "n").alias("d")).collect()
    assert got[0].d.splitlines() == ["--- s1", "+++ current", "@@ -1,2 +1,2 @@", " a", "-b", "+c"]
    assert got[1].d is None and got[2].d is None


def test_url_resolution(spark):
    rows = [("http://h/a/b", "../c#f", "http://h/c"), ("http://h/a", "mailto:x@y", "mailto:x@y"), ("http://h", "http://[bad", None), (None, "x", "x")]
    got = spark.createDataFrame([r[:2] for r in rows], "b string, h string").select(urls.resolve("b", "h").alias("u")).collect()
    assert [r.u for r in got] == [r[2] for r in rows]


def test_retry_dates(spark):
    rows = spark.createDataFrame([("Wed, 21 Oct 2015 07:28:10 GMT", 0), (None, 3), ("7", 0), ("-7", 0), ("soon", 9)], "h string, n int")
    got = rows.select(values.retry_delay(F.col("h"), F.lit("2015-10-21 07:28:00").cast("timestamp"), F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [10.0, 8.0, 7.0, 0.0, 30.0]


def test_breadth_first_stops_and_dedupes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 2), (3, 4), (9, 8)], "src int, dst int")
    got = crawl.breadth_first(edges, spark.createDataFrame([(1,), (1,)], "node int"), 10)
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_budget_counts_queue_order(spark):
    tasks = spark.createDataFrame([("c", i) for i in range(5)], "collection_id string, seq int")
    assert [r.in_budget for r in crawl.within_budget(tasks, F.lit(3)).orderBy("seq").collect()] == [True] * 3 + [False] * 2


def test_captured_files(spark, tmp_path):
    for name, body in {"a.json": "[1]", "b.json": "[2]", "c.xml": "x" * 50}.items():
        (tmp_path / name).write_text(body)
    spark.dataSource.register(CapturedPayloads)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("captured").option("path", str(tmp_path)).option("max_bytes", "10").load()
    assert sorted(map(tuple, df.collect())) == [("a.json", "[1]", "utf-8", None), ("b.json", "[2]", "utf-8", None), ("c.xml", None, None, "RESPONSE_TOO_LARGE")]
    assert [r.body for r in df.where("name = 'b.json'").collect()] == ["[2]"]


def test_health_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "source_id string, seq long, outcome string, error string"
    for i, rows in enumerate([[("s", 1, "ok", None), ("t", 1, "blocked", "E1")], [("s", 2, "running", None), ("t", 2, "cancelled", None)], [("s", 3, "cancelled", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = health_updates(spark.readStream.schema(schema).json(str(source)))
        out = {}
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _, out=out: out.update({r.source_id: (r.status, r.error) for r in df.collect()})).trigger(availableNow=True).start()
        q.awaitTermination()
        want = [{"s": ("ok", None), "t": ("blocked", "E1")}, {"s": ("running", None), "t": ("blocked", "E1")}, {"s": ("ok", None)}][i]
        assert out == want


def test_windowed_counts(spark, tmp_path):
    source = tmp_path / "ev"
    spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b"), ("2024-01-01 01:00:00", "b")], "ts string, k string").write.json(str(source))
    stream = spark.readStream.schema("ts timestamp, k string").json(str(source))
    q = event_counts(stream, "ts", "1 minute", "5 minutes", "k").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


class Parsed(__import__("html.parser", fromlist=["HTMLParser"]).HTMLParser):
    """Links and text as the standard library's parser sees them."""

    def __init__(self, source):
        super().__init__()
        self.links, self.text, self.hidden = [], [], 0
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.text.append(data.strip())


def test_links_and_references_as_a_parser_reads_them(spark):
    pages = [
        "<p>caf&eacute; &#233; &#xE9; &hellip; &copy 2020 &amp;lt; &notin; &unknown; &amp &euro;</p>",
        "<a href='/single'>x</a><A HREF=/bare class=x>y</A><a class=\"b\" href = \"/spaced\">z</a>",
        "<a title=\"a > b\" href=\"/q?a=1&amp;b=2&eacute;\">q</a><a title='href=/no' href=/yes>r</a><a name=n>s</a>",
        "<script>var a = '<a href=\"/script\">';</script><!-- <a href=\"/comment\"> --><a href=\"/last\">t</a>",
        "<abbr href=/abbr>u</abbr><a data-href=/data>v</a><a\nhref=\n/line>w</a><a href=\"\">e</a>",
        "",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(99, None)], "k int, html string")
    got = {r.k: r for r in df.select("k", text.hrefs(F.col("html")).alias("links"), text.main_text(F.col("html")).alias("text")).collect()}
    for i, p in enumerate(pages):
        want = Parsed(p)
        assert got[i].links == list(dict.fromkeys(want.links)), i
        assert got[i].text.split("\n") == (want.text or [""]), i
    assert got[99].links is None and got[99].text is None


def test_oversized_files_are_named(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"x" * 11)
    (tmp_path / "b.html").write_bytes(b"x" * 10)
    spark.dataSource.register(CapturedPayloads)
    rows = spark.read.format("captured").option("path", str(tmp_path)).option("max_bytes", "10").load().orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("a.html", None, None, "RESPONSE_TOO_LARGE"), ("b.html", "x" * 10, "utf-8", None)]


def plain_branches(starts, territories, hits, observed, max_depth):
    """The loop, query by query."""
    level, seen, visited = starts, {c: [] for c in territories}, {(c, u) for c, _, _, u, _, _ in starts}
    tasks = []
    for depth in range(1, max_depth + 1):
        found = {}
        for c in territories:
            turn = []
            for task in sorted({t for x, t, *_ in level if x == c}):
                taken = 0
                for _, _, _, _, kind, title in sorted((r for r in level if r[:2] == (c, task)), key=lambda r: r[2]):
                    label = title and " ".join(title.replace('"', "").split()).strip(" .,-")
                    if kind == "archive_capture_index" or not label or not 3 <= len(label) <= 120 or label.lower() == territories[c].lower():
                        continue
                    for form in planning.BRANCHES["en"]:
                        q = form.replace("%1", label).replace("%2", territories[c])
                        if q not in seen[c] and taken < planning.PER_EXPANSION and len(seen[c]) < planning.PER_COLLECTION:
                            seen[c].append(q)
                            turn.append(q)
                            taken += 1
            for n, q in enumerate(turn):
                for _, rank, url in (h for h in hits if h[0] == q):
                    if (c, url) not in visited:
                        found[c, url] = min(found.get((c, url), (n, rank, url, q)), (n, rank, url, q))
        level = []
        for c in territories:
            for p, (_, _, url, q) in enumerate(sorted(v for (x, _), v in found.items() if x == c)):
                tasks.append((c, depth, p, url, q))
                visited.add((c, url))
                level += [(c, p, seq, url, kind, title) for u, seq, kind, title in observed if u == url]
    return tasks, seen


def test_historical_loop(spark):
    """Branches over several levels, with the limits of an expansion and of a collection, repeats and unusable labels."""
    import random

    rng = random.Random(3)
    names = ["Old Mill", "Town Hall", "old mill", "x", "Bridge - ", '"Quay"', "Ghost", "Hill"]
    observed = [(f"u{i}", s, rng.choice(["web_page", "archive_capture_index", "web_page"]), rng.choice([*names, None])) for i in range(30) for s in range(rng.randint(1, 3))]
    territories = {"c1": "Ghost", "c2": "Elsewhere"}
    starts = [(c, t, s, f"u{t}", k, n) for c in territories for t in range(3) for u, s, k, n in observed if u == f"u{t}"]
    labels = ["Old Mill", "old mill", "Town Hall", "Bridge", "Quay", "Hill"]
    hits = list({(f.replace("%1", x).replace("%2", t), r, f"u{rng.randint(0, 29)}") for x in labels for t in territories.values() for f in planning.BRANCHES["en"] for r in range(2)})
    made = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    tasks, queries = branching.historical_branches(
        made(starts, "collection_id string, task_seq long, seq long, url string, source_kind string, title string"),
        made([(c, t, "en") for c, t in territories.items()], "collection_id string, territory string, language string"),
        made(hits, "query string, rank int, url string"),
        made(observed, "url string, seq long, source_kind string, title string"),
        max_depth=3,
    )
    want, seen = plain_branches(starts, territories, hits, observed, 3)
    assert sorted(map(tuple, tasks.collect())) == sorted(want) and len(want) > 6
    got = queries.collect()
    assert all(sorted(q.query for q in got if q.collection_id == c) == sorted(seen[c]) and len(seen[c]) <= planning.PER_COLLECTION for c in territories)


def test_iteration_state_survives_a_restart(spark, tmp_path):
    tasks = spark.createDataFrame([("c", f"k{i}", f"u{i}") for i in range(6)], "collection_id string, task_key string, url string")
    done = tasks.where("url < 'u2'")
    turns = Turns(spark, str(tmp_path))
    assert branching.restored(turns) is None
    branching.checkpoint_tables(tasks, done.limit(0), turns, 1)
    branching.checkpoint_tables(tasks, done, turns, 2)
    branching.checkpoint_tables(tasks, done, turns, 2)  # written again after a lost driver
    turns.write(3, "visited", done)  # a turn that was never marked
    pending, visited = branching.restored(Turns(spark, str(tmp_path)))
    assert sorted(r.url for r in pending.collect()) == ["u2", "u3", "u4", "u5"] and visited.count() == 2


def test_diffs_leave_in_small_slices():
    import pyarrow as pa

    before = [f"a\n{i}" if i % 5 else None for i in range(1000)]
    after = [f"a\n{i + i % 2}" for i in range(1000)]
    parts = list(history.unified_diff.func(iter([tuple(pa.array(x, pa.string()) for x in (before, after, ["s"] * 1000))])))
    assert max(map(len, parts)) <= 64
    got = [d for part in parts for d in part.to_pylist()]
    assert len(got) == 1000 and [i for i, d in enumerate(got) if d] == [i for i in range(1000) if i % 5 and i % 2]
    assert got[1].splitlines() == ["--- s", "+++ current", "@@ -1,2 +1,2 @@", " a", "-1", "+2"]
