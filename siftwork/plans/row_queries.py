"""Queries over documents, events and orders: redaction, dedupe, chains, merges, folds, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text, values
from ..operators import dedupe, health, history, planning, status, store
from ..sources import places
from .registry import query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_redacted(t):
    """Redaction in SQL, for lower-case http(s) URLs with a host and without a user part."""
    t = rf"""regexp_replace(regexp_replace({t}, '(?i)\bbearer[ \t\n\r\f\v]+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'),
      '(?i)\b(token|api[_-]?key|password|passwd|secret|authorization|access[_-]?token)([ \t\n\r\f\v]*[:=][ \t\n\r\f\v]*)([^ \t\n\r\f\v,;]+)', '\1\2[REDACTED]', 'g')"""
    t = rf"""regexp_replace({t}, '(https?://[^?# \t\n\r\f\v"''<>]+)([?#][^ \t\n\r\f\v"''<>]*)?', '\1', 'g')"""
    return f"CASE WHEN length({t}) > 1000 THEN substr({t}, 1, 1000) || '…' ELSE {t} END"


@query(
    "redacted_documents",
    f"SELECT doc_id, {sql_redacted('text')} AS redacted FROM documents",
)
def redacted_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query("redacted_page_log", f"""SELECT page_id, {sql_redacted("'GET ' || url || ', password=' || page_id || '; moved to <' || url || '>' || html")} AS message FROM pages""")
def redacted_page_log(spark, sf_dir):
    message = F.concat(F.lit("GET "), "url", F.lit(", password="), "page_id", F.lit("; moved to <"), "url", F.lit(">"), "html")
    return table(spark, sf_dir, "pages").select("page_id", text.redact(message).alias("message"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.sha256(F.col("text")).alias("content_hash"))


@query("text_hash_dedupe", "SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) GROUP BY 1")
def text_hash_dedupe(spark, sf_dir):
    return content_hashes(spark, sf_dir).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("first_seen_documents", "SELECT doc_id, source, h FROM (SELECT doc_id, source, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_seen_documents(spark, sf_dir):
    return dedupe.first_seen(table(spark, sf_dir, "documents").select("doc_id", "source", ids.sha256(F.col("text")).alias("h")), ["h"], ["doc_id"])


@query("latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_user(spark, sf_dir):
    return dedupe.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "snapshot_chain",
    """SELECT source_url, snapshot_id, content_hash, lag(snapshot_id) OVER w AS previous_snapshot_id, lag(content_hash) OVER w <> content_hash AS changed
    FROM (SELECT source AS source_url, doc_id AS snapshot_id, sha256(text) AS content_hash FROM documents) WINDOW w AS (PARTITION BY source_url ORDER BY snapshot_id)""",
)
def snapshot_chain(spark, sf_dir):
    captures = table(spark, sf_dir, "documents").select(F.col("source").alias("source_url"), F.col("doc_id").alias("snapshot_id"), "text")
    return history.snapshot_chain(captures, order=("snapshot_id",), content="text").drop("text")


@query("unified_diff")
def unified_diff(spark, sf_dir):
    captures = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    both = history.with_previous_content(captures, "source", "doc_id", "text")
    return both.select("doc_id", history.unified_diff(F.col("before"), F.col("text"), F.col("before_id").cast("string")).alias("diff"))


@query(
    "keyed_upsert",
    """SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY user_id""",
)
def keyed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    return store.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["user_id"], "seq").select("user_id", "event_type", "seq")


@query("update_existing", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'updated' ELSE c_mktsegment END AS state FROM customer")
def update_existing(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("state", F.lit("updated"))
    return store.update_existing(base, changes, "c_custkey")


@query("insert_new", "SELECT c_custkey FROM customer UNION SELECT o_custkey + 1000000 FROM orders")
def insert_new(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey")
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1000000).alias("c_custkey")).distinct()
    return store.insert_new(base, new.unionAll(base), "c_custkey")


@query("topk_per_source", "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def topk_per_source(spark, sf_dir):
    return dedupe.first_n(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.col("n_chars").desc(), "doc_id"], 3)


@query("rank_hits", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents")
def rank_hits(spark, sf_dir):
    return dedupe.ranked(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])


@query(
    "first_success_provider",
    """WITH hits AS (SELECT user_id AS search, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS provider_rank, event_id FROM events WHERE value > 50)
    SELECT h.search, h.provider_rank, h.event_id FROM hits h JOIN (SELECT search, min(provider_rank) AS best FROM hits GROUP BY 1) b ON h.search = b.search AND h.provider_rank = b.best""",
)
def first_success_provider(spark, sf_dir):
    rank = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    hits = table(spark, sf_dir, "events").where("value > 50").select(F.col("user_id").alias("search"), rank.alias("provider_rank"), "event_id")
    return dedupe.first_success(hits, "search", "provider_rank")


@query(
    "merge_tasks",
    """SELECT task_key, side, seq FROM (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY side, seq) AS k FROM (
      SELECT 'page:' || (event_id % 700) AS task_key, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS side, event_id AS seq FROM events)) WHERE k = 1""",
)
def merge_tasks(spark, sf_dir):
    key = dedupe.task_key(F.lit(""), F.lit("page"), (F.col("event_id") % 700).cast("string"))
    rows = table(spark, sf_dir, "events").select(key.alias("task_key"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("side"), F.col("event_id").alias("seq"))
    return dedupe.merge_tasks(rows.where("side = 0"), rows.where("side = 1"), ["task_key"])


_OUTCOME = """CASE event_type WHEN 'error' THEN 'degraded' WHEN 'purchase' THEN 'blocked' WHEN 'signup' THEN 'cancelled' ELSE 'ok' END"""


def _attempts(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "error", "degraded").when(F.col("event_type") == "purchase", "blocked").when(F.col("event_type") == "signup", "cancelled").otherwise("ok")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("source_id"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.concat(F.lit("E"), F.col("event_id") % 7).alias("error"))


@query(
    "source_health",
    f"""WITH a AS (SELECT user_id % 97 AS source_id, event_id AS seq, {_OUTCOME} AS outcome, 'E' || (event_id % 7) AS error FROM events),
    s AS (SELECT source_id, arg_max(outcome, seq) AS stable, arg_max(error, seq) AS error FROM a WHERE outcome IN ('ok', 'degraded', 'blocked') GROUP BY 1)
    SELECT n.source_id, coalesce(stable, 'ready') AS status, CASE WHEN stable <> 'ok' THEN error END AS error, attempts FROM (SELECT source_id, count(*) AS attempts FROM a GROUP BY 1) n LEFT JOIN s ON n.source_id = s.source_id""",
)
def source_health(spark, sf_dir):
    return health.source_health(_attempts(spark, sf_dir))


@query(
    "recipe_failures",
    """WITH r AS (SELECT user_id % 211 AS recipe_id, event_id AS seq, event_type <> 'error' AS success FROM events), l AS (SELECT recipe_id, max(CASE WHEN success THEN seq END) AS last_success FROM r GROUP BY 1)
    SELECT r.recipe_id, CAST(sum(CASE WHEN NOT success AND seq > coalesce(last_success, -1) THEN 1 ELSE 0 END) AS BIGINT) AS failures, max(last_success) AS last_success FROM r JOIN l ON r.recipe_id = l.recipe_id GROUP BY 1""",
)
def recipe_failures(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select((F.col("user_id") % 211).alias("recipe_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))
    return health.recipe_failures(runs)


def _outcomes(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", F.array(F.lit("SOURCE_ERROR"))).when(F.col("event_type") == "signup", F.array(F.lit("DISCOVERY_BLOCKED"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("collection_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("source_id"),
        F.when(F.col("value") > 20, 1).otherwise(0).cast("long").alias("observations"),
        (F.col("event_type") == "signup").alias("blocked"),
        ((F.col("event_type") == "click") & (F.col("value") > 90)).alias("partial"),
        code.alias("error_codes"),
    )


_SQL_OUTCOMES = """o AS (SELECT user_id AS collection_id, event_id AS seq, event_type AS source_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS observations, event_type = 'signup' AS blocked,
  event_type = 'click' AND value > 90 AS partial, CASE event_type WHEN 'error' THEN 'SOURCE_ERROR' WHEN 'signup' THEN 'DISCOVERY_BLOCKED' END AS code FROM events)"""


@query(
    "coverage_status",
    f"WITH {_SQL_OUTCOMES} SELECT collection_id, seq, source_id, CASE WHEN blocked THEN 'blocked' WHEN partial THEN 'partial' WHEN code IS NOT NULL AND observations = 0 THEN 'error' ELSE 'ok' END AS status, CAST(observations AS BIGINT) AS observations, code AS error_code FROM o",
)
def coverage_status(spark, sf_dir):
    return status.coverage(_outcomes(spark, sf_dir))


@query(
    "collection_status",
    f"""WITH {_SQL_OUTCOMES}, f AS (SELECT collection_id, CAST(sum(observations) AS BIGINT) AS observations, bool_or(blocked) AS blk, bool_or(NOT blocked AND partial) AS part, bool_or(coalesce(code, '') = 'SOURCE_ERROR') AS err FROM o GROUP BY 1),
    s AS (SELECT *, CASE WHEN observations > 0 AND (blk OR part OR err) THEN 'partial' WHEN observations = 0 AND blk AND NOT err THEN 'blocked' WHEN observations = 0 AND (part OR err) THEN 'failed' ELSE 'completed' END AS status FROM f)
    SELECT collection_id, status, status = 'partial' AS is_partial, observations FROM s""",
)
def collection_status(spark, sf_dir):
    return status.collection_status(_outcomes(spark, sf_dir))


@query(
    "discovery_outcome",
    """WITH p AS (SELECT user_id AS search, event_id AS rank, event_type = 'signup' AS blocked, event_type = 'error' AS failed, CASE WHEN value > 99 THEN 1 ELSE 0 END AS n FROM events),
    f AS (SELECT search, CAST(sum(n) AS BIGINT) AS n_tasks, bool_or(blocked) AS blocked, coalesce(string_agg(CASE WHEN blocked THEN 'DISCOVERY_BLOCKED' WHEN failed THEN 'DISCOVERY_ERROR' END, ',' ORDER BY rank), '') AS own FROM p GROUP BY 1)
    SELECT search, n_tasks, CASE WHEN n_tasks = 0 AND blocked THEN own || CASE WHEN own = '' THEN '' ELSE ',' END || 'DISCOVERY_INCOMPLETE' WHEN n_tasks = 0 AND own = '' THEN 'DISCOVERY_NO_RESULTS' ELSE own END AS codes FROM f""",
)
def discovery_outcome(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("search"), F.col("event_id").alias("rank"), (F.col("event_type") == "signup").alias("blocked"), (F.col("event_type") == "error").alias("failed"), F.when(F.col("value") > 99, 1).otherwise(0).cast("long").alias("n_tasks")
    )
    return status.discovery_outcome(p)


@query(
    "startup_and_progress",
    """SELECT o_orderkey, CAST(least(99, floor(100 * (o_orderkey % 40) / 30.0)) AS INTEGER) AS progress, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'O' THEN 'blocked' ELSE 'failed' END END AS startup,
      CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'partial' ELSE 'failed' END AS failure, CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'cancelled' END AS after_cancel FROM orders""",
)
def startup_and_progress(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        status.progress(k % 40, F.lit(30.0)).alias("progress"),
        status.startup_outcome(k % 5, k % 3, F.col("o_orderstatus") == "O").alias("startup"),
        status.failure_outcome(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000).alias("failure"),
        store.cancelled(F.when(F.col("o_orderstatus") == "P", "partial").otherwise("running")).alias("after_cancel"),
    )


@query(
    "result_bundle",
    """SELECT c_custkey AS collection_id, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_custkey = c_custkey), '') AS observations,
      coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), '') AS evidence FROM customer""",
)
def result_bundle(spark, sf_dir):
    collections = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collection_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").cast("string").alias("observation_id"), F.col("o_orderkey").cast("string").alias("evidence_id"), "o_orderstatus")
    out = store.result_bundle(collections, orders, orders.where("o_orderstatus = 'F'"))
    return out.select("collection_id", F.array_join("observations", ",").alias("observations"), F.array_join("evidence", ",").alias("evidence"))


@query("recoverable", "SELECT o_orderkey AS collection_id, 'queued' AS status, CASE WHEN o_orderstatus = 'O' THEN 'recovered' ELSE 'new' END AS stage FROM orders WHERE o_orderstatus IN ('O', 'P')")
def recoverable(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("completed")
    return store.recovered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("collection_id"), state.alias("status"), F.lit("new").alias("stage")))


@query(
    "latest_recipes",
    """SELECT domain, goal, max(version) AS version, max(version) + 1 AS next_version FROM (SELECT 'd' || (o_custkey % 50) AS domain, o_orderpriority AS goal, CAST(o_orderkey % 9 AS INTEGER) AS version FROM orders) GROUP BY 1, 2""",
)
def latest_recipes(spark, sf_dir):
    recipes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("recipe_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("d"), F.col("o_custkey") % 50).alias("domain"), F.col("o_orderpriority").alias("goal"), (F.col("o_orderkey") % 9).cast("int").alias("version")
    )
    saved = store.save_recipes(recipes.where("seq % 2 = 0"), recipes.where("seq % 2 = 1"))
    newest = dedupe.latest(saved, ["domain", "goal"], ["version"])
    return newest.select("domain", "goal", "version").join(health.next_version(saved).withColumnRenamed("version", "next_version"), ["domain", "goal"])


@query(
    "uncovered_intents",
    """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN '' ELSE
      concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN '1-URGENT' END, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') THEN '5-LOW' END) END AS uncovered FROM customer""",
)
def uncovered_intents(spark, sf_dir):
    covers = F.when(F.col("o_orderstatus") == "P", "*").otherwise(F.col("o_orderpriority"))
    covered = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(covers).alias("a"), F.collect_set("o_orderpriority").alias("b"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(covered, "c_custkey", "left")
    all_covered = F.concat(F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>")))
    return joined.select("c_custkey", F.array_join(planning.uncovered_intents(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), all_covered), ",").alias("uncovered"))


_EN = " UNION ALL ".join(f"SELECT '{i}' AS intent, {j} AS j, '{t}' AS term" for i, ts in planning.TERMS["en"].items() for j, t in enumerate(ts))


@query(
    "planner_queries",
    f"""WITH t AS ({_EN} UNION ALL SELECT 'open_days', 0, 'open days'), i(i, intent) AS (VALUES (0, 'reviews'), (1, 'public_mentions'), (2, 'historical_context'), (3, 'open_days'), (4, 'reviews')),
    q AS (SELECT n_nationkey AS request_id, i, j, trim('"' || n_name || '" ' || term) AS query FROM nation CROSS JOIN i JOIN t ON i.intent = t.intent),
    f AS (SELECT request_id, query, min(i * 100 + j) AS place FROM q GROUP BY 1, 2)
    SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY place) AS seq, query FROM f""",
)
def planner_queries(spark, sf_dir):
    intents = F.array(*map(F.lit, ("reviews", "public_mentions", "historical_context", "open_days", "reviews")))
    territory = planning.territory_text(F.col("n_name"), F.lit(None), F.lit(None), F.lit(None))
    requests = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request_id"), territory.alias("territory"), planning.language_of(F.lit(None), territory).alias("language"), intents.alias("intents"))
    return planning.plan_queries(requests)


@query(
    "branch_queries",
    """WITH l AS (SELECT c_nationkey AS collection_id, c_custkey AS seq, trim(replace(c_name, '#', ' ')) AS entity FROM customer),
    f AS (SELECT collection_id, min_by(entity, seq) AS entity, min(seq) AS seq FROM l GROUP BY collection_id, lower(entity)),
    b(j, a, z) AS (VALUES (0, ' history ', 1), (1, ' former name ', 1), (2, ' construction reconstruction demolition', 0)),
    q AS (SELECT collection_id, seq, j, '"' || entity || '"' || a || CASE WHEN z = 1 THEN '"Nation ' || collection_id || '"' ELSE '' END AS query FROM f CROSS JOIN b)
    SELECT collection_id, n AS seq, query FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY seq, j) AS n FROM q) WHERE n <= 3""",
)
def branch_queries(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("collection_id"), F.col("c_custkey").alias("seq"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("label"), F.concat(F.lit("Nation "), "c_nationkey").alias("territory"), F.lit("en").alias("language"))
    return planning.branch_queries(labels, spark.createDataFrame([], "collection_id int, query string"))


@query(
    "radius_places",
    """WITH p AS (SELECT s_suppkey, s_name, (s_suppkey % 1800) / 10.0 - 90 AS lat, (s_suppkey * 7 % 3600) / 10.0 - 180 AS lon FROM supplier),
    d AS (SELECT s_suppkey, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(-85.0)) / 2), 2) + cos(radians(-85.0)) * cos(radians(lat)) * pow(sin(radians(lon - -150.0) / 2), 2)))) AS meters FROM p)
    SELECT s_suppkey AS place_id, CAST(round(meters) AS BIGINT) AS meters FROM d WHERE meters <= 600000""",
)
def radius_places(spark, sf_dir):
    k = F.col("s_suppkey")
    found = table(spark, sf_dir, "supplier").select(k.alias("place_id"), F.col("s_name").alias("name"), ((k % 1800) / 10.0 - 90).alias("latitude"), ((k * 7 % 3600) / 10.0 - 180).alias("longitude"))
    return places.within_radius(found, -85.0, -150.0, 600_000).select("place_id", F.round("meters").cast("long").alias("meters"))


@query(
    "canonical_json_hash",
    """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","note":null,"size":' || p_size || '}') AS facts_hash FROM part""",
)
def canonical_json_hash(spark, sf_dir):
    facts = values.canonical_json(name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size"), note=F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", ids.sha256(facts).alias("facts_hash"))


@query(
    "retry_delays",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN least(30.0, greatest(0.0, CAST(o_orderkey % 50 - 5 AS DOUBLE))) ELSE least(30.0, 1.0 * pow(2, o_orderkey % 8)) END AS seconds FROM orders""",
)
def retry_delays(spark, sf_dir):
    k = F.col("o_orderkey")
    header = F.when(k % 3 == 0, (k % 50 - 5).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.retry_delay(header, F.lit("2024-01-01 00:00:00").cast("timestamp"), k % 8).alias("seconds"))
