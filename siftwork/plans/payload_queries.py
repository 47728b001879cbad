"""Queries over captured payloads: each row of a table becomes a payload, and the source operators decode it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls, values
from ..operators import crawl, planning, recipes
from ..sources import archive, feeds, places, search, web
from .registry import query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(column):
    return F.col(column).cast("string")


def _two(number):
    """A number of two digits."""
    return F.lpad(number.cast("string"), 2, "0")


def _by(number, *cases):
    """One case for each remainder of a number."""
    out = F
    for i, case in enumerate(cases[:-1]):
        out = out.when(number % len(cases) == i, case)
    return out.otherwise(cases[-1])


def _captures(spark, sf_dir):
    """Each page as an archive's index of four rows (one again, one no web address), every other one with its columns in
    reverse; of ten pages one has no rows and one no JSON."""
    i = F.col("page_id")
    at = F.concat(F.lit("20200102"), _two(i % 24), _two(i % 60), F.lit("05"))
    lit = F.lit
    rows = [
        list(map(lit, ("timestamp", "original", "mimetype", "statuscode", "digest", "length"))),
        [at, F.col("url"), lit("text/html"), (200 + i % 5).cast("string"), F.concat(lit("D"), _id("page_id")), _id("page_id")],
        [at, F.col("url"), lit("text/plain"), lit("200"), lit("AAA"), lit("1")],
        [lit("2021"), F.concat("url", lit("#b")), lit(""), lit("oops"), lit(""), lit("-")],
        [at, F.concat(lit("ftp://x/"), _id("page_id")), lit("text/html"), lit("200"), lit("BBB"), lit("5")],
    ]
    whole = F.when(i % 2 == 0, F.array(*[F.array(*r) for r in rows])).otherwise(F.array(*[F.array(*reversed(r)) for r in rows]))
    payload = F.when(i % 10 == 9, "no json").when(i % 10 == 8, F.to_json(F.slice(whole, 1, 1))).otherwise(F.to_json(whole))
    return archive.captures(_table(spark, sf_dir, "pages").select(F.concat(lit("p"), _id("page_id")).alias("url"), payload.alias("payload")), limit=5)


_SQL_CAPTURES = """WITH c AS (SELECT page_id, 'p' || page_id AS url, '20200102' || lpad(CAST(page_id % 24 AS VARCHAR), 2, '0') || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || '05' AS ts, url AS o FROM pages WHERE page_id % 10 < 8),
  found AS (SELECT url, 1 AS rank, ts AS timestamp, strftime(strptime(ts, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS captured_at, o AS original, 'text/html' AS mimetype, 200 + page_id % 5 AS status, 'D' || page_id AS digest, page_id AS length FROM c
    UNION ALL SELECT url, 2, '2021', NULL, o || '#b', NULL, NULL, NULL, NULL FROM c)"""


@query("cdx_decode", _SQL_CAPTURES + " SELECT *, 'https://web.archive.org/web/' || timestamp || 'id_/' || original AS capture_url FROM found")
def cdx_decode(spark, sf_dir):
    return _captures(spark, sf_dir).withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"))


@query("archive_page_tasks", _SQL_CAPTURES + " SELECT url, rank, 'generic_web:wayback:' || timestamp || ':' || original AS task_key, 'https://web.archive.org/web/' || timestamp || 'id_/' || original AS task_url FROM found")
def archive_page_tasks(spark, sf_dir):
    return archive.page_tasks(_captures(spark, sf_dir))


@query(
    "archive_observations",
    _SQL_CAPTURES
    + """ SELECT timestamp || ':' || original AS entity_id, sha256('{"digest":' || coalesce('"' || digest || '"', 'null') || ',"length":' || coalesce(CAST(length AS VARCHAR), 'null') || ',"mimetype":' || coalesce('"' || mimetype || '"', 'null')
      || ',"original":"' || original || '","status":' || coalesce(CAST(status AS VARCHAR), 'null') || ',"timestamp":"' || timestamp || '"}') AS content_hash FROM found""",
)
def archive_observations(spark, sf_dir):
    return archive.observations(_captures(spark, sf_dir), F.lit("run-1")).select("entity_id", "content_hash")


@query(
    "provider_outcomes",
    "SELECT o_orderkey, status, CASE WHEN status IN (403, 429) THEN 'ARCHIVE_PROVIDER_BLOCKED' WHEN status < 200 OR status >= 300 THEN 'ARCHIVE_PROVIDER_ERROR' END AS code FROM (SELECT o_orderkey, 100 + o_orderkey % 500 AS status FROM orders)",
)
def provider_outcomes(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (100 + F.col("o_orderkey") % 500).alias("status"))
    return rows.select("o_orderkey", "status", archive.provider_outcome(F.col("status")).alias("code"))


def _entries(spark, sf_dir):
    """Of four pages two are RSS feeds of two items, one is an Atom feed, and one is broken."""
    i, key = F.col("page_id"), _id("page_id")
    seconds = _two(i % 60)
    rss = F.concat(
        F.lit('<rss version="2.0"><channel><title>Feed</title><item><title>T'), key, F.lit("</title><link>http://n.example/"), key, F.lit("</link><description>D &amp; "), key, F.lit("</description><guid>g"), key,
        F.lit("</guid><pubDate>Tue, 02 Jan 2024 03:04:"), seconds, F.lit(" GMT</pubDate></item><item><title>  </title><link>http://n.example/b/"), key, F.lit("</link><pubDate>2024-05-06T07:08:"), seconds, F.lit("Z</pubDate></item></channel></rss>"),
    )
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A'), key, F.lit("</title><id>x"), key, F.lit('</id><link href="http://n.example/a/'), key, F.lit('"/><summary>Sum</summary><updated>2024-02-03T04:05:'), seconds, F.lit("+02:00</updated></entry></feed>"))
    payload = _by(i, rss, rss, atom, F.lit("<rss><oops>"))
    return feeds.entries(_table(spark, sf_dir, "pages").select(F.concat(F.lit("http://n.example/f"), key).alias("feed_url"), payload.alias("payload")))


@query(
    "feed_decode",
    """WITH p AS (SELECT page_id AS i, 'http://n.example/f' || page_id AS feed_url, lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') AS s FROM pages)
    SELECT feed_url, 0 AS seq, 'T' || i AS title, 'http://n.example/' || i AS link, 'D & ' || i AS description, 'g' || i AS guid, '2024-01-02 03:04:' || s AS published_at FROM p WHERE i % 4 < 2
    UNION ALL SELECT feed_url, 1, NULL, 'http://n.example/b/' || i, NULL, NULL, '2024-05-06 07:08:' || s FROM p WHERE i % 4 < 2
    UNION ALL SELECT feed_url, 0, 'A' || i, 'http://n.example/a/' || i, 'Sum', 'x' || i, '2024-02-03 02:05:' || s FROM p WHERE i % 4 = 2""",
)
def feed_decode(spark, sf_dir):
    return _entries(spark, sf_dir).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "feed_observations",
    """SELECT 'http://n.example/' || page_id AS source_url, sha256('T' || page_id || chr(10) || 'D & ' || page_id) AS content_hash FROM pages WHERE page_id % 4 < 2
    UNION ALL SELECT 'http://n.example/b/' || page_id, sha256('') FROM pages WHERE page_id % 4 < 2 UNION ALL SELECT 'http://n.example/a/' || page_id, sha256('A' || page_id || chr(10) || 'Sum') FROM pages WHERE page_id % 4 = 2""",
)
def feed_observations(spark, sf_dir):
    return feeds.observations(_entries(spark, sf_dir), F.lit("run-1")).select("source_url", "content_hash")


@query("feed_seeds", r"SELECT page_id, regexp_matches(lower(url || CASE page_id % 4 WHEN 0 THEN '/x.RSS' WHEN 1 THEN '/x.xml?y' WHEN 2 THEN '/f.atom' ELSE '' END), '\.(rss|xml|atom)$') AS is_feed FROM pages")
def feed_seeds(spark, sf_dir):
    url = F.concat("url", _by(F.col("page_id"), F.lit("/x.RSS"), F.lit("/x.xml?y"), F.lit("/f.atom"), F.lit("")))
    return _table(spark, sf_dir, "pages").select("page_id", feeds.is_feed_url(url).alias("is_feed"))


@query(
    "feed_links",
    """SELECT 'http://n.example/p/' || page_id AS url, 'http://n.example/f.rss?a=1&b=' || page_id AS link FROM pages UNION ALL SELECT 'http://n.example/p/' || page_id, 'http://o.example/' || page_id || '.atom' FROM pages
    UNION ALL SELECT 'http://n.example/p/' || page_id, 'http://n.example/p/' || page_id || '.rss' FROM pages WHERE page_id % 2 = 0""",
)
def feed_links(spark, sf_dir):
    """Each page with a head of its own: references, spaces around "=", no quotes, a comment and a script, other links."""
    key = _id("page_id")
    head = F.concat(
        F.lit('<head><link rel="alternate" type="application/rss+xml" href="/f.rss?a=1&amp;b='), key, F.lit("#x\"><link type = 'application/atom+xml' REL = 'home alternate' href = 'http://o.example/"), key, F.lit(".atom'>"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<link rel=alternate type=application/rss+xml href="), key, F.lit(".rss>"))).otherwise(F.lit('<link rel="alternate" type="text/html" href="/other">')),
        F.lit('<!-- <link rel="alternate" type="application/rss+xml" href="/no"> --><script>"<link rel=\'alternate\' type=\'application/rss+xml\' href=\'/no\'>"</script><link rel="alternate" type="application/feed+json" href="/j"><link rel="stylesheet" href="/c.css"></head>'),
    )
    rows = _table(spark, sf_dir, "pages").select(F.concat(F.lit("http://n.example/p/"), key).alias("url"), F.concat(head, "html").alias("html"))
    return web.feed_links(rows)


def _places(spark, sf_dir):
    """Each customer as an answer of a map: two places, one without a name, one off the globe, one of another kind."""
    k = F.col("c_custkey")
    key = _id("c_custkey")
    lat, lon, none = (k % 180 - 90 + F.lit(0.5)), (k % 360 - 180 + F.lit(0.25)), F.lit(None).cast("double")

    def element(kind, at, tags, centre=False):
        point = F.struct((at[0] if centre else none).alias("lat"), (at[1] if centre else none).alias("lon"))
        pairs = [x for name, value in tags.items() for x in (F.lit(name), value if not isinstance(value, str) else F.lit(value))]
        return F.struct(F.lit(kind).alias("type"), k.alias("id"), (none if centre else at[0]).cast("double").alias("lat"), (none if centre else at[1]).cast("double").alias("lon"), F.when(F.lit(centre), point).alias("center"), F.create_map(*pairs).alias("tags"))

    elements = F.array(
        element("node", (lat, lon), {"name": F.concat(F.lit(" "), "c_name", F.lit(" ")), "amenity": "school", "addr:city": "K", "addr:street": "Main", "addr:housenumber": key}),
        element("way", (lat, lon), {"brand": F.col("c_name"), "shop": "supermarket", "office": "x", "addr:full": F.concat(F.lit("Full "), key)}, centre=True),
        element("node", (lat, lon), {"amenity": "cafe"}),
        element("relation", (F.lit(95.0), lon), {"operator": F.concat(F.lit("Op "), key)}),
        element("area", (lat, lon), {"name": "No"}),
    )
    payload = F.to_json(F.struct(elements.alias("elements")))
    return places.decode_elements(_table(spark, sf_dir, "customer").select(key.alias("request_id"), payload.alias("payload")))


_SQL_PLACES = """WITH p AS (SELECT c_custkey AS k, c_name AS n, c_custkey % 180 - 90 + 0.5::DOUBLE AS lat, c_custkey % 360 - 180 + 0.25::DOUBLE AS lon FROM customer),
  f AS (SELECT 'node/' || k AS place_id, n AS name, 'K, Main ' || k AS address, lat AS latitude, lon AS longitude, 'amenity:school' AS categories FROM p UNION ALL SELECT 'way/' || k, n, 'Full ' || k, lat, lon, 'shop:supermarket;office:x' FROM p
    UNION ALL SELECT 'relation/' || k, 'Op ' || k, NULL, NULL, NULL, '' FROM p)"""


@query("poi_decode", _SQL_PLACES + " SELECT * FROM f")
def poi_decode(spark, sf_dir):
    return _places(spark, sf_dir).select("place_id", "name", "address", "latitude", "longitude", F.array_join("categories", ";").alias("categories"))


@query(
    "poi_observations",
    _SQL_PLACES
    + """ SELECT place_id, name || coalesce(chr(10) || address, '') || coalesce(chr(10) || 'Coordinates: ' || printf('%.6f', latitude) || ', ' || printf('%.6f', longitude), '') || CASE WHEN categories = '' THEN '' ELSE chr(10) || 'Categories: ' || replace(categories, ';', ', ') END AS text,
      sha256('{"address":' || coalesce('"' || address || '"', 'null') || ',"categories":[' || CASE categories WHEN '' THEN '' WHEN 'amenity:school' THEN '"amenity:school"' ELSE '"office:x","shop:supermarket"' END || '],"latitude":' || coalesce(CAST(latitude AS VARCHAR), 'null')
        || ',"longitude":' || coalesce(CAST(longitude AS VARCHAR), 'null') || ',"name":"' || name || '","place_id":"' || place_id || '"}') AS content_hash FROM f""",
)
def poi_observations(spark, sf_dir):
    return places.place_observations(_places(spark, sf_dir), F.lit("run-1")).select("place_id", "text", "content_hash")


@query(
    "category_tasks",
    """SELECT o_orderkey AS collection_id, v.seq, v.category, 'openstreetmap_overpass:' || v.category AS task_key FROM orders
    JOIN (VALUES (0, 0, 'cafe'), (0, 1, 'park'), (2, 0, 'cafe'), (2, 1, 'mall'), (2, 2, 'school')) v(k, seq, category) ON o_orderkey % 4 = v.k""",
)
def category_tasks(spark, sf_dir):
    wanted = [F.array(*map(F.lit, x)) for x in (["park", "cafe"], ["reviews"], ["school", "mall", "cafe", "school", "news"])]
    intents = _by(F.col("o_orderkey"), *wanted, F.array().cast("array<string>"))
    return places.category_tasks(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("collection_id"), intents.alias("intents")))


def _geocodes(spark, sf_dir):
    """Each supplier as an answer of a geocoder with two good candidates and a bad one between; every fifth has none."""
    k, key = F.col("s_suppkey"), _id("s_suppkey")
    candidate = lambda name, lat, lon, kind, osm: F.struct(k.alias("place_id"), F.lit(kind).alias("osm_type"), F.lit(osm).cast("bigint").alias("osm_id") if osm is None else osm.alias("osm_id"), lat.cast("string").alias("lat"), lon.cast("string").alias("lon"), name.alias("display_name"))
    found = F.array(
        candidate(F.concat(F.lit("Town "), key), k % 180 - 90 + F.lit(0.5), k % 360 - 180 + F.lit(0.25), "way", k),
        candidate(F.lit("Bad"), F.lit("x"), F.lit("1"), None, None),
        candidate(F.concat(F.lit("Town b/é "), key), F.lit("1.5"), F.lit("2.5"), None, None),
    )
    return places.decode_geocodes(_table(spark, sf_dir, "supplier").select(key.alias("request_id"), F.when(k % 5 == 4, "[]").otherwise(F.to_json(found)).alias("payload")))


@query(
    "geocode_decode",
    """SELECT CAST(s_suppkey AS VARCHAR) AS request_id, 1 AS rank, 'Town ' || s_suppkey AS display_name, s_suppkey % 180 - 90 + 0.5::DOUBLE AS latitude, s_suppkey % 360 - 180 + 0.25::DOUBLE AS longitude, 'https://www.openstreetmap.org/way/' || s_suppkey AS source_url FROM supplier WHERE s_suppkey % 5 < 4
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 2, 'Town b/é ' || s_suppkey, 1.5, 2.5, 'https://nominatim.openstreetmap.org/ui/search.html?q=Town+b%2F%C3%A9+' || s_suppkey FROM supplier WHERE s_suppkey % 5 < 4""",
)
def geocode_decode(spark, sf_dir):
    return _geocodes(spark, sf_dir)


@query(
    "geocode_resolution",
    """SELECT CAST(k AS VARCHAR) AS request_id, CASE WHEN k % 4 = 2 THEN 1.0::DOUBLE WHEN k % 4 < 2 AND k % 5 < 4 THEN k % 180 - 90 + 0.5::DOUBLE END AS latitude, CASE WHEN k % 4 = 2 THEN k % 100 + 0.5::DOUBLE WHEN k % 4 < 2 AND k % 5 < 4 THEN k % 360 - 180 + 0.25::DOUBLE END AS longitude,
      1000 AS radius, CASE WHEN k % 4 = 2 THEN NULL WHEN k % 4 = 3 THEN 'GEOCODING_QUERY_REQUIRED' WHEN k % 5 = 4 THEN 'GEOCODING_NO_RESULTS' END AS code FROM (SELECT s_suppkey AS k FROM supplier)""",
)
def geocode_resolution(spark, sf_dir):
    k = F.col("s_suppkey")
    own = k % 4 == 2
    rows = _table(spark, sf_dir, "supplier").select(_id("s_suppkey").alias("request_id"), _by(k, F.col("s_name"), F.lit(None), F.lit(None), F.lit(" ")).alias("address"), F.when(k % 4 == 1, F.col("s_name")).alias("city"), F.when(own, 1.0).alias("latitude"), F.when(own, k % 100 + F.lit(0.5)).alias("longitude"))
    return places.with_points(rows, _geocodes(spark, sf_dir))


@query(
    "search_hits",
    """SELECT c_custkey AS search, 'http://a.example/' || c_custkey AS url, 0 AS query_seq, 1 AS rank, c_name AS title, 'x,y' AS engines FROM customer UNION ALL SELECT c_custkey, 'http://a.example/two', 0, 3, 'A2', 'z' FROM customer UNION ALL SELECT c_custkey, 'https://b.example/' || c_custkey, 1, 2, c_mktsegment, '' FROM customer""",
)
def search_hits(spark, sf_dir):
    """Two queries of each customer; of three results each one is a repeat or no web page."""
    key, none = _id("c_custkey"), F.lit(None).cast("string")
    hit = lambda url, title, engines=None, engine=none: F.struct(url.alias("url"), title.alias("title"), (F.array(*map(F.lit, engines)) if engines else F.lit(None).cast("array<string>")).alias("engines"), engine.alias("engine"))
    pages = F.array(
        F.array(hit(F.concat(F.lit("http://a.example/"), key), F.col("c_name"), ["x", "y"]), hit(F.lit("ftp://no"), F.lit("F")), hit(F.lit("http://a.example/two"), F.lit("A2"), engine=F.lit("z")), hit(F.lit("http://a.example/late"), F.lit("L"))),
        F.array(hit(F.lit("http://a.example/two"), F.lit("again")), hit(F.concat(F.lit("https://b.example/"), key), F.col("c_mktsegment"))),
    )
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("search"), F.posexplode(pages).alias("query_seq", "results"))
    return search.json_hits(rows.select("search", "query_seq", F.to_json(F.struct("results")).alias("payload")), per_query=3).withColumn("engines", F.array_join("engines", ","))


@query(
    "serp_unwrap",
    "SELECT page_id AS search, 1 AS rank, 'https://t.example/' || page_id || '?a=1' AS url FROM pages WHERE page_id % 7 > 0 UNION ALL SELECT page_id, 2, 'http://o.example/' || page_id FROM pages WHERE page_id % 7 > 0",
)
def serp_unwrap(spark, sf_dir):
    """Each page as a result page of a search engine; every seventh is a challenge."""
    key = _id("page_id")
    html = F.concat(
        F.lit('<a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Ft.example%2F'), key, F.lit('%3Fa%3D1&amp;rut=9">t</a><a href="/settings">s</a><a href="https://duckduckgo.com/about">d</a><a href="http://o.example/'), key,
        F.lit('">o</a><a href="http://o.example/'), key, F.lit('">o</a><a href="http://p.example/">p</a>'), F.when(F.col("page_id") % 7 == 0, "<p>Please complete the following challenge</p>").otherwise(""),
    )
    return search.page_hits(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("search"), html.alias("html")), per_query=2)


@query(
    "search_tasks",
    "SELECT page_id % 10 AS search, page_id AS rank, url, 'generic_web' AS source_id, 'generic_web:' || url AS task_key FROM pages UNION ALL SELECT page_id % 10, page_id, url, 'wayback_cdx', 'wayback_cdx:' || url FROM pages WHERE page_id % 10 < 3",
)
def search_tasks(spark, sf_dir):
    hits = _table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("search"), F.col("page_id").alias("rank"), "url")
    return search.tasks(hits, F.col("search") < 3)


@query(
    "seed_tasks",
    "SELECT c_custkey AS collection_id, CAST(s AS INT) AS seq, 'generic_web' AS source_id, c_mktsegment AS goal, 'http://' || c_name || '/' || s AS url, 0 AS depth FROM customer, range(0, 3) r(s) WHERE s < c_custkey % 4",
)
def seed_tasks(spark, sf_dir):
    """Customers as requests of up to three seed URLs."""
    seeds = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (F.col("c_custkey") % 4).cast("int")), lambda s: F.concat(F.lit("http://"), "c_name", F.lit("/"), s.cast("string")))
    return web.seed_tasks(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collection_id"), F.array("c_mktsegment", F.lit("x")).alias("intents"), seeds.alias("seed_urls")))


@query(
    "accepted_attempts",
    """WITH a AS (SELECT user_id AS task, event_id % 4 AS tier, event_type = 'signup' AS failed, event_id % 61 = 0 AS unsafe, event_type = 'error' OR event_id % 7 = 3 AS blocked, event_type = 'click' AS script FROM events),
    f AS (SELECT task, bool_or(unsafe) AS unsafe, min(CASE WHEN NOT failed AND NOT unsafe AND NOT blocked AND NOT (tier = 1 AND script) THEN tier END) AS usable, max(CASE WHEN blocked AND NOT failed THEN tier END) AS blocked FROM a GROUP BY task)
    SELECT task, CASE WHEN unsafe THEN NULL ELSE coalesce(usable, blocked) END AS tier, CASE WHEN unsafe THEN 'unsafe' WHEN usable IS NOT NULL THEN 'ok' WHEN blocked IS NOT NULL THEN 'blocked' ELSE 'failed' END AS outcome FROM f""",
)
def accepted_attempts(spark, sf_dir):
    """Events of a user as attempts at one page, in four tiers."""
    kind, i = F.col("event_type"), F.col("event_id")
    shown = F.when(kind == "error", "Access DENIED").when(kind == "click", "Enable JavaScript").otherwise("fine")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), (i % 4).alias("tier"), F.when(i % 7 == 3, 403).otherwise(200).alias("status"), shown.alias("text"), (kind == "signup").alias("failed"), (i % 61 == 0).alias("unsafe"))
    return web.accepted_attempt(rows)


@query(
    "compiled_recipes",
    r"""WITH s AS (SELECT user_id, event_id, event_type = 'error' AND user_id % 3 = 0 AS bad, CASE event_type WHEN 'view' THEN '{"action":"goto","value":"http://x/' || event_id || '"}' WHEN 'click' THEN '{"action":"click","selector":"[id=\"q\\\"' || event_id || '\"]"}'
      WHEN 'purchase' THEN '{"action":"fill","selector":"[data-testid=\"t' || event_id || '\"]","value":"' || event_id || '"}' ELSE '{"action":"click","selector":"xpath=/html/' || event_id || '"}' END AS step FROM events WHERE event_type <> 'signup')
    SELECT user_id AS run, CASE WHEN NOT bool_or(bad) THEN '[' || string_agg(step, ',' ORDER BY event_id) || ']' END AS steps, bool_or(bad) AS rejected FROM s GROUP BY 1""",
)
def compiled_recipes(spark, sf_dir):
    """Events of a user as an agent's actions; an error is an element without attributes, or of every third user an unknown action."""
    kind, key = F.col("event_type"), _id("event_id")
    action = F.when(kind == "view", "go_to_url").when(kind == "click", "click_element").when(kind == "purchase", "input_text").when(kind == "signup", "done").when(F.col("user_id") % 3 == 0, "fly").otherwise("click")
    value = F.when(kind == "view", F.concat(F.lit("http://x/"), key)).when(kind == "purchase", key)
    attributes = F.when(kind == "click", F.create_map(F.lit("id"), F.concat(F.lit('q"'), key))).when(kind == "purchase", F.create_map(F.lit("name"), F.lit("n"), F.lit("data-testid"), F.concat(F.lit("t"), key))).otherwise(F.create_map(F.lit("class"), F.lit("z")))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), action.alias("action"), value.alias("value"), attributes.alias("attributes"), F.when(kind == "error", F.concat(F.lit("/html/"), key)).alias("x_path"))
    return recipes.compile_actions(rows)


@query(
    "response_headers",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'iso-8859-' || p_size WHEN 1 THEN 'utf-8' ELSE 'koi8-r' END AS charset, CASE p_partkey % 4 WHEN 0 THEN p_size * 100 WHEN 1 THEN 0 END AS length,
      CASE p_partkey % 4 WHEN 0 THEN least(greatest(p_size * 100, 1), 1000) WHEN 1 THEN 1 END AS bounded FROM part""",
)
def response_headers(spark, sf_dir):
    size = F.col("p_size").cast("string")
    kind = _by(F.col("p_partkey"), F.concat(F.lit('text/html; charset="ISO-8859-'), size, F.lit('"')), F.lit(None), F.lit("a; b=c; CharSet = koi8-R"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", kind.alias("content_type"), _by(F.col("p_partkey"), F.concat(F.lit(" "), size, F.lit("00 ")), F.lit("-5"), F.lit("x"), F.lit(None)).alias("n"))
    return rows.select("p_partkey", text.charset(F.col("content_type")).alias("charset"), text.content_length(F.col("n")).alias("length"), text.bounded_int(F.btrim("n"), 1, 1000).alias("bounded"))


@query(
    "territories",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ', Main ' || c_custkey WHEN 1 THEN 'At ' || lower(c_mktsegment) || ' ' || c_custkey WHEN 2 THEN printf('%.6f', c_custkey % 90 + 0.5) || ', ' || printf('%.6f', 30.25) WHEN 3 THEN 'Киев ' || c_custkey ELSE 'location' END AS territory,
      CASE WHEN c_custkey % 7 = 0 THEN 'ru' WHEN c_custkey % 7 = 1 THEN 'en' WHEN c_custkey % 5 = 3 THEN 'ru' ELSE 'en' END AS language FROM customer""",
)
def territories(spark, sf_dir):
    k, key = F.col("c_custkey"), _id("c_custkey")
    city = _by(k, F.col("c_mktsegment"), F.col("c_mktsegment"), F.lit(None), F.concat(F.lit("Киев "), key), F.lit(" "))
    address = _by(k, F.concat(F.lit(" Main "), key), F.concat(F.lit("At "), F.lower("c_mktsegment"), F.lit(" "), key), F.lit(""), F.lit(None), F.lit(None))
    point = F.when(k % 5 == 2, k % 90 + F.lit(0.5)), F.when(k % 5 == 2, F.lit(30.25))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", planning.territory_text(city, address, *point).alias("territory"), F.when(k % 7 == 0, "RU").when(k % 7 == 1, "en-GB").when(k % 7 == 2, "fr").alias("explicit"))
    return rows.select("c_custkey", "territory", planning.language_of(F.col("explicit"), F.col("territory")).alias("language"))


@query(
    "redacted_diagnostics",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Authorization: [REDACTED] [REDACTED] ' || event_type WHEN 1 THEN 'token=[REDACTED], api_key: [REDACTED]; ' || event_id WHEN 2 THEN 'see https://host' || user_id || '.example:81/a now' ELSE 'plain ' || event_type END AS redacted FROM events""",
)
def redacted_diagnostics(spark, sf_dir):
    i, key, user = F.col("event_id"), _id("event_id"), _id("user_id")
    shown = _by(
        i,
        F.concat(F.lit("Authorization: Bearer abc.def-"), key, F.lit(" "), "event_type"),
        F.concat(F.lit("token=s3cret"), key, F.lit(", api_key: k"), user, F.lit("; "), key),
        F.concat(F.lit("see https://u:p"), key, F.lit("@Host"), user, F.lit(".example:81/a?q="), key, F.lit("#f now")),
        F.concat(F.lit("plain "), "event_type"),
    )
    return _table(spark, sf_dir, "events").select("event_id", text.redact(shown).alias("redacted"))


@query(
    "crawl_children",
    """SELECT page_id AS collection_id, 1 AS seq, 'http://s.example/f' || page_id || '.rss' AS url, page_id % 3 AS depth FROM pages WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 2, 'http://s.example/p' || page_id, page_id % 3 + 1 FROM pages WHERE page_id % 3 < 2""",
)
def crawl_children(spark, sf_dir):
    """Pages as fetched tasks of depth 0 to 2, with a feed on every second, a link in scope, one out of it, and one beyond the cap."""
    key = _id("page_id")
    own = F.concat(F.lit("http://s.example/"), key)
    rows = _table(spark, sf_dir, "pages").select("page_id", own.alias("url"), (F.col("page_id") % 3).cast("int").alias("depth"))
    link = lambda seq, to, feed: F.struct(F.lit(seq).alias("seq"), to.alias("link"), F.lit(feed).alias("is_feed"))
    every = F.array(link(2, F.concat(F.lit("http://s.example/p"), key), False), link(3, F.concat(F.lit("http://other.example/"), key), False), link(9, F.lit("http://s.example/late"), False))
    feed = F.when(F.col("page_id") % 2 == 0, F.array(link(1, F.concat(F.lit("http://s.example/f"), key, F.lit(".rss")), True))).otherwise(F.slice(every, 1, 0))
    links = rows.select("url", F.explode(F.concat(every, feed)).alias("l")).select("url", "l.*")
    tasks = rows.select(F.col("page_id").alias("collection_id"), "url", "depth")
    return crawl.expand_links(tasks, links, max_depth=2, max_links=5, in_scope=urls.in_crawl_scope(F.col("link"), F.lit("s.example"), [], []))


@query(
    "private_addresses",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN true WHEN 4 THEN false ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b BETWEEN 18 AND 19) END AS private
    FROM (SELECT o_orderkey, o_custkey * 7 % 256 AS a, o_orderkey * 31 % 256 AS b FROM orders)""",
)
def private_addresses(spark, sf_dir):
    """Orders as addresses: three of five IPv4, one IPv6 of a private range, one a name."""
    part = lambda x: (x % 256).cast("string")
    four = F.concat(part(F.col("o_custkey") * 7), F.lit("."), part(F.col("o_orderkey") * 31), F.lit(".1.1"))
    h = _by(F.col("o_orderkey"), four, four, four, F.concat(F.lit("[fd00::"), part(F.col("o_orderkey")), F.lit("]")), F.concat(F.lit("name"), part(F.col("o_orderkey"))))
    return _table(spark, sf_dir, "orders").select("o_orderkey", h.alias("h")).select("o_orderkey", urls.is_private_ip("h").alias("private"))


@query(
    "feed_dates",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS moment FROM events",
)
def feed_dates(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    shown = _by(F.col("event_id"), F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" +0100")), F.date_format(at, "yyyy-MM-dd"), F.lit("soon"))
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(values.feed_time(shown), "yyyy-MM-dd HH:mm:ss").alias("moment"))
