"""Search results: JSON hits, HTML result pages, tasks with archive companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

HITS = "struct<results: array<struct<url: string, title: string, engines: array<string>, engine: string>>>"


def json_hits(payloads: DataFrame, per_query: int = 10) -> DataFrame:
    """The first results of each query, http(s) only, each URL once per search, rank by place in its query.
    Input: search, query_seq, payload."""
    each = payloads.select("search", "query_seq", F.posexplode(F.from_json("payload", HITS)["results"]).alias("pos", "r")).where(F.col("pos") < per_query)
    rows = each.select("search", "query_seq", "pos", "r.url", "r.title", F.coalesce("r.engines", F.when(F.col("r.engine").isNotNull(), F.array("r.engine")), F.array().cast("array<string>")).alias("engines")).where(urls.is_http(F.col("url")))
    first = rows.groupBy("search", "url").agg(F.min_by(F.struct("query_seq", "pos", "title", "engines"), F.struct("query_seq", "pos")).alias("h"))
    return first.select("search", "url", "h.query_seq", (F.col("h.pos") + 1).alias("rank"), "h.title", "h.engines")


def result_target(href: Column, engine_host: str = "duckduckgo.com") -> Column:
    """The wrapped target of a search engine's own link, another http(s) URL itself, else null."""
    u = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    own = (urls.host(u) == engine_host) | urls.host(u).endswith(f".{engine_host}")
    raw = F.nullif(F.regexp_extract(u, r"[?&]uddg=([^&#]*)", 1), F.lit(""))
    target = F.try_url_decode(raw)
    return F.when(own, F.when(urls.is_http(target), target)).when(urls.is_http(u), u)


QUERY_CHARS = 499  # that a search page takes


def page_query(query: Column) -> Column:
    """A query as a search page takes it; null if it is blank."""
    return F.nullif(F.substring(F.btrim(query), 1, QUERY_CHARS), F.lit(""))


def unblocked(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits of providers none of whose result pages of the search was a challenge; one blocked page discards all of its
    provider's hits. hits: search, provider, ...; pages: search, provider, html."""
    blocked = pages.where(text.search_blocked(F.col("html"))).select("search", "provider").distinct()
    return hits.join(blocked, ["search", "provider"], "left_anti")


def page_hits(pages: DataFrame, per_query: int = 5) -> DataFrame:
    """Targets of a result page's links in order, each once, no more than per_query; none from a challenge page.
    Input: search, html."""
    open_ = pages.where(~text.search_blocked(F.col("html")))
    each = open_.select("search", F.posexplode(text.hrefs(F.col("html"))).alias("pos", "href")).withColumn("url", result_target(F.col("href"))).where("url is not null")
    first = each.groupBy("search", "url").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("search").orderBy("pos"))).where(F.col("rank") <= per_query).select("search", "rank", "url")


def tasks(hits: DataFrame, archive: Column) -> DataFrame:
    """A page task for each hit, and an archive task where `archive` holds. Input: search, rank, url."""
    page = F.struct(F.lit("generic_web").alias("source_id"), F.concat(F.lit("generic_web:"), "url").alias("task_key"))
    companion = F.struct(F.lit("wayback_cdx").alias("source_id"), F.concat(F.lit("wayback_cdx:"), "url").alias("task_key"))
    return hits.select("search", "rank", "url", F.explode(F.when(archive, F.array(page, companion)).otherwise(F.array(page))).alias("t")).select("search", "rank", "url", "t.*")
