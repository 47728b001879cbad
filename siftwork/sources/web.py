"""Web pages: seeds to tasks, tiered attempts, links, feed discovery, observations and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text, urls

OBSERVATION_CHARS, EVIDENCE_CHARS = 100_000, 10_000
FEED_TYPES = r"(?i)application/(rss|atom)\+xml"


def seed_tasks(requests: DataFrame) -> DataFrame:
    """One task per seed URL; goal is the first intent. Input: collection_id, intents, seed_urls."""
    return requests.select("collection_id", F.get("intents", F.lit(0)).alias("goal"), F.posexplode("seed_urls").alias("seq", "url")).select("collection_id", "seq", F.lit("generic_web").alias("source_id"), "goal", "url", F.lit(0).alias("depth"))


def accepted_attempt(attempts: DataFrame) -> DataFrame:
    """The cheapest usable attempt of each task. Input: task, tier (0 recipe, 1 fast, 2 browser, 3 agent), status, text, failed, unsafe.
    An unsafe URL ends a task; failed, blocked and script-only pages go on to the next tier, except that the
    last tier's blocked page is taken."""
    blocked = text.looks_blocked(F.col("text"), F.col("status"))
    state = attempts.withColumn("blocked", blocked).withColumn("usable", ~F.col("failed") & ~F.col("unsafe") & ~blocked & ~((F.col("tier") == 1) & text.needs_browser(F.col("text"))))
    folds = state.groupBy("task").agg(
        F.bool_or("unsafe").alias("unsafe"),
        F.min(F.when(F.col("usable"), F.col("tier"))).alias("usable"),
        F.max(F.when(F.col("blocked") & ~F.col("failed"), F.col("tier"))).alias("blocked"),
    )
    return folds.select("task", F.when(F.col("unsafe"), None).otherwise(F.coalesce("usable", "blocked")).alias("tier"), F.when(F.col("unsafe"), "unsafe").when(F.col("usable").isNotNull(), "ok").when(F.col("blocked").isNotNull(), "blocked").otherwise("failed").alias("outcome"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html", every: bool = True) -> DataFrame:
    """Rows (url, seq, link): absolute http(s) targets without fragments, first seen once per page. Captures of one URL are one
    page: a link's place is the least that it has in any of them, repeats of other links counted; of links with one place the
    smaller comes first. `every`: as for unescape()."""
    each = pages.select(F.col(url).alias("url"), F.posexplode(text.hrefs(F.col(html), repeats=True, every=every)).alias("pos", "href"))
    absolute = each.withColumn("link", urls.resolve(F.col("url"), F.col("href"))).where(urls.is_http(F.col("link")))
    firsts = absolute.groupBy("url", "link").agg(F.min("pos").alias("pos"))
    return firsts.withColumn("seq", F.row_number().over(Window.partitionBy("url").orderBy("pos", "link"))).select("url", "seq", "link")


BROWSER_LINKS = 1000


def browser_links(links: Column) -> Column:
    """The links of a page as a browser lists them: the first BROWSER_LINKS, repeats included."""
    return F.slice(links, 1, BROWSER_LINKS)


def landed(attempts: DataFrame, most: int = 5 << 20) -> DataFrame:
    """Fetched pages with their error, if they have one: UNSAFE_URL for an unsafe final URL, RESPONSE_TOO_LARGE for a body or an
    announced length beyond `most` bytes. Such rows lose their text. Input: url, final_url, text, content_length, links."""
    final = F.coalesce("final_url", "url")
    large = (F.octet_length("text") > most) | (F.coalesce(text.content_length(F.col("content_length")), F.lit(0)) > most)
    error = F.when(urls.unsafe_redirect(F.col("url"), final), "UNSAFE_URL").when(F.coalesce(large, F.lit(False)), "RESPONSE_TOO_LARGE")
    out = attempts.withColumn("final_url", final).withColumn("error", error)
    return out.withColumn("text", F.when(F.col("error").isNull(), F.col("text"))).withColumn("links", browser_links(F.col("links")))


def agent_candidates(runs: DataFrame) -> DataFrame:
    """Rows (task, turn, url): pages that an agent visited, the last first, without the task's own URL. Input: task, url, visited."""
    each = runs.select("task", F.col("url").alias("_own"), F.posexplode(F.reverse("visited")).alias("p", "url")).where("url <> _own")
    return each.withColumn("turn", F.row_number().over(Window.partitionBy("task").orderBy("p"))).select("task", "turn", "url")


def feed_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (url, link) of alternate RSS and Atom links, in any quoting; those in comments and scripts are none."""
    is_feed = lambda tag: tag.rlike(r"(?i)[\s\"']rel\s*=\s*(?:\"[^\"]*\balternate\b|'[^']*\balternate\b|alternate[\s/>])") & tag.rlike(FEED_TYPES)
    each = pages.select(F.col(url).alias("url"), F.explode(text.hrefs(F.col(html), "link", is_feed)).alias("href"))
    return each.select("url", urls.resolve(F.col("url"), F.col("href")).alias("link")).where(urls.is_http(F.col("link"))).distinct()


def observations(pages: DataFrame, collection_id: Column, url: str = "url", html: str = "html", every: bool = True) -> DataFrame:
    """One observation per page: the hash is of the whole text, the stored text is cut, ids are stable. `every`: as for unescape()."""
    bare = pages.select(F.col(url).alias("source_url"), text.stripped(F.col(html)).alias("bare"), text.raw_title(F.col(html)).alias("head"), collection_id.alias("collection_id"))
    # a select of its own, so that the regular expressions over the page run once
    main = bare.select("source_url", "collection_id", text.lines_of(F.col("bare"), every).alias("full"), text.clean_title(F.col("head"), every).alias("title"))
    hashed = main.withColumn("content_hash", ids.sha256(F.col("full")))
    return hashed.select(
        ids.observation_id(F.col("collection_id"), F.lit("generic_web"), F.lit("document"), F.lit(None), F.col("source_url"), F.col("content_hash")).alias("observation_id"),
        "collection_id",
        F.lit("generic_web").alias("source_id"),
        F.lit("web_page").alias("source_kind"),
        F.lit("document").alias("entity_type"),
        "source_url",
        urls.host(F.col("source_url")).alias("host"),
        "title",
        F.substring("full", 1, OBSERVATION_CHARS).alias("text"),
        "content_hash",
    )


def evidence(observed: DataFrame) -> DataFrame:
    cut = F.substring("text", 1, EVIDENCE_CHARS)
    return observed.select(ids.evidence_id(F.col("observation_id"), F.lit("document"), F.col("source_url"), cut).alias("evidence_id"), "observation_id", "collection_id", F.lit("document").alias("type"), "source_url", cut.alias("text"))
