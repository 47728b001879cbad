"""Choice of sources and providers, coverage of intents, limits, and point look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def sources_for(requests: DataFrame, sources: DataFrame, request: str = "request") -> DataFrame:
    """Rows (request, source_id): sources that answer one of a request's intents, or all ("*").

    Requests: request, wanted; sources: source_id, intents. An equi-join on single intents, so neither side
    need be small: each request also asks for "*".
    """
    asked = requests.select(request, F.explode(F.array_distinct(F.concat("wanted", F.array(F.lit("*"))))).alias("intent")).where(F.size("wanted") > 0)
    offered = sources.select("source_id", F.explode(F.array_distinct("intents")).alias("intent"))
    return asked.join(offered, "intent").select(request, "source_id").distinct()


def covered_intents(requests: DataFrame, tasks: DataFrame, sources: DataFrame, request: str = "request") -> DataFrame:
    """Rows (request, covered, uncovered): a source covers the requested intents that it answers, or all if it answers "*",
    as soon as it has given a task. Input: request, wanted; request, source_id of tasks; source_id, intents."""
    gave = tasks.select(request, "source_id").distinct().join(sources, "source_id").groupBy(request).agg(F.array_distinct(F.flatten(F.collect_set("intents"))).alias("offered"))
    both = requests.join(gave, request, "left").withColumn("offered", F.coalesce("offered", F.array().cast("array<string>")))
    wanted = F.array_distinct("wanted")
    covered = F.when(F.array_contains("offered", "*"), wanted).otherwise(F.array_intersect("wanted", "offered"))
    return both.select(request, F.array_sort(covered).alias("covered"), F.array_except(wanted, covered).alias("uncovered"))


def scoped(pages: DataFrame, rules: DataFrame, scope: str, url: str = "url") -> DataFrame:
    """The pages with allowed and rule, the domain that decided (null: none did), by a table of rules.

    rules: the scope column, domain, denied; pages: the scope column and a URL. A rule fits its domain and all below it.
    Denied domains win over allowed ones, the longest of a kind decides; without a fitting rule a page is allowed if its
    scope allows no domain by name. A URL without a host is never allowed, null scopes match null scopes. Each different
    host of a scope is looked up once, by its parent domains in an equi-join, so neither side need be small, and pages find
    their host's verdict afterwards.
    """
    named = pages.withColumn("_scope", F.coalesce(F.col(scope).cast("string"), F.lit("\0"))).withColumn("_host", F.coalesce(urls.host(F.col(url)), F.lit("")))
    given = rules.select(F.coalesce(F.col(scope).cast("string"), F.lit("\0")).alias("_scope"), F.lower("domain").alias("_domain"), F.coalesce("denied", F.lit(False)).alias("_denied"))
    hosts = named.select("_scope", "_host").distinct()
    each = hosts.withColumn("_domain", F.explode(urls.suffixes(F.col("_host")))).join(given, ["_scope", "_domain"])
    longest = lambda kind: F.max_by(F.when(kind, F.col("_domain")), F.when(kind, F.length("_domain")))
    fits = each.groupBy("_scope", "_host").agg(longest(F.col("_denied")).alias("_no"), longest(~F.col("_denied")).alias("_yes"))
    strict = given.groupBy("_scope").agg(F.bool_or(~F.col("_denied")).alias("_strict"))
    known = hosts.join(fits, ["_scope", "_host"], "left").join(strict, "_scope", "left")
    allowed = (F.col("_host") != "") & F.col("_no").isNull() & (F.col("_yes").isNotNull() | ~F.coalesce("_strict", F.lit(False)))
    judged = known.select("_scope", "_host", allowed.alias("allowed"), F.coalesce("_no", "_yes").alias("rule"))
    return named.join(judged, ["_scope", "_host"]).drop("_scope", "_host")


def listed(sources: DataFrame) -> DataFrame:
    """Sources with their intents sorted."""
    return sources.select("source_id", F.array_sort("intents").alias("intents"))


ABILITIES = ("text_search", "category_search", "nearby")


def capable(requests: DataFrame, providers: DataFrame, text: Column, categories: Column, radius: Column) -> DataFrame:
    """Requests with each provider that can do all that they need: a text, categories, a radius. Providers: text_search,
    category_search, nearby beside their own columns.

    What a request needs is a number of three bits; a provider answers every number whose bits it has, so both meet in an
    equi-join. Nulls need nothing and can do nothing; a request that nobody can serve gives no row.
    """
    bits = lambda flags: sum((F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    asked = requests.withColumn("_needs", bits([text != "", F.size(categories) > 0, radius > 0]))
    able = providers.withColumn("_can", bits([F.col(a) for a in ABILITIES])).withColumn("_needs", F.explode(F.sequence(F.lit(0), F.lit((1 << len(ABILITIES)) - 1))))
    return asked.join(able.where(F.col("_can").bitwiseAND(F.col("_needs")) == F.col("_needs")).drop("_can"), "_needs").drop("_needs")


def first_queries(queries: Column, most: int = 8) -> Column:
    """The first queries that are not blank, as many as a search may have."""
    return F.slice(F.filter(queries, lambda q: F.btrim(q) != ""), 1, most)


def too_soon(log: DataFrame, provider: str, at: str, order: list[str], seconds: float) -> DataFrame:
    """The log with too_soon: the request began less than `seconds` after its provider's one before."""
    start = F.col(at).cast("double")
    gap = start - F.lag(start).over(Window.partitionBy(provider).orderBy(at, *order))
    return log.withColumn("too_soon", F.coalesce(gap < seconds, F.lit(False)))


def within_cap(body: Column, most: int = 5 << 20) -> Column:
    """Does a response keep to the size limit, in bytes?"""
    return F.octet_length(body) <= most


def lookup(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys; keys that the table lacks give none."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def lineage(evidence: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """Evidence with the columns of its observation; evidence without one is left out."""
    return evidence.join(observations, key)
