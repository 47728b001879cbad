"""Search queries for territories and intents, and branch queries from observed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Search terms of each intent by language.
TERMS = {
    "ru": {
        "reviews": ["отзывы", "мнения"],
        "public_mentions": ["", "упоминания"],
        "local_news": ["новости"],
        "incidents": ["происшествия", "авария пожар"],
        "discussions": ["обсуждение форум"],
        "historical_context": ["история", "что было раньше", "снос реконструкция строительство", "старый адрес документы публикации"],
    },
    "en": {
        "reviews": ["reviews", "opinions"],
        "public_mentions": ["", "mentions"],
        "local_news": ["news"],
        "incidents": ["incidents", "accident fire"],
        "discussions": ["discussion forum"],
        "historical_context": ["history", "what was here before", "demolition reconstruction construction", "old address documents publications"],
    },
}
# Branch queries around a label (%1) and a territory (%2).
BRANCHES = {
    "ru": ['"%1" история "%2"', '"%1" прежнее название "%2"', '"%1" строительство реконструкция снос'],
    "en": ['"%1" history "%2"', '"%1" former name "%2"', '"%1" construction reconstruction demolition'],
}
PER_EXPANSION, PER_COLLECTION = 3, 12


def territory_text(city: Column, address: Column, latitude: Column, longitude: Column) -> Column:
    """City and address (address alone if it holds the city), else the point, else "location"."""
    c, a = F.nullif(F.btrim(city), F.lit("")), F.nullif(F.btrim(address), F.lit(""))
    named = F.when(c.isNotNull() & a.isNotNull(), F.when(F.contains(F.lower(a), F.lower(c)), a).otherwise(F.concat_ws(", ", c, a))).otherwise(F.coalesce(a, c))
    point = F.when(latitude.isNotNull() & longitude.isNotNull(), F.format_string("%.6f, %.6f", latitude, longitude))
    return F.coalesce(named, point, F.lit("location"))


def language_of(explicit: Column, territory: Column) -> Column:
    """An explicit ru or en, else ru for Cyrillic letters, else en."""
    e = F.lower(F.coalesce(explicit, F.lit("")))
    return F.when(e.startswith("ru"), "ru").when(e.startswith("en"), "en").when(territory.rlike("[а-яёА-ЯЁ]"), "ru").otherwise("en")


def _terms(intent: Column, language: Column) -> Column:
    tables = {lang: F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) for lang, terms in TERMS.items()}
    own = F.when(language == "ru", F.try_element_at(tables["ru"], intent)).otherwise(F.try_element_at(tables["en"], intent))
    return F.coalesce(own, F.array(F.replace(intent, F.lit("_"), F.lit(" "))))


def plan_queries(requests: DataFrame) -> DataFrame:
    """Rows (request_id, seq, query): the quoted territory with each intent's terms, in order, each query once.
    Input: request_id, territory, language, intents."""
    one = requests.select("request_id", "territory", "language", F.posexplode("intents").alias("i", "intent"))
    each = one.select("request_id", "i", F.posexplode(_terms(F.col("intent"), F.col("language"))).alias("j", "term"), F.concat(F.lit('"'), "territory", F.lit('"')).alias("quoted"))
    query = F.btrim(F.concat_ws(" ", "quoted", F.nullif(F.col("term"), F.lit(""))))
    firsts = each.select("request_id", "i", "j", query.alias("query")).groupBy("request_id", "query").agg(F.min(F.struct("i", "j")).alias("at"))
    return firsts.withColumn("seq", F.row_number().over(Window.partitionBy("request_id").orderBy("at"))).select("request_id", "seq", "query")


def clean_label(label: Column) -> Column:
    """Without quotes and backslashes, white space folded, outer punctuation removed."""
    t = F.regexp_replace(F.translate(label, "\"'\\«»“”", ""), r"\s+", " ")
    return F.btrim(t, F.lit(" \t.,;:-–—|/"))


def usable_label(label: Column) -> Column:
    """3 to 120 characters, no URL, at most two slashes, a letter."""
    slashes = F.length(label) - F.length(F.replace(label, F.lit("/"), F.lit("")))
    return F.length(label).between(3, 120) & ~F.lower(label).rlike(r"^(https?://|www\.)") & (slashes <= 2) & label.rlike(r"\p{L}")


def branch_queries(labels: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (collection_id, seq, query) of new branch queries: at most PER_EXPANSION, and PER_COLLECTION with those seen.
    Input: collection_id, seq, label, territory, language; seen: collection_id, query."""
    cleaned = labels.withColumn("entity", clean_label(F.col("label"))).where(usable_label(F.col("entity")) & (F.lower("entity") != F.lower("territory")))
    firsts = cleaned.groupBy("collection_id", F.lower("entity").alias("k")).agg(F.min_by(F.struct("entity", "territory", "language", "seq"), "seq").alias("e")).select("collection_id", "e.*")
    forms = {lang: F.array(*map(F.lit, b)) for lang, b in BRANCHES.items()}
    each = firsts.select("collection_id", "seq", "entity", "territory", F.posexplode(F.when(F.col("language") == "ru", forms["ru"]).otherwise(forms["en"])).alias("j", "form"))
    query = F.replace(F.replace(F.col("form"), F.lit("%1"), F.col("entity")), F.lit("%2"), F.col("territory"))
    new = each.select("collection_id", "seq", "j", query.alias("query")).join(seen, ["collection_id", "query"], "left_anti")
    used = seen.groupBy("collection_id").agg(F.count("*").alias("used"))
    ranked = new.join(used, "collection_id", "left").withColumn("n", F.row_number().over(Window.partitionBy("collection_id").orderBy("seq", "j")))
    return ranked.where(F.col("n") <= F.least(F.lit(PER_EXPANSION), PER_COLLECTION - F.coalesce("used", F.lit(0)))).select("collection_id", F.col("n").alias("seq"), "query")


def uncovered_intents(requested: Column, covered: Column) -> Column:
    """Requested intents that no source covers, in order; "*" covers all."""
    return F.when(F.array_contains(covered, "*"), F.array().cast("array<string>")).otherwise(F.array_except(requested, covered))
