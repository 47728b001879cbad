"""RSS and Atom payloads to entries and observations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import ids, values

MOST_ENTRIES = 100
ENTRY = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "description", "guid", "date")]))


def is_feed_url(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(rss|xml|atom)$")


@pandas_udf(ENTRY)
def entries_of(payload: pd.Series) -> pd.Series:
    """Entries of a feed in order: un-namespaced items, or Atom entries if there are none. Null for malformed XML."""
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]

    def first(entry, *names):
        for name in names:
            for e in entry.iter():
                if local(e) == name and (value := "".join(e.itertext()).strip()):
                    return value
        return None

    def link(entry):
        for e in entry.iter():
            if local(e) == "link" and (value := (e.text or "").strip() or e.get("href")):
                return value
        return None

    def read(xml):
        try:
            root = ElementTree.fromstring(xml) if xml and "<!ENTITY" not in xml else None
        except ElementTree.ParseError:
            root = None
        if root is None:
            return None
        found = root.findall(".//item") or [e for e in root.iter() if local(e) == "entry"]
        return [
            {"title": first(e, "title"), "link": link(e), "description": first(e, "description", "summary", "content"), "guid": first(e, "guid", "id"), "date": first(e, "pubDate", "published", "updated")}
            for e in found[:MOST_ENTRIES]
        ]

    return payload.map(read)


def entries(payloads: DataFrame) -> DataFrame:
    """Rows (feed_url, seq, title, link, description, guid, published_at). Input: feed_url, payload."""
    each = payloads.select("feed_url", F.posexplode(entries_of("payload")).alias("seq", "e"))
    return each.select("feed_url", "seq", "e.title", "e.link", "e.description", "e.guid", values.feed_time(F.col("e.date")).alias("published_at"))


def malformed(payloads: DataFrame) -> DataFrame:
    return payloads.where(entries_of("payload").isNull()).select("feed_url")


def observations(found: DataFrame, collection_id: Column) -> DataFrame:
    body = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("description"), F.lit("")))
    out = found.withColumn("text", body).withColumn("content_hash", ids.sha256(body)).withColumn("collection_id", collection_id)
    url = F.coalesce("link", "feed_url")
    oid = ids.observation_id(F.col("collection_id"), F.lit("rss_atom"), F.lit("publication"), F.coalesce("guid", "link"), url, F.col("content_hash"))
    return out.select(oid.alias("observation_id"), F.lit("rss_atom").alias("source_id"), F.lit("feed_entry").alias("source_kind"), url.alias("source_url"), "title", "text", "content_hash", "published_at")
