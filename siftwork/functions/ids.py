"""Stable identifiers: name-based UUIDs (version 5) from native SHA-1, and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of this engine's identifiers.
NAMESPACE = "8c5b2f0e4d7a4e0b9f31c6a7d2e81b54"
SEPARATOR = "\x1f"


def sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes; null stays null."""
    return F.sha2(text.cast("binary"), 256)


def uuid5(payload: Column) -> Column:
    """Version-5 UUID of the payload in NAMESPACE."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), payload.cast("binary")))
    ninth = F.conv(F.substring(h, 17, 2), 16, 10).cast("int")
    variant = F.lower(F.hex(ninth.bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def stable_id(kind: str, *parts: Column) -> Column:
    """UUID of the kind and the parts in order; a null part keeps its slot as an empty string."""
    slots = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return uuid5(F.concat_ws(SEPARATOR, F.lit(kind), *slots))


def observation_id(collection_id: Column, source_id: Column, entity_type: Column, entity_id: Column, source_url: Column, content_hash: Column) -> Column:
    return stable_id("observation", collection_id, source_id, entity_type, entity_id, source_url, content_hash)


def evidence_id(observation: Column, evidence_type: Column, source_url: Column, text: Column) -> Column:
    return stable_id("evidence", observation, evidence_type, source_url, sha256(text))
