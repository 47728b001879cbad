"""Log records and agent actions as JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import redact

# Fields that a log record may have beside its time, severity, logger and message.
FIELDS = ["event", "collection_id", "analysis_id", "consumer", "source_id", "stage", "status", "error_code"]


def log_records(events: DataFrame) -> DataFrame:
    """Rows (record): JSON of redacted log events. Of further columns only those in FIELDS are written, and only where they are
    not null. Input: timestamp, severity, logger, message, and any others."""
    extra = [F.transform(F.array(F.col(f).cast("string")), lambda x: redact(x, 500))[0].alias(f) for f in FIELDS if f in events.columns]
    return events.select(F.to_json(F.struct("timestamp", "severity", "logger", redact(F.col("message"), 2000).alias("message"), *extra)).alias("record"))


def action_json(action: Column) -> Column:
    """An agent's action, a struct or map of any nesting, as JSON with all its fields, nulls included."""
    return F.to_json(action, {"ignoreNullFields": "false"})


def json_safe(df: DataFrame, name: str) -> DataFrame:
    """Column `name` of any type as JSON text: numbers, texts and flags as they are, nested values whole, others as text."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return df.withColumn(name, action_json(F.col(name)))
    plain = isinstance(kind, (T.NumericType, T.BooleanType))
    text = F.col(name).cast("string")
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return df.withColumn(name, F.coalesce(text if plain else F.when(text.isNotNull(), quoted), F.lit("null")))
