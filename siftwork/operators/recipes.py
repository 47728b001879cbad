"""Agent actions compiled to recipe steps with stable selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

SKIPPED = ["done", "extract_content"]
ACTIONS = {"go_to_url": "goto", "navigate": "goto", "click_element": "click", "click": "click", "input_text": "fill", "input": "fill", "send_keys": "press", "wait": "wait", "scroll": "scroll"}


WAIT_STATES = ["load", "domcontentloaded", "networkidle"]


def current_recipes(tasks: DataFrame, recipes: DataFrame) -> DataFrame:
    """Tasks with the newest recipe of their URL's host and goal, or null; tasks without a host keep the error NO_HOST.
    Input: url, goal; domain, goal, version, recipe_id."""
    newest = recipes.groupBy(F.col("domain").alias("_domain"), F.col("goal").alias("_goal")).agg(F.max_by("recipe_id", F.struct("version", "recipe_id")).alias("recipe_id"), F.max("version").alias("version"))
    hosted = tasks.withColumn("_domain", urls.host(F.col("url"))).withColumn("_goal", F.col("goal"))
    return hosted.join(newest, ["_domain", "_goal"], "left").withColumn("error", F.when(F.col("_domain") == "", "NO_HOST")).drop("_domain", "_goal")


def extracted_texts(texts: Column, max_items: Column, max_chars: Column) -> Column:
    """What an extract step keeps: 1 to 500 texts (100 by default) of 100 to 20000 characters (5000)."""
    items = text.bounded_int(F.coalesce(max_items, F.lit("100")), 1, 500)
    chars = text.bounded_int(F.coalesce(max_chars, F.lit("5000")), 100, 20_000)
    return F.transform(F.slice(texts, F.lit(1), items), lambda t: F.substring(t, F.lit(1), chars))


def wait_step(state: Column, timeout_ms: Column, milliseconds: Column) -> Column:
    """(state, ms, valid) of a wait step: a known load state with 250 to 60000 ms, or without a state 0 to 10000 ms."""
    s = F.nullif(F.lower(F.btrim(state)), F.lit(""))
    ms = F.when(s.isNotNull(), text.bounded_int(F.coalesce(timeout_ms, F.lit("10000")), 250, 60_000)).otherwise(text.bounded_int(F.coalesce(milliseconds, F.lit("500")), 0, 10_000))
    return F.struct(s.alias("state"), ms.alias("ms"), (F.coalesce(s.isin(WAIT_STATES), F.lit(True)) & ms.isNotNull()).alias("valid"))


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def selector(attributes: Column, x_path: Column) -> Column:
    """The first stable attribute as a CSS selector, else the x-path, else null."""
    of = lambda k: F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit(""))
    css = [F.when(of(k).isNotNull(), F.concat(F.lit(f'[{k}="'), _escaped(of(k)), F.lit('"]'))) for k in ("data-testid", "data-test", "id", "name", "aria-label")]
    return F.coalesce(*css, F.when(F.nullif(x_path, F.lit("")).isNotNull(), F.concat(F.lit("xpath="), x_path)))


def compile_actions(actions: DataFrame) -> DataFrame:
    """Per agent run: its steps in order, or null if any action is unknown or finds no element.
    Input: run, seq, action, value, attributes (map), x_path."""
    kinds = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    kept = actions.where(~F.col("action").isin(SKIPPED)).withColumn("kind", F.try_element_at(kinds, F.col("action"))).withColumn("selector", selector(F.col("attributes"), F.col("x_path")))
    bad = F.col("kind").isNull() | (F.col("kind").isin("click", "fill") & F.col("selector").isNull())
    steps = F.transform(F.sort_array(F.collect_list(F.struct("seq", "kind", "selector", "value"))), lambda s: F.struct(s["kind"].alias("action"), s["selector"].alias("selector"), s["value"].alias("value")))
    return kept.groupBy("run").agg(F.when(~F.bool_or(bad), F.to_json(steps)).alias("steps"), F.bool_or(bad).alias("rejected"))
