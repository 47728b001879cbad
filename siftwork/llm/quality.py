"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

The sketch is a log-bucket histogram: a value x lies in bucket ceil(log(x) / log(GAMMA)), so counts of
two parts of a table simply add up, in any order, and a quantile is right within half of GAMMA - 1. It
is built by one partial aggregation (language, source, measure, bucket), so a hot source costs each task
as many rows as it has buckets. Thresholds are joined back by language and source. A group's quantiles are drawn
towards its language's by a fixed number of texts, and a language's towards the corpus's, so the fewer texts a
group has, the more its language decides, without a step at any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, blocks, mix, windows, words

GAMMA = 1.02
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in it."""
    if len(h) < 3:
        return np.zeros(n_docs, np.int64)
    w = windows(h, 3)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key = mix(w[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(h), bool)
    for i in range(3):
        hit[at[twice] + i] = True
    return np.bincount(doc[hit], minlength=n_docs)


def _dup_lines(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1, np.int64)
    raw = buf.tobytes()
    for i in range(len(off) - 1):
        text = raw[off[i] : off[i + 1]]
        if text.count(b"\n"):
            lines = text.split(b"\n")
            if len(set(lines)) < len(lines):
                lines = [x for x in lines if x.strip(b" \t\n\r\x0b\f")]
                out[i] = len(lines) - len(set(lines))
    return out


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five base counts of each text; a null has none of anything."""
    parts = []
    for _, _, buf, off in blocks(texts):
        n = len(off) - 1
        h, _, _, doc = words(buf, off, NOT_SPACE, lower=False)
        counted = lambda flags: np.add.reduceat(np.append(flags, 0).astype(np.int64), off[:-1]) * (np.diff(off) > 0)  # noqa: B023, E731
        chars = counted(NOT_SPACE[buf] & ((buf & 0xC0) != 0x80))
        parts.append([np.bincount(doc, minlength=n), chars, counted(SYMBOLS[buf]), _dup_lines(buf, off), _repeats(h, doc, n)])
    if not parts:
        return {m: np.zeros(0, np.int64) for m in MEASURES}
    return {m: np.concatenate([p[i] for p in parts]).astype(np.int64) for i, m in enumerate(MEASURES)}


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_percent are the base rule. The adaptive rule drops a text one of whose ratios lies
    above high + reach * spread, where low and high are quantiles of that ratio in its language and source, and spread is
    high - low, or that of the usual group (the median over groups, by texts) where this is more, as the texts of one group may
    be all alike.
    There is no fixed cutoff. The default quantiles stay with ordinary texts while under half of a group is junk.

    For the quantiles, each ratio is taken of `more` counts more in both its parts: a text of 60 words without
    a symbol is no proof that the group's texts have under one in 60. So groups of short texts, whose ratios
    say little, have wide limits, and groups of long texts narrow ones. The judged ratio is taken as it is."""

    min_words: int = 50
    max_repeat_percent: int = 50
    quantiles: tuple[float, float] = (0.25, 0.5)
    reach: float = 10.0
    #: ratio -> more; a repeated window has several words, so repeated words come in larger steps than symbols
    ratios: tuple[tuple[str, int], ...] = (("symbol_ratio", 2), ("dup_line_ratio", 2), ("repeat_ratio", 20), ("word_length", 0))
    #: texts of its language that a group's quantiles are mixed with, and of the corpus that a language's are
    prior: int = 20


PARTS = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}


def _ratio(name: str, more: int):
    above, below = PARTS[name]
    return (F.col(above) + more) / F.greatest(F.col(below) + more, F.lit(1))


def _bucket(x: str) -> Column:
    return F.when(F.col(x) > 0, F.ceil(F.log(x) / math.log(GAMMA)))


def sketch(df: DataFrame, groups: list[str], ratios: list[str]) -> DataFrame:
    """Mergeable sketch rows: groups, measure, bucket, n. Bucket null holds zeros."""
    long = df.select(*groups, F.explode(F.array(*[F.struct(F.lit(r).alias("measure"), F.col(r).alias("x")) for r in ratios])).alias("m")).select(*groups, "m.*")
    return long.groupBy(*groups, "measure", _bucket("x").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sk: DataFrame, groups: list[str], qs: list[float]) -> DataFrame:
    """Quantiles of each group and measure from merged sketch rows; a bucket stands for its middle."""
    w = Window.partitionBy(*groups, "measure")
    run = F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    cum = sk.withColumn("run", run).withColumn("total", F.sum("n").over(w)).withColumn("value", value)
    return cum.groupBy(*groups, "measure").agg(F.max("total").alias("n"), *[F.min(F.when(F.col("run") >= F.lit(q) * F.col("total"), F.col("value"))).alias(f"q{i}") for i, q in enumerate(qs)])


def thresholds(passing: DataFrame, rules: Rules) -> DataFrame:
    """Per lang, source and measure of rows (lang, source, counts): the highest ratio that is kept."""
    from ._spark import saved

    smoothed = passing.select("lang", "source", *[_ratio(r, more).alias(r) for r, more in rules.ratios])
    sk = saved(sketch(smoothed, ["lang", "source"], [r for r, _ in rules.ratios]), "sketch")
    levels = []
    for k, groups in enumerate((["lang", "source"], ["lang"], [])):
        merged = sk.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))
        levels.append(quantiles(merged, groups, list(rules.quantiles)).select(*groups, "measure", *[F.col(c).alias(f"{c}_{k}") for c in ("n", "q0", "q1")]))
    own, lang, corpus = levels
    lang = lang.withColumnRenamed("lang", "of_lang").withColumnRenamed("measure", "of")
    joined = own.join(lang, own.lang.eqNullSafe(lang.of_lang) & (own.measure == lang.of)).drop("of_lang", "of").join(corpus, "measure")

    def mixed(q: str) -> Column:
        towards = lambda k, above: (F.col(f"n_{k}") * F.col(f"{q}_{k}") + rules.prior * above) / (F.col(f"n_{k}") + rules.prior)
        return towards(0, towards(1, F.col(f"{q}_2")))

    groups = joined.select("lang", "source", "measure", F.col("n_0").alias("n"), mixed("q1").alias("high"), (mixed("q1") - mixed("q0")).alias("spread"))
    usual = quantiles(groups.groupBy("measure", _bucket("spread").alias("bucket")).agg(F.sum("n").alias("n")), [], [0.5]).select("measure", F.col("q0").alias("usual"))
    # a quantile is taken at the upper end of its bucket, so that a group of equal texts keeps them
    most = F.col("high") * (1 + GAMMA) / 2 * (1 + 1e-9) + rules.reach * F.greatest("spread", "usual")
    return groups.join(usual, "measure").select("lang", "source", "measure", most.alias("most"))


def judge_quality(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    the number of the adaptive rules that failed.

    Null or empty texts have no words, so they fail the base rule. Null languages and sources form groups
    of their own. Rows that repeat are judged each; an empty table gives an empty result; further columns
    are ignored. Counts are made once and saved; sketches and thresholds cover all rows that pass the base.
    """
    from ._spark import saved

    kind = df.schema[id_col].dataType.simpleString()

    def count(batches):
        for batch in batches:
            m = measures(batch.column(1))
            lines = [0 if t is None else t.count("\n") + 1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *[pa.array(m[k], pa.int64()) for k in MEASURES], pa.array(lines, pa.int64())], names=["id", "lang", "source", *MEASURES, "n_lines"])

    counts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")).mapInArrow(
        count, f"id {kind}, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES) + ", n_lines long"
    )
    counts = saved(counts, "quality")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    names = [r for r, _ in rules.ratios]
    rated = counts.withColumn("base_failed", failed).select("*", *[_ratio(r, 0).alias(r) for r in names])
    found = thresholds(rated.where("not base_failed"), rules)
    wide = found.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(*[F.max(F.when(F.col("measure") == r, F.col("most"))).alias(f"{r}_most") for r in names])
    joined = rated.join(wide, rated.lang.eqNullSafe(wide.g_lang) & rated.source.eqNullSafe(wide.g_source), "left")
    n_failed = sum((F.coalesce(F.col(r) > F.col(f"{r}_most"), F.lit(False)).cast("int") for r in names), F.lit(0))
    return joined.select(F.col("id").alias(id_col), *MEASURES, "base_failed", (~F.col("base_failed") & (n_failed == 0)).alias("kept"), n_failed.alias("rules_failed"))
