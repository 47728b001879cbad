"""Corpus preparation: five stages over `documents`, each written as Parquet and read again.

A stage is (name, function); a function takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of `documents`; the last returns the packed pieces.

Every stage takes null ids, null and empty texts, repeated rows, an empty table (and gives one), and further
columns of any name, which stay with their rows. Null and empty texts, and texts without letters, end at the
language stage; given to a later stage, they stay (near_duplicates, benchmark_passages), as does an empty text
that nothing was cut from (repeated_passages), and are packed as their end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm import decontaminate as contamination
from siftwork.llm import langid, ngram_join, packing, suffix_dedup
from siftwork.llm._spark import read, saved
from siftwork.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the context trees know; null texts, texts without letters and close calls go.
    Labels of the table itself teach the trees, but for held-out rows; without any label all rows go."""
    return langid.accept(docs, langid.train(docs.where(~langid.held_out())), least_score=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of documents linked by 80 % of their 5-word shingles, and of
    repeated rows one (ties between their further columns: the smallest language, then source). Rows of a null id are
    kept unless they are linked with one that has an id; texts without words are linked with nothing."""
    found = ngram_join.join_components(docs, n=5, percent=80, text_hash=True)
    # rows of one id may have several texts, each of its own component; one key for join and window, so texts are shuffled once
    key = lambda text: F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text.alias("text"))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key(F.col("text_hash")).alias("_key")).distinct()
    # rows move as one struct, so further columns may have any name
    joined = docs.select(F.struct("*").alias("row"), key(F.xxhash64("text")).alias("_key")).join(keep, "_key", "left_semi")
    again = F.row_number().over(Window.partitionBy("_key").orderBy("row.lang", "row.source"))
    return joined.withColumn("_again", again).where("_again = 1").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of a 100-byte string that occurs earlier; documents of which only white space is left go. Texts are
    cut between whole characters; n_chars follows the cut."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", F.struct(*others).alias("others"))
    cut = suffix_dedup.remove_repeats(carried, depth=100, carry=("others",))
    changed = F.col("n_removed") > 0
    found = {c: F.col("others").getField(c).alias(c) for c in others} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in found:
        found["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("others.n_chars")).alias("n_chars")
    return cut.where(~changed | F.col("text").rlike(r"\S")).select(*[found[c] for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of benchmark windows; documents that are benchmark text for the most part go. Without benchmark
    items nothing is cut."""
    out = contamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), window=10, most_coverage=0.5)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 4096 ids; rows that repeat are packed each."""
    return packing.pack(docs, vocabulary(), capacity=4096, end_id=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packed),
]

#: SQL can neither train and score context trees nor code texts; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
