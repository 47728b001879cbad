"""The queries op1..op13 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ._spark import read


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; SIFTWORK_TOKENIZERS names another folder."""
    if folder := os.environ.get("SIFTWORK_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join_components

    return join_components(read(spark, sf_dir, "documents"), n=4, percent=85)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest, find_contamination

    return digest(find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(read(spark, sf_dir, "pages"), least_revisit_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(read(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, judge_urls

    return judge_urls(read(spark, sf_dir, "pages"), RULES)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), depth=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .relative_lz import remove_repeated_words

    return remove_repeated_words(read(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"), components=32)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep_groups=False)


def _sql() -> dict[str, str]:
    from .url_filter import SQL

    return {"op8_url_filters": SQL}


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_html_extraction,
        op3_decontamination,
        op4_warc,
        op5_packing,
        op6_token_counts,
        op7_quality_rules,
        op8_url_filters,
        op9_language_id,
        op10_suffix_dedup,
        op11_substring_dedup,
        op12_embedding_whitening,
        op13_tokenizer_alignment,
    )
}
ORACLE = _sql()
