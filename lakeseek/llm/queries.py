"""The registered queries of this subpackage: thin layers over its operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .decontaminate import contamination
from .html_extract import extract_main_text
from .license_scan import license_scan
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard_join
from .quality_classifier import quality_classifier
from .quality_rules import quality_report
from .substring_chain import fuzzy_passages
from .suffix_dedup import substring_dedup
from .token_binary import token_binary

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_weights(names: list) -> list[int]:
    """Weights of the sources by code point: 3, 1, 2, repeating."""
    return [(3, 1, 2)[k % 3] for k in range(len(names))]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=2, percent=60)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), length=200)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejects first may change with the measured order; the verdict doesn't
    return quality_report(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), source_weights, share=1.5, max_copies=2)


def op6_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(_table(spark, sf_dir, "documents"), min_words=50, min_share=0.8)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(_table(spark, sf_dir, "documents"), tokenizer_path(), end=2)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), max_documents=6000)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard, op2_license_scan, op3_suffix_dedup, op4_quality_rules, op5_mix_sources, op6_fuzzy_passages, op7_token_binary, op8_html_extract, op9_quality_classifier, op10_decontaminate)}

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": oracle.OP1, "op4_quality_rules": oracle.OP4, "op5_mix_sources": oracle.OP5, "op10_decontaminate": oracle.OP10}
