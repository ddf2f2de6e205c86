"""One query for each operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers as _tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe as _bpe
from tessera.llm import decontaminate as _leaks
from tessera.llm import exact_dedup as _exact
from tessera.llm import html_text as _html
from tessera.llm import jaccard_join as _jaccard
from tessera.llm import language_id as _language
from tessera.llm import lm_score as _lm
from tessera.llm import minhash as _minhash
from tessera.llm import quality as _quality
from tessera.llm import ranked_search as _ranked
from tessera.llm import suffix_dedup as _passages
from tessera.llm import token_counts as _tokens
from tessera.llm import whitening as _whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_groups(_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.near_groups(_table(spark, sf_dir, "documents"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.bpe_digests(_table(spark, sf_dir, "documents"), _tokenizers.path("byte_bpe_multi_50k.tiktoken"), _tokenizers.PATTERN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.identify(_table(spark, sf_dir, "documents"))


def op3_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: the html element's lang, the host of the url and its last label."""
    pages = _html.extract_text(_table(spark, sf_dir, "pages"))
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z-]{2,})", 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    pages = pages.select("page_id", "text", F.nullif(declared, F.lit("")).alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))
    return _language.identify(pages, "page_id", "text", "declared", "host", "suffix")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _html.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.self_scores(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, its repeated passages and the words in them."""
    found = _passages.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), "n_repeated", F.to_json("spans").alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _tokens.piece_vocabulary(_tokenizers.path("piece_bpe_32k.model"))
    return _tokens.token_counts(_table(spark, sf_dir, "documents"), pieces)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _leaks.SQL, "op9_exact_dedup": _exact.SQL, "op11_ranked_search": _ranked.SQL}
