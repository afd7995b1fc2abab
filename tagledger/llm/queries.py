"""The registered queries of this package; SQL counterparts are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagledger.llm import (
    alignment, collocations, decontaminate, licenses, lines, mixing, passages, quality, secret_scan, simhash, token_counts,
    tokens, toxicity,
)
from tagledger.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """Where the public vocabulary of the token query lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_vocabulary() -> str:
    """Where the public sentencepiece model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary())


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_of("base", k).alias(f"n_{k}") for k in secret_scan.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.printed("base"), 256).alias("base_sha256"),
                        secret_scan.printed("spans").alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two vocabularies in every whole text, which is zeros where it has no tokens."""
    return alignment.linked_documents(table(spark, sf_dir, "documents"), vocabulary(), piece_vocabulary())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language; null texts are empty, a null language is ``und``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: More tokens than this are over the limit of the count query.
TOKEN_LIMIT = 1024


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text: the stored count of its longest prefix. Null texts have none."""
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents"), vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_toxicity, op2_simhash, op3_passages, op4_tokens, op5_secrets, op6_mixing, op7_licenses, op8_decontaminate,
    op9_lines, op10_quality, op11_alignment, op12_collocations, op13_token_counts)}
