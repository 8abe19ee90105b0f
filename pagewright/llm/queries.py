"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import chat, decontaminate, extract, fingerprint, language, mixture, packing, quantize, resample, secrets, simhash, tokens, toxicity
from pagewright.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' fingerprints and the least doc_id reachable by links of three bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the output, with the example conversation among them."""
    return chat.digests(chat.with_example(table(spark, sf_dir, "conversations")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    return language.language(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path
    return packing.packed(table(spark, sf_dir, "documents"), path(packing.TOKENIZER), path(packing.RANKS), public_tokenizers.PATTERN)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: base findings, and spans that the grammars add."""
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.extraction(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document."""
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.MODEL))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all vectors, their errors, and the digest of the codebooks."""
    return quantize.compressed(table(spark, sf_dir, "embeddings"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixture.taken(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight, score and rank of every document against the benchmark."""
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.ORACLE, "op11_codes": quantize.ORACLE, "op12_mixture": mixture.ORACLE, "op13_resample": resample.ORACLE}
