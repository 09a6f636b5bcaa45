"""The thin ``opN_*`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .chat import format_conversations
from .decontaminate import find_contamination
from .embeddings import embedding_classes
from .packing import pack_documents
from .quality import classify
from .secrets import scan_secrets
from .simhash import simhash_classes
from .substrings import remove_earlier
from .suffixes import remove_repeats
from .tokens import count_tokens

#: Where the public tokenizer files are; any folder or resolver with the same file names does.
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"), shingle=3, limit=2)


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=200)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_earlier(table(spark, sf_dir, "documents"), window=13)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "source", "lang", "p_quality", "p_toxic", "site_quality", "site_toxic", "keep")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(probe)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json"), limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_suffix_arrays": op4_suffix_arrays,
    "op5_substrings": op5_substrings,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality": op8_quality,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {}
