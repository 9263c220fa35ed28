"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeloom.llm import chat, embedding_dedup, exact_dedup, language, mixing, near_dedup, packing, substring_dedup, token_count, url_filter
from pixeloom.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers lie on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("file", "row").withColumnRenamed("digest", "text_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), near_dedup.Similarity(width=3, percent=85))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(tables.unionByName(own)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document (``page_id`` null) and one per page (``doc_id`` null), each table judged on its own evidence."""
    none = F.lit(None).cast("long")
    found = language.identify(read(spark, sf_dir, "documents"), ["doc_id", "lang"])
    found = found.select("doc_id", none.alias("page_id"), F.col("lang").alias("declared"), "_language")
    pages = language.page_evidence(read(spark, sf_dir, "pages")).select("page_id", "evidence.*")
    seen = language.identify(pages, ["page_id", "declared"], id_col="page_id", declared_col="declared", host_col="host", parent_col="parent", suffix_col="suffix")
    rows = found.unionByName(seen.select(none.alias("doc_id"), "page_id", "declared", "_language"))
    return rows.select("doc_id", "page_id", "declared", "_language.language", "_language.confidence", "_language.kept")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_near_dedup, op4_chat, op5_embedding_dedup, op6_url_filter, op7_substring_dedup, op8_language_id, op9_token_count, op10_mixing)}
