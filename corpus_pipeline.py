"""The corpus pipeline: documents to packed sequences, in stages that are each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``.  Decisions are small rows of identifiers:
they are broadcast to the documents behind a count, and beyond it joined by
shuffle, so texts move only where they must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeloom.llm import exact_dedup, language, mixing, near_dedup, packing
from pixeloom.llm.queries import tokenizer_file
from pixeloom.plans.shared import written

#: Rows of decisions up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: SQL for the rows of ``run``: none, as language identification, MinHash and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def small(rows: DataFrame) -> DataFrame:
    rows = written(rows, "decisions")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is more likely than not go; rows and columns stay as they are."""
    return language.identify(docs, docs.columns).where("_language.kept").drop("_language")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text the longest, then the one with the smallest id, stays; of repeated rows one stays."""
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays."""
    found = near_dedup.near_dedup(docs, near_dedup.Similarity(width=5, percent=80))
    gone = small(found.where("not kept").select(F.col("doc_id").alias("cp__id")).distinct())
    return docs.join(gone, docs["doc_id"] == F.col("cp__id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that repeat an id are taken equally often."""
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").cast("int").alias("cp__copies")).where("cp__copies > 0")
    copies = small(copies.select(F.col("doc_id").alias("cp__id"), "cp__copies"))
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(F.col("cp__id")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col("cp__copies"))).alias("cp__copy")).select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language identification", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
