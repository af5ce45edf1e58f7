"""From documents to packed training sequences: five stages, each over all that its predecessor kept.

A stage takes and returns the columns of ``documents``, the last returns pieces of sequences. Each carries
whole rows in a struct, so further columns of any name pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accesswatch.llm.common import cut, text_or_empty
from accesswatch.llm.decontaminate import find_contamination
from accesswatch.llm.line_dedup import deduplicated
from accesswatch.llm.line_frequency import judge_documents
from accesswatch.llm.near_dups import near_duplicates
from accesswatch.llm.packing import pack


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("_row"), *names)


def _without_text(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), *names)


def _with_text(kept: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` out of ``_row`` and a new ``text``, which ``n_chars`` follows."""
    length = F.length("text").cast("long").alias("n_chars")
    return kept.select(
        *[F.col("text") if c == "text" else length if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in columns]
    )


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject, without the lines above the limits of their host."""
    judged = judge_documents(_without_text(docs, "text", "source"), ["_row"]).where("kept")
    return _with_text(judged.select("_row", F.col("left_text").alias("text")), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents repeat; ``n_chars`` follows the text."""
    kept = deduplicated(_without_text(docs, "doc_id", "text")).select("_row", "text")
    return _with_text(kept, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows that share a document id, one. Null ids all stay."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(text_or_empty()))
    one = (
        _carried(docs, "doc_id", "text").join(kept, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(order))
        .where("_nth = 1").select("_row.*")
    )
    return one.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than traces of benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(_carried(docs, "doc_id", "text"), benchmark, ["_row"])
    return found.where("NOT contaminated").select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids and the ids' checksum."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Token ids and near-duplicates by signature have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, with a checkpoint after each but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
