"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesswatch.llm.alignment import align
from accesswatch.llm.common import cut, table, text_digest, text_or_empty
from accesswatch.llm.conversations import repair_plans
from accesswatch.llm.decontaminate import find_contamination
from accesswatch.llm.embedding_dups import near_vectors
from accesswatch.llm.html_text import extract, fit_weights
from accesswatch.llm.language import fit_language, identify
from accesswatch.llm.line_dedup import deduplicated
from accesswatch.llm.line_frequency import judge_documents
from accesswatch.llm.near_dups import near_duplicates
from accesswatch.llm.packing import pack
from accesswatch.llm.quality_classifier import fit_quality, quality_score
from accesswatch.llm.registry import QUERIES, SQL, register  # noqa: F401
from accesswatch.llm.sql import (
    CONVERSATIONS_SQL,
    DECONTAMINATION_SQL,
    EMBEDDINGS_SQL,
    LINE_DEDUP_SQL,
    LINE_FREQUENCY_SQL,
    NEAR_DUPS_SQL,
    URL_FILTER_SQL,
)
from accesswatch.llm.token_rollups import Rollup, counted, deleted, inserted, revised
from accesswatch.llm.url_filter import filter_urls
from accesswatch.session import checkpoint_dir

#: The url rules as (host, path, verdict).
URL_RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
)


def held(parts: int, part: int) -> Column:
    """Whether a document is of a part that nothing is learnt from; false for a null id, which is not learnt from either."""
    return F.coalesce(fold(parts) == part, F.lit(False)).alias("held_out")


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@register("op1_compression_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(docs, labels.where(fold(4) != 2))
    score = docs.select("doc_id", held(4, 2), quality_score(F.col("text"), model, spark).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@register("op2_decontamination", DECONTAMINATION_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@register("op3_line_dedup", LINE_DEDUP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "lines.*", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


@register("op4_token_rollups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents; copies of a text, but for its smallest document, deleted; texts with
    repeated lines counted anew without them; and the deletes sent once more, which must change nothing."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", text_digest().alias("digest"), F.length(text_or_empty()).cast("long").alias("chars"), "text"
    )
    versions = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    files = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]
    known = cut(counted(docs, files, public_tokenizers.PATTERN))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"))
    each = [
        F.struct(F.lit(v).alias("version"), F.col("tokens")[i].alias("tokens"), F.col("new_tokens")[i].alias("new_tokens"))
        for i, v in enumerate(versions)
    ]
    marked = known.join(first, "digest").select(
        "source", "lang", "chars", "new_chars", (F.col("doc_id") != F.col("first")).alias("copy"), F.inline(F.array(*each))
    )
    old = marked.select("source", "lang", "version", "tokens", "chars")
    stale = marked.where(~F.col("copy") & F.col("new_tokens").isNotNull())
    again = stale.select("source", "lang", "version", F.col("new_tokens").alias("tokens"), F.col("new_chars").alias("chars"))
    copies = deleted(marked.where("copy"))
    rollup = Rollup(spark, f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", inserted(old))
    rollup.commit("copies", copies)
    rollup.commit("repeated_lines", revised(stale.select(*old.columns), again))
    rollup.commit("copies", copies)
    return rollup.totals()


@register("op5_harmonic_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register("op6_line_frequency", LINE_FREQUENCY_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), ["doc_id"]).drop("n_left_words", "left_text")


@register("op7_unigram_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.where(fold(3) != 1), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return identify(docs, model, ["doc_id"]).select("doc_id", held(3, 1), "lang_pred", "score")


@register("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_weights(pages), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


@register("op9_url_filter", URL_FILTER_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "judged.*")


@register("op10_near_duplicates", NEAR_DUPS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), a, b)


@register("op12_embedding_near_duplicates", EMBEDDINGS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@register("op13_conversation_repair", CONVERSATIONS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of conversations that were damaged by the checksum of each row's id."""
    space = F.lit(" ")
    given = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]).cast("binary")) % 20).alias("code"),
    )
    damaged = given.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("_"),
    )
    return repair_plans(damaged, absent=F.col("dropped"))
