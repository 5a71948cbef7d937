"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import ORACLE_SQL  # noqa: F401  part of this module's interface

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, result="digest")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "words_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audio

    got = audio.features(audio.store(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", "frames", (F.size("spans_ms") / 2).cast("int"), F.coalesce(F.try_element_at("spans_ms", F.lit(1)), F.lit(-1)), F.crc32("tensors"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard.shard(docs).select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read(warc.write(table(spark, sf_dir, "pages")), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard, op2_line_dedup, op3_decontaminate, op4_audio, op5_histogram_sort, op6_chat, op7_quality, op8_bpe, op9_warc, op10_html)}
