"""The training corpus pipeline: documents in, tokenised clean documents out.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; `run` writes every stage's result as
Parquet to the shared folder and reads it again as the next one's input; a stage's own intermediate tables are deleted
when its result is written. All stages but the last return the columns of `documents`, and others that they were given.

Defined results: a document with a null, empty or blank text scores 0 and goes with the first stage; of repeated rows of
one id one stays; rows with a null id come last in line dedup, are linked with nothing, and stay; `n_chars`, where there
is one, follows the text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepquery.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from stepquery.llm.common import materialize, scratch, table

#: Near copies in the pipeline: five words and a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote rejects go. The model learns from the labelled rows of `documents`."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which nothing is left goes with them."""
    kept = line_dedup.dedup(docs)
    kept = kept.where("words_deleted = 0 or text <> ''")
    if "n_chars" in docs.columns:
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("words_deleted") > 0, now).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    return jaccard_join.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, result="digest")


STAGES = [
    ("quality", quality_classifier),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("decontamination", benchmark_leaks),
    ("tokens", tokens),
]
#: SQL cannot express the stages; tests hold line dedup and near copies against brute force, and the others in parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
