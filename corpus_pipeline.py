"""Documents to a training mix: quality rules, near-duplicate join, personal data, source mix, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore.llm import bpe, mixing, ngram_join, pii, quality_rules
from changelore.runtime import checkpoint_dir, checkpointed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the failing lines go.

    NULL and empty texts are rejected; repeated rows and rows without a key are judged like any other;
    other columns than those of documents are dropped, in every stage.
    """
    kept = quality_rules.clean(docs.select(*COLUMNS)).where("kept")
    return kept.withColumn("text", F.col("clean_text")).withColumn(
        "n_chars", F.char_length("clean_text").cast("long")
    ).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of the smallest key, rows without a key last.

    Rows of one text are reduced to one first, whatever their keys, so repeated rows and copies without a
    key go too; among equal keys a hash of the row decides.  Different texts under one key are judged
    apart.  Texts without a word (NULL, empty, blank) are copies of nothing and all stay.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(*COLUMNS)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("lang", "source", "n_chars"))
    once = (
        rows.where(worded)
        .groupBy(F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2"))
        .agg(F.min_by(F.struct(*COLUMNS), order).alias("r"))
        .select("r.*", F.monotonically_increasing_id().alias("_row"))
    )
    # written once, so that the row numbers are the same wherever they are read
    once = checkpointed(once)
    groups = ngram_join.groups(once.select("_row", "text"), key="_row")
    stays = (
        groups.join(once.select("_row", "doc_id"), "_row")
        .groupBy("component_id")
        .agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row"))
    )
    return once.join(stays.select("_row"), "_row", "left_semi").select(*COLUMNS).unionByName(rows.where(~worded))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; NULL and empty texts stay as they are."""
    found = pii.masked(pii.find(docs.select(*COLUMNS)))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole epochs, and once more where the fraction falls.

    The document at which a source's budget ends is taken when at least half of it fits.  NULL and empty
    texts have size 0 and follow the whole takes of their source; rows without one are a source of their own.
    """
    mixed = mixing.mix(docs.select(*COLUMNS))
    copies = F.col("epochs") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")
    taken = mixed.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text of the mix, a row for each row; NULL and empty texts have none."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("tokens", tokens),
]

#: Duplicate joins and BPE are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written below the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
