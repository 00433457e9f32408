"""Readers of exported commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import schemas
from changelore.functions import text as X


def read_commit_log(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested commit records (message, parents, file deltas), one row per commit."""
    return spark.read.schema(schemas.COMMIT_LOG).format(fmt).load(path)


def commits(log: DataFrame) -> DataFrame:
    """Commit rows: first line as subject, the whole message as body, epoch 0 as no date."""
    return log.select(
        "repo_id",
        "sha",
        "author_name",
        "author_email",
        "committer_name",
        "committer_email",
        X.epoch_to_timestamp("author_time").alias("authored_at"),
        X.epoch_to_timestamp("commit_time").alias("committed_at"),
        X.first_line("message").alias("subject"),
        F.col("message").alias("body"),
    )


def explode_parents(log: DataFrame) -> DataFrame:
    """(child, parent, position) edges."""
    return log.select(
        "repo_id", F.col("sha").alias("child_sha"), F.posexplode("parents")
    ).select(
        "repo_id", "child_sha", F.col("col").alias("parent_sha"), F.col("pos").alias("position")
    )


def explode_changes(log: DataFrame) -> DataFrame:
    """One row per file delta, numbered in delta order."""
    return log.select("repo_id", "sha", F.posexplode("files")).select(
        "repo_id",
        "sha",
        F.col("pos").alias("seq"),
        F.col("col.status").alias("status"),
        F.col("col.path").alias("path"),
        F.col("col.old_path").alias("old_path"),
        F.col("col.additions").alias("additions"),
        F.col("col.deletions").alias("deletions"),
    )


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """`%H\\x1f%aI\\x1f%s\\x1e` records, newest first inside a file."""
    raw = spark.read.option("lineSep", "\x1e").text(path)
    return parse_git_log(raw, "value")


def parse_git_log(records: DataFrame, column: str, *keep: str) -> DataFrame:
    """Keep the records with exactly three fields and a non-empty hash."""
    parts = F.split(F.btrim(F.col(column), F.lit("\n")), "\x1f")
    return (
        records.withColumn("_parts", parts)
        .where((F.size("_parts") == 3) & (F.element_at("_parts", 1) != ""))
        .select(
            *keep,
            F.element_at("_parts", 1).alias("sha"),
            X.iso_to_timestamp(F.element_at("_parts", 2)).alias("authored_at"),
            F.element_at("_parts", 3).alias("subject"),
        )
    )


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Every markdown file below a folder, as (path, content)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(F.lower("path").endswith(".md"))
    )
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def markdown_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").endswith(".md"))
