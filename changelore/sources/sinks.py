"""Idempotent writers.

Every sink is a plain parquet table partitioned by repository, and below it by the batch that wrote the
rows.  A batch replaces its own rows and nothing else, so a repeated batch changes nothing; keys that other
batches stored are taken out with one anti join, over the partitions of the batch's repositories.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import schemas
from changelore.runtime import BROADCAST_BYTES, checkpointed
from changelore.sources.bucketed import declare

#: Distinct partition values up to which they are literals of the scan; beyond, a join prunes.
LITERAL_PARTITIONS = 2_000
#: Rows of a batch without a number of its own: its hash names it.
_WRITER = "job BIGINT, batch BIGINT"


def read_table(spark: SparkSession, path: str, schema: str, partitions: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """The stored table, or an empty one before the first write.

    The catalog only names the files below `path`; a table that nothing was written to has none.  Columns are
    those of `schema`, then the writer of a row (`job`, `batch`).
    """
    held = [c for c in partitions if c in schemas.fields(schema)]
    if not held:
        return _named(spark, path, schema, [])
    return _named(spark, path, f"{schema}, {_WRITER}", [*held, "job", "batch"])


def _named(spark: SparkSession, path: str, columns: str, partitions: list[str]) -> DataFrame:
    """The files below `path`, whatever session wrote them; a path without files is an empty table."""
    name = "sink_" + hashlib.sha256(f"{path}|{columns}|{partitions}".encode()).hexdigest()[:24]
    by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    declare(spark, f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {by} LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return spark.table(name).select(*schemas.fields(columns))


def touched(stored: DataFrame, batch: DataFrame, column: str = "repo_id") -> DataFrame:
    """The stored rows of the partitions that a batch has rows of.

    The values are literals of the scan, so other partitions are not even listed as input; of a batch over
    very many of them the smallest and the largest are.
    """
    values = [r[0] for r in batch.select(column).distinct().limit(LITERAL_PARTITIONS + 1).collect()]
    if len(values) <= LITERAL_PARTITIONS:
        return stored.where(F.col(column).isin([v for v in values if v is not None]))
    ends = batch.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return stored.where(F.col(column).between(ends["lo"], ends["hi"]))


def fresh_rows(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The batch without duplicates and without the keys that are stored already."""
    return batch.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def child_rows(children: DataFrame, fresh_commits: DataFrame) -> DataFrame:
    """Rows of parent, change, feature or label tables that belong to fresh commits."""
    key = ["repo_id", "sha"]
    fresh = fresh_commits.select(*key)
    if "child_sha" in children.columns:
        fresh = fresh.withColumnRenamed("sha", "child_sha")
        key = ["repo_id", "child_sha"]
    return children.join(fresh, key, "left_semi")


def unstored(
    spark: SparkSession, batch: DataFrame, path: str, schema: str, key: list[str], job: int, number: int,
    partitions: tuple[str, ...] = ("repo_id",),
) -> DataFrame:
    """The rows of `batch` whose key no other batch has stored."""
    stored = touched(read_table(spark, path, schema, partitions), batch)
    others = stored.where((F.col("job") != job) | (F.col("batch") != number))
    return fresh_rows(others, batch, key)


def replace_batch(
    rows: DataFrame, path: str, schema: str, job: int, number: int, partitions: tuple[str, ...] = ("repo_id",)
) -> None:
    """Store rows as this batch, in place of what it held in their partitions.

    Rows are dealt by partition first: a partition gets a few files, not one from every task, and a repository
    that holds most rows is split over several tasks.
    """
    held = list(partitions)
    (
        rows.select(*schemas.fields(schema), F.lit(job).cast("long").alias("job"), F.lit(number).cast("long").alias("batch"))
        .hint("rebalance", *held)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*held, "job", "batch")
        .parquet(path)
    )


def append_new(
    spark: SparkSession, batch: DataFrame, path: str, schema: str, key: list[str], job: int = 0, number: int | None = None,
    partitions: tuple[str, ...] = ("repo_id",),
) -> None:
    """Append the rows of `batch` whose key is not stored yet.

    Only the stored partitions of the batch's repositories are read.  `job` and `number` name the batch in a
    stream; without them the next free number is taken, and a repeated call finds its keys stored.
    """
    if number is None:
        last = touched(read_table(spark, path, schema, partitions), batch).where(F.col("job") == job).agg(F.max("batch")).first()[0]
        number = 0 if last is None else last + 1
    replace_batch(unstored(spark, batch, path, schema, key, job, number, partitions), path, schema, job, number, partitions)


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that `upsert` keeps: one row per key, as it is read."""
    return _named(spark, path, f"{schema}, bucket INT", ["repo_id", "bucket"]).drop("bucket")


def upsert(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    schema: str,
    key: list[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = 16,
) -> None:
    """Merge rows into a table of one row per key: `merge(stored, rows)` on the buckets that the rows fall into.

    A bucket is a partition below its repository, chosen by a hash of the key.  Touched buckets are read as
    literals, merged, written aside and then put in their place; all others stay as they are, and a read needs
    no folding.  `rows` may repeat a key if `merge` allows it.
    """
    columns = schemas.fields(schema)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    placed = checkpointed(rows.select(*columns, bucket.alias("bucket")))
    held = touched(_named(spark, path, f"{schema}, bucket INT", ["repo_id", "bucket"]), placed)
    place = F.col("repo_id").cast("long") * buckets + F.col("bucket")
    places = [r[0] for r in placed.select(place).distinct().limit(LITERAL_PARTITIONS + 1).collect()]
    if len(places) <= LITERAL_PARTITIONS:  # else all buckets of the repositories are written again
        held = held.where(place.isin(places))
    merged = merge(held.select(*columns), placed.select(*columns)).select(*columns)
    aside = checkpointed(merged.withColumn("bucket", bucket))
    (
        aside.hint("rebalance", "repo_id", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_id", "bucket")
        .parquet(path)
    )


CHUNK_KEY = ["repo_id", "source_type", "source_id"]
CHUNK_PARTITIONS = ("repo_id", "source_type")


def write_chunks(
    spark: SparkSession, chunks: DataFrame, path: str, job: int = 0, number: int | None = None, title_cut: int | None = None
) -> None:
    """Append unseen chunks, partitioned by repository and source type; titles are cut only on request."""
    rows = chunks if title_cut is None else chunks.withColumn("title", F.left("title", F.lit(title_cut)))
    append_new(spark, rows, path, schemas.CHUNKS, CHUNK_KEY, job, number, CHUNK_PARTITIONS)


def compact(
    spark: SparkSession, path: str, into: str, schema: str, partitions: tuple[str, ...] = ("repo_id",), file_bytes: int = BROADCAST_BYTES * 4
) -> None:
    """All batches of a table as one batch of another: few files per partition in place of some per batch.

    A rebalance splits partitions above the advised size, so a repository that holds most rows is several
    files and several tasks.
    """
    rows = read_table(spark, path, schema, partitions).drop("job", "batch")
    dealt = rows.hint("rebalance", *partitions)
    (
        dealt.select(*schemas.fields(schema), F.lit(0).cast("long").alias("job"), F.lit(0).cast("long").alias("batch"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", file_bytes)
        .partitionBy(*partitions, "job", "batch")
        .parquet(into)
    )


def append_traces(traces: DataFrame, path: str) -> None:
    """Traces are an append-only fact table."""
    stamped = traces.withColumn(
        "created_at", F.coalesce(F.col("created_at"), F.current_timestamp())
    )
    stamped.select(*schemas.fields(schemas.TRACES)).write.mode("append").parquet(path)
