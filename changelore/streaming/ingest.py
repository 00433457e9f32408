"""Incremental ingestion with Structured Streaming.

Progress lives in the checkpoint of each query, so a restarted job goes on
where it stopped and a finished one has nothing to do.  Histories are taken to
be append-only: rewritten commits arrive under new hashes and are added.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changelore import schemas
from changelore.operators import chunks as chunk_ops
from changelore.operators import lexical, snapshot, vectors
from changelore.sources import history, merge_requests, sinks

COMMIT_KEY = ["repo_id", "sha"]
PARENT_KEY = ["repo_id", "child_sha", "parent_sha"]
CHUNK_KEY = ["repo_id", "source_type", "source_id"]


def read_landed(
    spark: SparkSession, folder: str, schema: str, max_files: int | None = None
) -> DataFrame:
    """Landed JSON lines (one record or page per line) as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def ingest_commits(
    spark: SparkSession, landed: str, tables: str, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Land commit-log records in the commits, commit_parents and file_changes tables.

    Commits that other batches stored are skipped by one anti join over the
    partitions of the batch's repositories.  All three tables then store the
    fresh rows as this batch, so a batch that is cut short and repeated replaces
    what it wrote; commits come last.
    """
    job = zlib.crc32(checkpoint.encode())

    def store(batch: DataFrame, number: int) -> None:
        fresh = sinks.unstored(spark, batch, f"{tables}/commits", schemas.COMMITS, COMMIT_KEY, job, number)
        fresh = fresh.persist()
        parts = (
            ("commit_parents", history.explode_parents(fresh).dropDuplicates(PARENT_KEY), schemas.COMMIT_PARENTS),
            ("file_changes", history.explode_changes(fresh), schemas.FILE_CHANGES),
            ("commits", history.commits(fresh), schemas.COMMITS),
        )
        try:
            for name, rows, schema in parts:
                sinks.replace_batch(rows, f"{tables}/{name}", schema, job, number)
        finally:
            fresh.unpersist()

    return _start(read_landed(spark, landed, schemas.COMMIT_LOG, max_files=max_files), store, checkpoint)


def backfill_prs(
    spark: SparkSession,
    landed: str,
    tables: str,
    repo_id: int,
    checkpoint: str,
    max_pages: int | None = None,
) -> StreamingQuery:
    """Upsert landed merge-request pages; `max_pages` bounds the pages per batch.

    The stored table has one row per request, so it is the state that a batch is merged into: a stored row
    wins, only a missing discussion is filled.  A batch rewrites the buckets of its requests alone; repeated,
    it finds itself stored.  `backfill_counts` tells what each batch brought.
    """
    job = zlib.crc32(checkpoint.encode())

    def store(batch: DataFrame, batch_id: int) -> None:
        incoming = merge_requests.parse_pr_pages(batch).withColumn("repo_id", F.lit(repo_id))
        marked = incoming.withColumn("first_job", F.lit(job).cast("long")).withColumn("first_batch", F.lit(batch_id).cast("long"))
        sinks.upsert(spark, marked, f"{tables}/pull_requests", STORED_PRS, merge_requests.PR_KEY, merge_requests.upsert_prs)
        sinks.append_new(
            spark,
            merge_requests.pr_links(incoming),
            f"{tables}/commit_pr_links",
            schemas.COMMIT_PR_LINKS,
            ["repo_id", "sha", "pr_number"],
            job,
            batch_id,
        )
        seen = merge_requests.page_info(batch).agg(
            F.lit(repo_id).alias("repo_id"),
            F.count(F.lit(1)).alias("pages"),
            F.coalesce(F.sum("fetched"), F.lit(0)).cast("long").alias("fetched"),
        )
        sinks.replace_batch(seen, f"{tables}/backfill_pages", BACKFILL_PAGES, job, batch_id)

    return _start(read_landed(spark, landed, schemas.PR_PAGE, max_files=max_pages), store, checkpoint)


STORED_PRS = f"{schemas.PULL_REQUESTS}, first_job BIGINT, first_batch BIGINT"
BACKFILL_PAGES = "repo_id INT, pages BIGINT, fetched BIGINT"


def stored_prs(spark: SparkSession, tables: str, repo_id: int | None = None) -> DataFrame:
    """The merge requests as the upserts left them: a plain read."""
    rows = sinks.read_keyed(spark, f"{tables}/pull_requests", STORED_PRS)
    if repo_id is not None:
        rows = rows.where(F.col("repo_id") == repo_id)
    return rows.select(*schemas.fields(schemas.PULL_REQUESTS))


def backfill_counts(spark: SparkSession, tables: str) -> DataFrame:
    """Per repository, job and batch: landed pages, fetched requests, and those that were new to the table."""
    key = ["repo_id", "job", "batch"]
    rows = sinks.read_keyed(spark, f"{tables}/pull_requests", STORED_PRS)
    new = rows.groupBy("repo_id", F.col("first_job").alias("job"), F.col("first_batch").alias("batch")).agg(
        F.count(F.lit(1)).alias("stored_new")
    )
    pages = sinks.read_table(spark, f"{tables}/backfill_pages", BACKFILL_PAGES)
    return pages.join(new, key, "left").withColumn("stored_new", F.coalesce("stored_new", F.lit(0)))


def label_counts(labels: DataFrame) -> DataFrame:
    """Running counts per repository and label, for `outputMode("complete")`."""
    return labels.groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("commits"))


def distinct_commits(commits: DataFrame, delay: str = "7 days") -> DataFrame:
    """Duplicates dropped in the stream, with state bounded by the time of arrival.

    Arrival never runs backwards, so no commit is late however old it is.  A repeat that arrives after
    `delay` passes; the sinks do not store it again.
    """
    arrived = commits.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(COMMIT_KEY).drop("_arrived")


def embed_new(
    spark: SparkSession,
    chunk_stream: DataFrame,
    table: str,
    checkpoint: str,
    encoder: Callable[[], vectors.Encoder] = vectors.HashingEncoder,
    files: DataFrame | None = None,
    alive: DataFrame | None = None,
) -> StreamingQuery:
    """Encode and append only the chunks that the table does not hold yet: vector, tokens, files, liveness.

    `files` (repo_id, source_type, source_id, path) are the files of chunks and `alive` (repo_id, path) the
    paths at HEAD; a chunk's liveness is the share of its files that exist.  Without them, or for a chunk
    without files, it is NULL and the chunk is never stale.  One anti join finds the unseen chunks, over the
    partitions of the batch's repositories.
    """
    job = zlib.crc32(checkpoint.encode())

    def store(batch: DataFrame, number: int) -> None:
        unseen = sinks.unstored(spark, batch, table, schemas.CHUNKS, CHUNK_KEY, job, number, sinks.CHUNK_PARTITIONS)
        rows = vectors.embed(lexical.with_tokens(chunk_ops.with_text(unseen).withColumn("tokens", F.lit(None).cast("array<string>"))), encoder)
        rows = rows.withColumn("body", F.col("text"))
        if files is not None and alive is not None:
            asked = sinks.touched(files, batch).join(unseen.select(*CHUNK_KEY), CHUNK_KEY, "left_semi")
            scored = snapshot.liveness(asked.where("path IS NOT NULL"), sinks.touched(alive, batch), CHUNK_KEY)
            rows = rows.join(scored, CHUNK_KEY, "left")
        else:
            rows = rows.withColumn("liveness_score", F.lit(None).cast("double"))
        sinks.replace_batch(rows, table, schemas.CHUNKS, job, number, sinks.CHUNK_PARTITIONS)

    return _start(chunk_stream, store, checkpoint)


def _start(
    stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    def once(batch: DataFrame, batch_id: int) -> None:
        """The steps of a batch share its parsed rows."""
        batch.persist()
        try:
            store(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(once)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
