"""Status and accounting reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelore.operators import skew


def label_distribution(labels: DataFrame) -> DataFrame:
    """Count and share per repository and label; shares are taken over the small counts."""
    counts = labels.groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("commits"))
    total = F.sum("commits").over(W.partitionBy("repo_id"))
    return counts.withColumn("share_pct", F.round(100.0 * F.col("commits") / total, 1))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count("embedding").alias("embedded_chunks"),
        F.array_sort(F.collect_set("embedding_model")).alias("embedding_models"),
    )


def repo_status(repos: DataFrame, commits: DataFrame, labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Everything a repository's status line shows; each input is counted before the joins."""
    n_commits = commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("commits"))
    by_label = labels.groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("n"))
    significance = by_label.groupBy("repo_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("significance")
    )
    complete = F.coalesce(F.col("head_sha") == F.col("indexed_through_sha"), F.lit(False)) & (
        F.col("head_sha") != ""
    )
    return (
        repos.withColumnRenamed("id", "repo_id")
        .join(n_commits, "repo_id", "left")
        .join(significance, "repo_id", "left")
        .join(chunk_counts(chunks), "repo_id", "left")
        .select(
            "repo_id",
            "name",
            "head_sha",
            "indexed_through_sha",
            F.coalesce("commits", F.lit(0)).alias("commits"),
            F.coalesce("significance", F.create_map().cast("map<string,bigint>")).alias("significance"),
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("embedded_chunks", F.lit(0)).alias("embedded_chunks"),
            F.coalesce("embedding_models", F.array().cast("array<string>")).alias("embedding_models"),
            F.coalesce(complete, F.lit(False)).alias("complete_at_head"),
        )
    )


def repo_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("repos"),
        F.sum("commits").alias("commits"),
        F.sum("chunks").alias("chunks"),
    )


def trace_accounting(traces: DataFrame) -> DataFrame:
    """Calls, tokens and latency per stage and model."""
    key = ["stage", "model"]
    totals = traces.groupBy(*key).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    )
    p95 = skew.order_statistic(traces, key, "latency_ms", 0.95, "p95_latency_ms")
    return totals.join(p95, key, "left")
