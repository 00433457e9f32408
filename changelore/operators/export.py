"""Slim snapshot: what answering needs, without the rows that only indexing needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore.operators import vectors

INDEX_ONLY = ("file_changes", "commit_features", "pull_requests")


def slim_snapshot(tables: dict[str, DataFrame], dropped_repos: DataFrame) -> dict[str, DataFrame]:
    """Tables without the dropped repositories (by name); index-only tables come out empty.

    Vectors are quantised to int8 with one scale each.
    """
    gone = (
        tables["repos"].join(dropped_repos.select("name"), "name", "left_semi").select(F.col("id").alias("repo_id"))
    )
    out: dict[str, DataFrame] = {}
    for name, table in tables.items():
        if name in INDEX_ONLY:
            out[name] = table.where(F.lit(False))
        elif name == "repos":
            out[name] = table.join(dropped_repos.select("name"), "name", "left_anti")
        else:
            out[name] = table.join(gone, "repo_id", "left_anti")
    if "discussion_chunks" in out:
        out["discussion_chunks"] = out["discussion_chunks"].withColumn(
            "embedding", vectors.quantize("embedding")
        )
    return out


def write_snapshot(snapshot: dict[str, DataFrame], folder: str) -> None:
    for name, table in snapshot.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def snapshot_counts(snapshot: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of every table, in one job."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, table in snapshot.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
