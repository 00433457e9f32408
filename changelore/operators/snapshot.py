"""State at HEAD derived from change history: paths, touch dates, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.operators import graph
from changelore.runtime import checkpointed


def head_paths(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Paths alive at HEAD: the newest change of a path neither deletes nor renames it away.

    A rename speaks about two paths; both come out of the same row, so the
    history is read and joined once.
    """
    dated = changes.join(commits.select("repo_id", "sha", "committed_at"), ["repo_id", "sha"])
    own = F.struct(
        F.col("path").alias("path"), F.lit(1).alias("k"), (F.col("status") != C.DELETED).alias("alive")
    )
    moved = F.struct(F.col("old_path").alias("path"), F.lit(0).alias("k"), F.lit(False).alias("alive"))
    said = F.when(F.col("status") == C.RENAMED, F.array(own, moved)).otherwise(F.array(own))
    newest = (
        dated.select("repo_id", "committed_at", "sha", F.explode(said).alias("s"))
        .groupBy("repo_id", F.col("s.path").alias("path"))
        .agg(F.max(F.struct("committed_at", "sha", "s.k", "s.alive")).alias("m"))
    )
    return newest.where("m.alive").select("repo_id", "path")


def head_paths_of(heads: DataFrame, changes: DataFrame, commits: DataFrame, parents: DataFrame) -> DataFrame:
    """Paths alive at the heads (repo_id, head_sha) of repositories: only what their ancestors changed counts.

    A commit on a side branch that no head has merged says nothing.  Changes are ordered by corrected commit
    time, so a commit behind a skewed clock does not come before its parents.
    """
    key = ["repo_id", "sha"]
    reached = checkpointed(graph.ancestors(heads, parents).select(*key).distinct())
    order = graph.topological_order(
        commits.join(reached, key, "left_semi"),
        parents.join(reached.withColumnRenamed("sha", "child_sha"), ["repo_id", "child_sha"], "left_semi"),
    )
    return head_paths(changes, order.withColumn("committed_at", F.timestamp_seconds("order_time")))


def last_touched(changes: DataFrame, commits: DataFrame) -> DataFrame:
    return (
        changes.join(
            commits.where(F.col("committed_at").isNotNull()).select(
                "repo_id", "sha", "committed_at"
            ),
            ["repo_id", "sha"],
        )
        .groupBy("repo_id", "path")
        .agg(F.max("committed_at").alias("last_touched"))
    )


def liveness(chunk_files: DataFrame, alive: DataFrame, key: list[str]) -> DataFrame:
    """Share of a chunk's files that exist at HEAD.

    `chunk_files` holds one (key, repo_id, path) row per touched file, with a
    NULL path for a chunk that touches none (score 0.0).
    """
    marked = alive.select("repo_id", "path").distinct().withColumn("_alive", F.lit(1.0))
    return (
        chunk_files.join(marked, ["repo_id", "path"], "left")
        .groupBy(*key)
        .agg(F.avg(F.coalesce("_alive", F.lit(0.0))).alias("liveness_score"))
    )


def is_stale(score: Column | str = "liveness_score") -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return score.isNotNull() & (score < C.STALE_BELOW)


def with_stale(hits: DataFrame) -> DataFrame:
    return hits.withColumn("stale", is_stale())
