"""Repository dimension: lookups, slugs, watermarks, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.functions import text as X
from changelore.runtime import broadcast_if_small


def resolve_repos(requests: DataFrame, repos: DataFrame, name: str = "repo") -> DataFrame:
    """Add repo_id and known_repo to requests that name a repository."""
    dimension = repos.select(F.col("name").alias(name), F.col("id").alias("repo_id"))
    return requests.join(broadcast_if_small(dimension), name, "left").withColumn(
        "known_repo", F.col("repo_id").isNotNull()
    )


def require_repos(requests: DataFrame, repos: DataFrame, name: str = "repo") -> DataFrame:
    """Like `resolve_repos`, but an unknown name fails the job."""
    resolved = resolve_repos(requests, repos, name)
    failure = F.raise_error(F.concat(F.lit("unknown repo "), F.col(name)))
    return resolved.withColumn(
        "repo_id", F.when(F.col("known_repo"), F.col("repo_id")).otherwise(failure.cast("int"))
    ).drop("known_repo")


def needs_ingest(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """Repositories whose current head (id, current_head) is not fully indexed."""
    current = F.col("current_head")
    done = (current == F.col("head_sha")) & (current == F.col("indexed_through_sha"))
    return repos.join(heads, "id").where(~F.coalesce(done, F.lit(False)))


def normalize(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Add slug (NULL when malformed), owner and short name."""
    slug = X.normalize_slug(raw)
    return requests.withColumn("slug", slug).select(
        "*", X.owner_of("slug").alias("owner"), X.repo_short("slug").alias("short_name")
    )


def over_cap(commits: DataFrame, cap: int = C.MAX_HISTORY_COMMITS) -> DataFrame:
    """Repositories with a longer history than the cap."""
    return (
        commits.groupBy("repo_id")
        .agg(F.count(F.lit(1)).alias("commits"))
        .where(F.col("commits") > cap)
    )
