"""Landed merge-request pages and their upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import constants as C
from changelore import schemas
from changelore.functions import text as X

PR_KEY = ["repo_id", "number"]


def read_pr_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed pages, one per line (`multi_line`: one per file, in any layout)."""
    reader = spark.read.schema(schemas.PR_PAGE).option("multiLine", multi_line)
    return parse_pr_pages(reader.json(path))


def _cut(value: Column, chars: int | None) -> Column:
    return value if chars is None else X.cut(value, chars)


def comment_text(author: Column, body: Column, chars: int | None = None) -> Column:
    """`author: body`, the body whole or its first `chars`; NULL for a blank body."""
    cut = _cut(body, chars)
    who = F.coalesce(X.none_if_empty(author), F.lit("unknown"))
    return F.when(~X.is_blank(cut), F.concat(who, F.lit(": "), cut))


def join_comments(parts: Column, chars: int | None = None) -> Column:
    """Ordered comment texts to one discussion text, NULL when nothing is left."""
    present = F.filter(parts, lambda p: p.isNotNull())
    return X.none_if_empty(_cut(F.array_join(present, C.COMMENT_SEPARATOR), chars))


def parse_pr_pages(
    pages: DataFrame,
    *keep: str,
    comment_chars: int | None = None,
    discussion_chars: int | None = None,
    body_chars: int | None = None,
) -> DataFrame:
    """One row per merge request of every page; a page holds a bounded number of both.

    Comments, discussions and bodies are whole; limits are for callers that want prefixes (the constants
    `MAX_COMMENT`, `MAX_DISCUSSION`, `MAX_PR_BODY`).
    """
    node = pages.select(
        *keep, F.explode("data.repository.pullRequests.nodes").alias("n")
    )
    comments = F.transform(
        F.col("n.comments.nodes"),
        lambda c: comment_text(c["author"]["login"], F.coalesce(c["body"], F.lit("")), comment_chars),
    )
    return node.select(
        *keep,
        F.col("n.number").alias("number"),
        F.col("n.title").alias("title"),
        X.none_if_empty(_cut(F.col("n.body"), body_chars)).alias("body"),
        F.col("n.author.login").alias("author"),
        F.lit("MERGED").alias("state"),
        X.iso_to_timestamp("n.createdAt").alias("created_at"),
        X.iso_to_timestamp("n.mergedAt").alias("merged_at"),
        F.col("n.mergeCommit.oid").alias("merge_sha"),
        F.col("n.comments.totalCount").alias("comment_count"),
        join_comments(comments, discussion_chars).alias("discussion"),
    )


def page_info(pages: DataFrame) -> DataFrame:
    """Cursor, last-page flag and remaining rate of every landed page."""
    info = F.col("data.repository.pullRequests.pageInfo")
    return pages.select(
        info["endCursor"].alias("end_cursor"),
        F.coalesce(info["hasNextPage"], F.lit(False)).alias("has_next"),
        F.col("data.rateLimit.remaining").alias("rate_remaining"),
        F.size("data.repository.pullRequests.nodes").alias("fetched"),
    )


def first_per_key(incoming: DataFrame) -> DataFrame:
    """One row per merge request: the first with a discussion, else the first.

    `min_by` combines on the map side, so a key repeated across many pages does
    not gather in one task.
    """
    others = [c for c in incoming.columns if c not in PR_KEY]
    order = F.struct(F.col("discussion").isNull(), F.col("created_at"), F.xxhash64(*others))
    best = incoming.groupBy(*PR_KEY).agg(F.min_by(F.struct(*others), order).alias("r"))
    return best.select(*PR_KEY, "r.*")


def upsert_prs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows win; only a missing discussion is filled; new keys are added."""
    new = first_per_key(incoming)
    columns = stored.columns
    old = stored.select(*PR_KEY, F.struct(*columns).alias("o"))
    both = old.join(new.select(*PR_KEY, F.struct(*columns).alias("n")), PR_KEY, "full_outer")
    picked = []
    for c in columns:
        if c in PR_KEY:
            picked.append(F.col(c))
        elif c == "discussion":
            picked.append(F.coalesce(F.col("o.discussion"), F.col("n.discussion")).alias(c))
        else:
            picked.append(
                F.when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            )
    return both.select(*picked)


def pr_links(prs: DataFrame) -> DataFrame:
    return prs.where(F.col("merge_sha").isNotNull()).select(
        "repo_id", F.col("merge_sha").alias("sha"), F.col("number").alias("pr_number")
    )


def new_links(stored: DataFrame, prs: DataFrame) -> DataFrame:
    key = ["repo_id", "sha", "pr_number"]
    return pr_links(prs).dropDuplicates(key).join(stored.select(*key), key, "left_anti")

