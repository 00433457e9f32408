"""Table schemas as DDL text, given to every reader so that nothing is inferred."""

from __future__ import annotations

import re


def fields(ddl: str) -> list[str]:
    """Top-level column names of a schema text."""
    flat = ddl
    while "<" in flat:
        flat = re.sub(r"<[^<>]*>", "", flat)
    return [part.split()[0] for part in flat.split(",")]


REPOS = (
    "id INT, name STRING, url STRING, default_branch STRING, head_sha STRING, "
    "indexed_through_sha STRING, created_at TIMESTAMP"
)
COMMITS = (
    "repo_id INT, sha STRING, author_name STRING, author_email STRING, committer_name STRING, "
    "committer_email STRING, authored_at TIMESTAMP, committed_at TIMESTAMP, subject STRING, "
    "body STRING"
)
COMMIT_LOG = (
    "repo_id INT, sha STRING, author_name STRING, author_email STRING, committer_name STRING, "
    "committer_email STRING, author_time BIGINT, commit_time BIGINT, message STRING, "
    "parents ARRAY<STRING>, files ARRAY<STRUCT<status: STRING, path: STRING, old_path: STRING, "
    "additions: INT, deletions: INT>>"
)
COMMIT_PARENTS = (
    "repo_id INT, child_sha STRING, parent_sha STRING, position INT"
)
FILE_CHANGES = (
    "repo_id INT, sha STRING, seq INT, status STRING, path STRING, old_path STRING, "
    "additions INT, deletions INT"
)
PATCHES = (
    "repo_id INT, sha STRING, path STRING, old_path STRING, status STRING, patch STRING"
)
BLOBS = (
    "repo_id INT, sha STRING, path STRING, status STRING, old_text STRING, new_text STRING"
)
HUNKS = (
    "repo_id INT, sha STRING, path STRING, old_path STRING, ord BIGINT, old_start INT, "
    "old_len INT, new_start INT, new_len INT"
)
PULL_REQUESTS = (
    "repo_id INT, number BIGINT, title STRING, body STRING, author STRING, state STRING, "
    "created_at TIMESTAMP, merged_at TIMESTAMP, merge_sha STRING, comment_count INT, "
    "discussion STRING"
)
COMMIT_PR_LINKS = ("repo_id INT, sha STRING, pr_number BIGINT")
# A chunk shows five paths and counts the rest; the full relation is the
# (chunk, path) table of `chunks.chunk_files`.
CHUNKS = (
    "repo_id INT, source_type STRING, source_id STRING, authored_at TIMESTAMP, title STRING, "
    "body STRING, embedding ARRAY<FLOAT>, tokens ARRAY<STRING>, files_head ARRAY<STRING>, "
    "n_files INT, linked_sha STRING, liveness_score DOUBLE, embedding_model STRING"
)
TRACES = (
    "stage STRING, model STRING, prompt STRING, response STRING, latency_ms INT, "
    "prompt_tokens INT, completion_tokens INT, eval_case_id STRING, repo_id INT, "
    "extra STRING, created_at TIMESTAMP"
)
CASES = (
    "id STRING, path STRING, kind STRING, repo STRING, symbol STRING, file STRING, "
    "query STRING, top_k INT, expected_sha STRING, expected_shas ARRAY<STRING>, "
    "expect_status STRING, expect STRING, expected_citations ARRAY<STRING>, note STRING"
)
PR_PAGE = (
    "data STRUCT<repository: STRUCT<pullRequests: STRUCT<"
    "pageInfo: STRUCT<hasNextPage: BOOLEAN, endCursor: STRING>, "
    "nodes: ARRAY<STRUCT<number: BIGINT, title: STRING, body: STRING, state: STRING, "
    "createdAt: STRING, mergedAt: STRING, author: STRUCT<login: STRING>, "
    "mergeCommit: STRUCT<oid: STRING>, comments: STRUCT<totalCount: INT, "
    "nodes: ARRAY<STRUCT<author: STRUCT<login: STRING>, body: STRING, createdAt: STRING>>>>>>>, "
    "rateLimit: STRUCT<remaining: INT, resetAt: STRING>>"
)
