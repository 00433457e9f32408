"""The given tables in the roles of the domain tables.

Spark expressions and the SQL fragments of the oracles stand side by side.
Every adapter is a projection of whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore.operators import lexical, threads
from changelore.operators import lexical_index as lexical_indexes
from changelore.operators import vector_index as vector_indexes
from changelore.operators.lexical_index import LexicalIndex
from changelore.operators.vector_index import VectorIndex
from changelore.runtime import checkpoint_dir, spread

T = TypeVar("T")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


# --------------------------------------------------------------- commits, changes

MESSAGE = """CASE
  WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0
    THEN 'Merge pull request #' || CAST(o_custkey AS {text}) || ' from ' || o_orderpriority
  WHEN o_orderstatus = 'P' THEN 'Revert order ' || CAST(o_orderkey AS {text})
  WHEN o_orderpriority = '1-URGENT'
    THEN 'Fix order ' || CAST(o_orderkey AS {text}) || ' (#' || CAST(o_custkey AS {text}) || ')'
  WHEN o_orderpriority = '2-HIGH'
    THEN 'Explain order ' || CAST(o_orderkey AS {text}) || {newline} || {newline}
      || 'The total of ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS {text})
      || ' was reviewed because the customer asked.'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'Update order ' || CAST(o_orderkey AS {text})
  ELSE 'tidy ' || CAST(o_orderkey AS {text})
END"""

COMMITS_SQL = f"""commits AS (
  SELECT CAST(o_orderkey % 25 AS INTEGER) AS repo_id,
    md5(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderkey AS ord,
    'Customer#' || CAST(o_custkey AS VARCHAR) AS author_name, o_orderdate AS committed_at,
    o_custkey, o_totalprice,
    split_part(message, chr(10), 1) AS subject, message AS body
  FROM (SELECT *, {MESSAGE.format(text="VARCHAR", newline="chr(10)")} AS message FROM orders)
)"""


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """orders as commits; repo = key mod 25, hash = md5 of the key."""
    message = F.expr(MESSAGE.format(text="STRING", newline="char(10)"))
    return (
        table(spark, folder, "orders")
        .withColumn("message", message)
        .select(
            (F.col("o_orderkey") % 25).cast("int").alias("repo_id"),
            F.md5(F.col("o_orderkey").cast("string")).alias("sha"),
            F.col("o_orderkey").alias("ord"),
            F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("author_name"),
            F.col("o_orderdate").cast("timestamp").alias("committed_at"),
            "o_custkey",
            "o_totalprice",
            F.split_part("message", F.lit("\n"), F.lit(1)).alias("subject"),
            F.col("message").alias("body"),
        )
    )


EXTENSION = (
    "CASE {key} % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' "
    "WHEN 3 THEN '.py' ELSE '.jsx' END"
)
PATH = "'src/m' || CAST({key} % 40 AS {text}) || '/p' || CAST({key} AS {text}) || " + EXTENSION
OLD_PATH = "'src/m' || CAST({key} % 40 AS {text}) || '/old' || CAST({key} AS {text}) || " + EXTENSION
STATUS = (
    "CASE WHEN l_returnflag = 'A' THEN 'added' WHEN l_returnflag = 'R' AND l_linestatus = 'F' "
    "THEN 'deleted' WHEN l_returnflag = 'R' THEN 'renamed' ELSE 'modified' END"
)


def path_sql(key: str) -> str:
    return PATH.format(key=key, text="VARCHAR")


def path_of(key: str) -> str:
    return PATH.format(key=key, text="STRING")


CHANGES_SQL = f"""changes AS (
  SELECT CAST(l_orderkey % 25 AS INTEGER) AS repo_id, md5(CAST(l_orderkey AS VARCHAR)) AS sha,
    l_orderkey AS ord, {path_sql("l_partkey")} AS path, {STATUS} AS status,
    CASE WHEN {STATUS} = 'renamed' THEN {OLD_PATH.format(key="l_partkey", text="VARCHAR")} END AS old_path,
    CAST(l_quantity AS INTEGER) AS additions, l_linenumber AS deletions
  FROM lineitem
)"""


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as file changes; part = path, return flag and line status = status."""
    return (
        table(spark, folder, "lineitem")
        .withColumn("status", F.expr(STATUS))
        .select(
            (F.col("l_orderkey") % 25).cast("int").alias("repo_id"),
            F.md5(F.col("l_orderkey").cast("string")).alias("sha"),
            F.col("l_orderkey").alias("ord"),
            F.expr(path_of("l_partkey")).alias("path"),
            "status",
            F.when(
                F.col("status") == "renamed",
                F.expr(OLD_PATH.format(key="l_partkey", text="STRING")),
            ).alias("old_path"),
            F.col("l_quantity").cast("int").alias("additions"),
            F.col("l_linenumber").alias("deletions"),
        )
    )


def repos(spark: SparkSession, folder: str) -> DataFrame:
    """nation as repositories; two in three are indexed through their head."""
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("id"),
        F.concat(F.lit("owner"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name").alias("name"),
        F.md5("n_name").alias("head_sha"),
        F.when(F.col("n_nationkey") % 3 != 0, F.md5("n_name")).alias("indexed_through_sha"),
    )


REPOS_SQL = """repos AS (
  SELECT n_nationkey AS id, 'owner' || CAST(n_regionkey AS VARCHAR) || '/' || n_name AS name,
    md5(n_name) AS head_sha,
    CASE WHEN n_nationkey % 3 != 0 THEN md5(n_name) END AS indexed_through_sha
  FROM nation
)"""


# --------------------------------------------------------------- patches

# The kind of change that a document stands for, by its id.
PATCH_KINDS = 6
COMMENTED = "'// ' || x"


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """documents as file patches: six documents make a commit, each with its kind of change.

    Kind 0 doubles blanks, 1 adds comment lines, 2 changes words, 3 renames
    without a text change, 4 is unreadable, 5 swaps the order of two words.  The
    kind follows the commit, so whole commits are noise; the last document of
    every fifth commit changes words.
    """
    docs = documents(spark, folder)
    commit = F.floor(F.col("doc_id") / 6)
    kind = F.when((F.col("doc_id") % 6 == 5) & (commit % 5 == 0), 2).otherwise(commit % PATCH_KINDS)
    lines = F.split("text", "\n")
    minus = F.transform(lines, lambda x: F.concat(F.lit("-"), x))

    def plus(change: Callable[[Column], Column]) -> Column:
        return F.transform(lines, lambda x: F.concat(F.lit("+"), change(x)))

    body = (
        F.when(F.col("kind") == 0, F.concat(minus, plus(lambda x: F.replace(x, F.lit(" "), F.lit("  ")))))
        .when(F.col("kind") == 1, plus(lambda x: F.concat(F.lit("// "), x)))
        .when(F.col("kind") == 2, F.concat(minus, plus(lambda x: F.concat(x, F.lit(" more")))))
        .when(F.col("kind") == 5, F.concat(minus, plus(lambda x: F.concat(F.lit("x "), x))))
        .otherwise(F.array().cast("array<string>"))
    )
    header = F.array(
        F.lit("diff --git a b"), F.lit("--- a"), F.lit("+++ b"), F.lit("@@ -1 +1 @@")
    )
    patch = F.when(F.col("kind") != 4, F.array_join(F.concat(header, body), "\n"))
    return (
        docs.withColumn("kind", kind)
        .withColumn("commit", commit)
        .select(
            F.lit(0).alias("repo_id"),
            F.md5(F.col("commit").cast("string")).alias("sha"),
            F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"),
            F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("old_path"),
            F.when(F.col("kind") == 3, "renamed").otherwise("modified").alias("status"),
            patch.alias("patch"),
        )
    )


# Per document: the same counters from the kind and the text, without a patch.
FILE_FEATURES_SQL = """kinds AS (
  SELECT *, doc_id // 6 AS commit_no,
    CASE WHEN doc_id % 6 = 5 AND (doc_id // 6) % 5 = 0 THEN 2 ELSE (doc_id // 6) % 6 END AS kind,
    len(string_split(text, chr(10))) AS n_lines,
    len([x for x in string_split(text, chr(10)) if trim(x) != '']) AS n_full
  FROM documents
), per_file AS (
  SELECT md5(CAST(commit_no AS VARCHAR)) AS sha, doc_id, kind,
    CASE WHEN kind IN (0, 1, 2, 5) THEN n_lines ELSE 0 END AS additions,
    CASE WHEN kind IN (0, 2, 5) THEN n_lines ELSE 0 END AS deletions,
    kind = 4 AS unreadable, kind = 3 AS renamed, kind != 3 AS text_changed,
    kind IN (0, 3) AS same_words, kind IN (1, 2, 5) OR (kind = 0 AND n_full > 0) AS has_nonblank,
    kind IN (1, 3) OR (kind IN (0, 2) AND len([x for x in string_split(text, chr(10)) if
      (kind = 2 OR trim(x) != '') AND NOT regexp_matches(trim(x), '^(//|/[*]|[*]|#|<!--|%|;|--)')]) = 0)
      AS all_comments
  FROM kinds
), features AS (
  SELECT 0 AS repo_id, sha, COUNT(*) AS files_changed, CAST(SUM(additions) AS BIGINT) AS additions,
    CAST(SUM(deletions) AS BIGINT) AS deletions, COUNT(*) FILTER (unreadable) AS binary_files,
    COUNT(*) FILTER (renamed) AS renamed_files,
    bool_or(text_changed) AND bool_and(same_words) AS whitespace_only,
    bool_or(text_changed) AND NOT bool_and(same_words) AND bool_or(has_nonblank)
      AND bool_and(all_comments) AS comment_only,
    COUNT(*) FILTER (renamed) = COUNT(*) AND NOT bool_or(unreadable) AND NOT bool_or(text_changed)
      AS pure_rename,
    bool_or(unreadable) AS degraded
  FROM per_file GROUP BY sha
)"""

FLOOR_CASE = """CASE WHEN pure_rename THEN 'significant'
    WHEN whitespace_only THEN 'insignificant_whitespace'
    WHEN comment_only THEN 'insignificant_comment' ELSE 'significant' END"""


def simple_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A label per commit from its price: a third is noise, some have no label."""
    price = F.floor("o_totalprice").cast("long")
    return (
        commits(spark, folder)
        .where(price % 7 != 0)
        .select(
            "repo_id",
            "sha",
            F.when(price % 3 == 0, "insignificant_whitespace")
            .when(price % 11 == 0, "insignificant_comment")
            .otherwise("significant")
            .alias("label"),
        )
    )


SIMPLE_LABELS_SQL = """simple_labels AS (
  SELECT repo_id, sha,
    CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 3 = 0 THEN 'insignificant_whitespace'
      WHEN CAST(floor(o_totalprice) AS BIGINT) % 11 = 0 THEN 'insignificant_comment'
      ELSE 'significant' END AS label
  FROM commits WHERE CAST(floor(o_totalprice) AS BIGINT) % 7 != 0
)"""


# --------------------------------------------------------------- merge requests


def pull_requests(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as merge requests: first turn = body, all turns = discussion."""
    turns = table(spark, folder, "conversations")
    heads = turns.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("body"),
        F.min_by("role", "turn").alias("author"),
        F.count(F.lit(1)).cast("int").alias("comment_count"),
    )
    talk = threads.discussions(
        turns.withColumnRenamed("role", "author").withColumnRenamed("text", "body"), ["conv_id"], "turn"
    )
    return heads.join(talk, "conv_id", "left").select(
        (F.col("conv_id") % 25).cast("int").alias("repo_id"),
        F.col("conv_id").alias("number"),
        F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"),
        "body",
        "author",
        F.lit("MERGED").alias("state"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(CAST(conv_id % 1000 AS INT))").alias("merged_at"),
        F.md5(F.col("conv_id").cast("string")).alias("merge_sha"),
        "comment_count",
        "discussion",
    )


DISCUSSIONS_SQL = r"""talks AS (
  SELECT conv_id, string_agg(role || ': ' || text, chr(10) || '---' || chr(10) ORDER BY turn) AS discussion
  FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) != '' GROUP BY conv_id
)"""

PRS_SQL = f"""{DISCUSSIONS_SQL}, prs AS (
  SELECT CAST(h.conv_id % 25 AS INTEGER) AS repo_id, h.conv_id AS number,
    'Talk ' || CAST(h.conv_id AS VARCHAR) AS title, h.body, h.author, h.comment_count,
    md5(CAST(h.conv_id AS VARCHAR)) AS merge_sha,
    TIMESTAMP '2024-01-01' + to_days(CAST(h.conv_id % 1000 AS INTEGER)) AS merged_at, t.discussion
  FROM (SELECT conv_id, arg_min(text, turn) AS body, arg_min(role, turn) AS author,
      CAST(COUNT(*) AS INTEGER) AS comment_count FROM conversations GROUP BY conv_id) h
  LEFT JOIN talks t USING (conv_id)
)"""


# --------------------------------------------------------------- retrieval


def doc_chunks(spark: SparkSession, folder: str, stemmed: bool = False) -> DataFrame:
    """documents with their vectors as chunks; source = repository, language = source type.

    Only some documents have a vector.
    """
    docs = documents(spark, folder)
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    return docs.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.expr("CAST(substring(source, 4) AS INT)").alias("repo_id"),
        lexical.tokens("text", stemmed).alias("tokens"),
        "embedding",
        ((F.col("doc_id") % 10) / 10.0).alias("liveness_score"),
    )


def doc_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """What hits show of the documents, and their vectors; the texts are not read."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.expr("CAST(substring(source, 4) AS INT)").alias("repo_id"),
        "embedding",
        ((F.col("doc_id") % 10) / 10.0).alias("liveness_score"),
    )


_BUILT: dict[tuple, object] = {}


def _stored(spark: SparkSession, folder: str, name: str, kind: str, build: Callable[[str], T]) -> T:
    """An index over the files of a given table, built once for the session and this state of the files."""
    files = table(spark, folder, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    state = sorted(map(str, files.distinct().collect()))  # a row per file
    key = (spark.sparkContext.applicationId, kind, *state)
    if key not in _BUILT:
        _BUILT[key] = build(f"{checkpoint_dir(spark)}/index/{uuid.uuid4().hex}")
    return _BUILT[key]


def lexical_index(spark: SparkSession, folder: str, stemmed: bool = False) -> LexicalIndex:
    """The documents' postings."""

    def build(path: str) -> LexicalIndex:
        index = lexical_indexes.open_index(spark, path, buckets=_buckets(spark))
        lexical_indexes.add(index, doc_chunks(spark, folder, stemmed), batch=0)
        return index

    return _stored(spark, folder, "documents", f"lexical {stemmed}", build)


def vector_index(spark: SparkSession, folder: str, bits: int) -> VectorIndex:
    """The given vectors' patterns and codes, calibrated on a sample of them."""

    def build(path: str) -> VectorIndex:
        index = vector_indexes.open_index(spark, path, bits=bits, buckets=_buckets(spark))
        rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
        vector_indexes.add(index, rows, batch=0)
        return vector_indexes.calibrate(index)

    return _stored(spark, folder, "embeddings", f"vectors {bits}", build)


def _buckets(spark: SparkSession) -> int:
    return max(8, spark.sparkContext.defaultParallelism)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """benchmark passages as questions, with the vector of the same id."""
    items = table(spark, folder, "benchmark")
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
    )
    return items.join(vectors, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), "vector"
    )


def sql_list(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)
