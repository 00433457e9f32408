"""Features, labels, snapshots, incremental loads, repository status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.operators import catalog, export, features, graph, labels, snapshot, stats
from changelore.plans import adapters as A
from changelore.plans.registry import query
from changelore.runtime import spread
from changelore.sources import history, merge_requests, sinks

# ------------------------------------------------------------------ scans


def commit_log(spark: SparkSession, folder: str) -> DataFrame:
    """orders as nested log records; the half and the third of a key are its parents."""
    key = F.col("o_orderkey")
    parents = F.filter(
        F.array(F.floor(key / 2), F.floor(key / 3)), lambda p: p != key
    )
    return A.table(spark, folder, "orders").select(
        F.lit(0).alias("repo_id"),
        F.md5(key.cast("string")).alias("sha"),
        F.lit("a").alias("author_name"),
        F.lit(None).cast("string").alias("author_email"),
        F.lit("c").alias("committer_name"),
        F.lit(None).cast("string").alias("committer_email"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("author_time"),
        F.when(key % 100 == 0, 0).otherwise(
            F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
        ).alias("commit_time"),
        F.expr(A.MESSAGE.format(text="STRING", newline="char(10)")).alias("message"),
        F.transform(parents, lambda p: F.md5(p.cast("string"))).alias("parents"),
        F.transform(
            F.split("o_orderpriority", "-"),
            lambda w, i: F.struct(
                F.lit("modified").alias("status"),
                w.alias("path"),
                F.lit(None).cast("string").alias("old_path"),
                i.alias("additions"),
                F.char_length(w).alias("deletions"),
            ),
        ).alias("files"),
    )


@query(
    "commit_scan",
    f"""WITH {A.COMMITS_SQL}
    SELECT md5(CAST(ord AS VARCHAR)) AS sha, subject, body,
      CASE WHEN ord % 100 != 0 THEN strftime(committed_at, '%Y-%m-%d %H:%M:%S') END AS committed_at
    FROM commits""",
)
def commit_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = history.commits(commit_log(spark, folder))
    return rows.select(
        "sha", "subject", "body", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at")
    )


@query(
    "parent_edges",
    """WITH e AS (
      SELECT o_orderkey AS k, o_orderkey // 2 AS a, o_orderkey // 3 AS b FROM orders)
    SELECT md5(CAST(k AS VARCHAR)) AS child_sha, md5(CAST(a AS VARCHAR)) AS parent_sha, 0 AS position
    FROM e WHERE k != 0
    UNION ALL
    SELECT md5(CAST(k AS VARCHAR)), md5(CAST(b AS VARCHAR)), 1 FROM e WHERE k != 0""",
)
def parent_edges(spark: SparkSession, folder: str) -> DataFrame:
    return history.explode_parents(commit_log(spark, folder)).drop("repo_id")


@query(
    "first_parents",
    """SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, md5(CAST(o_orderkey // 2 AS VARCHAR)) AS parent_sha
    FROM orders WHERE o_orderkey != 0""",
)
def first_parents(spark: SparkSession, folder: str) -> DataFrame:
    return features.first_parent(history.explode_parents(commit_log(spark, folder))).drop("repo_id")


@query(
    "change_scan",
    """SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, CAST(i - 1 AS INTEGER) AS seq,
      string_split(o_orderpriority, '-')[i] AS path, CAST(i - 1 AS INTEGER) AS additions,
      CAST(length(string_split(o_orderpriority, '-')[i]) AS INTEGER) AS deletions
    FROM orders, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)) AS t(i)""",
)
def change_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = history.explode_changes(commit_log(spark, folder))
    return rows.select("sha", "seq", "path", "additions", "deletions")


@query(
    "git_log_records",
    """SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS authored_at,
      o_orderpriority AS subject
    FROM orders WHERE o_orderstatus != 'P'""",
)
def git_log_records(spark: SparkSession, folder: str) -> DataFrame:
    """Delimited records; those of status P have a field too many and are dropped."""
    key = F.md5(F.col("o_orderkey").cast("string"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    extra = F.when(F.col("o_orderstatus") == "P", F.lit("extra"))
    record = F.concat(F.lit("\n"), F.concat_ws("\x1f", key, stamp, "o_orderpriority", extra))
    rows = history.parse_git_log(A.table(spark, folder, "orders").select(record.alias("value")), "value")
    return rows.withColumn("authored_at", F.date_format("authored_at", "yyyy-MM-dd HH:mm:ss"))


# ------------------------------------------------------------------ features and labels


@query(
    "file_features",
    f"""WITH {A.FILE_FEATURES_SQL}
    SELECT 'src/d' || CAST(doc_id AS VARCHAR) || '.js' AS path,
      CASE WHEN unreadable THEN 'unreadable' WHEN renamed THEN 'renamed' ELSE 'modified' END AS status,
      CAST(additions AS INTEGER) AS additions, CAST(deletions AS INTEGER) AS deletions,
      text_changed, same_words AND NOT unreadable AS same_words, has_nonblank, all_comments
    FROM per_file""",
)
def file_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.file_features(A.patches(spark, folder))
    return rows.select(
        "path", "status", "additions", "deletions", "text_changed", "same_words", "has_nonblank", "all_comments"
    )


@query(
    "commit_features",
    f"""WITH {A.FILE_FEATURES_SQL}
    SELECT sha, files_changed, additions, deletions, binary_files, renamed_files,
      whitespace_only, comment_only, pure_rename,
      CASE WHEN degraded THEN 'v1.floor+degraded' ELSE 'v1.floor' END AS extractor_version
    FROM features""",
)
def commit_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).drop("repo_id")


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return features.commit_features(features.file_features(A.patches(spark, folder)))


@query(
    "floor_labels",
    f"""WITH {A.FILE_FEATURES_SQL}
    SELECT sha, {A.FLOOR_CASE} AS label, 'floor.v1' AS rule_version FROM features""",
)
def floor_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.floor_labels(_features(spark, folder)).drop("repo_id")


# Code of a line item before and after, by line number: 1 layout, 2 quotes,
# 3 comment, 4 semicolons, 5 operator, 6 identifier, 7 text of a string.
OLD_CODE = """'function f' || CAST(l_partkey AS {text}) || '(a, b) {{' || {nl} || '  const t = ''x y'';' || {nl}
  || '  return a + b; // total ' || CAST(l_suppkey AS {text}) || {nl} || '}}' || {nl}"""
NEW_CODE = {
    1: ("  return a + b", "\treturn  a +\n b"),
    2: ("'x y'", '"x y"'),
    3: ("// total", "/* it's */ // sum"),
    4: (";", ""),
    5: ("a + b", "a - b"),
    6: ("const t", "const u"),
    7: ("x y", "x  y"),
}


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as modified files with old and new text."""
    old = F.expr(OLD_CODE.format(text="STRING", nl="char(10)"))
    new = old
    for number, (before, after) in NEW_CODE.items():
        new = F.when(F.col("l_linenumber") == number, F.replace(old, F.lit(before), F.lit(after))).otherwise(new)
    return spread(A.table(spark, folder, "lineitem"), "l_orderkey").select(
        F.lit(0).alias("repo_id"),
        F.md5(F.col("l_orderkey").cast("string")).alias("sha"),
        F.expr(A.path_of("l_partkey")).alias("path"),
        F.when(F.col("l_returnflag") == "A", "added").otherwise("modified").alias("status"),
        old.alias("old_text"),
        new.alias("new_text"),
    )


FORMAT_SQL = f"""judged AS (
  SELECT md5(CAST(l_orderkey AS VARCHAR)) AS sha, {A.path_sql("l_partkey")} AS path,
    l_linenumber <= 4 AS format_only
  FROM lineitem WHERE l_returnflag != 'A' AND l_partkey % 5 IN (0, 1, 4)
), verdicts AS (SELECT sha, bool_and(format_only) AS ast_format_only FROM judged GROUP BY sha)"""


@query(
    "format_verdicts",
    f"""WITH {FORMAT_SQL} SELECT sha, path, format_only, COUNT(*) AS n FROM judged GROUP BY ALL""",
)
def format_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.format_verdicts(blobs(spark, folder))
    return rows.groupBy("sha", "path", "format_only").agg(F.count(F.lit(1)).alias("n"))


@query("format_only_commits", f"""WITH {FORMAT_SQL} SELECT sha, ast_format_only FROM verdicts""")
def format_only_commits(spark: SparkSession, folder: str) -> DataFrame:
    return features.format_only(blobs(spark, folder)).drop("repo_id")


# Features of orders from their line items, for relabelling.
ORDER_FEATURES_SQL = f"""{FORMAT_SQL}, rolled AS (
  SELECT md5(CAST(l_orderkey AS VARCHAR)) AS sha,
    bool_and(l_returnflag = 'R') AND bool_and(l_linestatus = 'O') AS pure_rename,
    bool_and(l_quantity < 25) AS whitespace_only,
    bool_and(l_discount < 0.05) AND NOT bool_and(l_quantity < 25) AS comment_only
  FROM lineitem GROUP BY l_orderkey
), judged_features AS (
  SELECT r.*, v.ast_format_only FROM rolled r LEFT JOIN verdicts v USING (sha)
), labelled AS (
  SELECT sha, {A.FLOOR_CASE} AS old_label,
    CASE WHEN {A.FLOOR_CASE} = 'significant' AND coalesce(ast_format_only, false)
      THEN 'insignificant_format' ELSE {A.FLOOR_CASE} END AS label
  FROM judged_features
)"""


def order_features(spark: SparkSession, folder: str) -> DataFrame:
    small = F.bool_and(F.col("l_quantity") < 25)
    return (
        A.table(spark, folder, "lineitem")
        .groupBy(F.lit(0).alias("repo_id"), F.md5(F.col("l_orderkey").cast("string")).alias("sha"))
        .agg(
            (F.bool_and(F.col("l_returnflag") == "R") & F.bool_and(F.col("l_linestatus") == "O")).alias("pure_rename"),
            small.alias("whitespace_only"),
            (F.bool_and(F.col("l_discount") < 0.05) & ~small).alias("comment_only"),
        )
        .withColumn("ast_format_only", F.lit(None).cast("boolean"))
        .withColumn("ast_extractor_version", F.lit(None).cast("string"))
    )


@query(
    "layered_labels",
    f"""WITH {ORDER_FEATURES_SQL} SELECT sha, label, 'floor.v1+ast-js.v1' AS rule_version FROM labelled""",
)
def layered_labels(spark: SparkSession, folder: str) -> DataFrame:
    judged = labels.backfill(order_features(spark, folder), features.format_only(blobs(spark, folder)))
    return labels.relabel(judged).drop("repo_id")


@query(
    "relabel_stats",
    f"""WITH {ORDER_FEATURES_SQL}
    SELECT label, COUNT(*) AS commits, COUNT(*) FILTER (label != old_label) AS relabeled
    FROM labelled GROUP BY label""",
)
def relabel_stats(spark: SparkSession, folder: str) -> DataFrame:
    before = order_features(spark, folder)
    after = labels.backfill(before, features.format_only(blobs(spark, folder)))
    return labels.relabel_stats(labels.floor_labels(before), labels.relabel(after)).drop("repo_id")


@query(
    "recompute_degraded",
    f"""WITH {A.FILE_FEATURES_SQL}, sizes AS (
      SELECT md5(CAST(doc_id // 6 AS VARCHAR)) AS sha,
        SUM(len(string_split(text, chr(10)))) FILTER (doc_id % 7 != 0) AS readable_lines,
        COUNT(*) FILTER (doc_id % 7 = 0) AS unreadable
      FROM documents GROUP BY ALL)
    SELECT f.sha, CASE WHEN degraded THEN CAST(coalesce(s.readable_lines, 0) AS BIGINT) ELSE additions END AS additions,
      CASE WHEN degraded THEN s.unreadable ELSE f.binary_files END AS binary_files,
      CASE WHEN degraded AND s.unreadable > 0 THEN 'v1.floor+degraded' ELSE 'v1.floor' END AS extractor_version
    FROM features f JOIN sizes s USING (sha)""",
)
def recompute_degraded(spark: SparkSession, folder: str) -> DataFrame:
    """Re-read every patch as plain additions; every seventh document stays unreadable."""
    added = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x)), "\n")
    again = A.documents(spark, folder).select(
        F.lit(0).alias("repo_id"),
        F.md5(F.floor(F.col("doc_id") / 6).cast("string")).alias("sha"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
        F.lit(None).cast("string").alias("old_path"),
        F.lit("added").alias("status"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("@@ -0,0 +1 @@\n"), added)).alias("patch"),
    )
    redone = features.recompute_degraded(_features(spark, folder), again)
    return redone.select("sha", "additions", "binary_files", "extractor_version")


@query(
    "degraded_counts",
    f"""WITH {A.FILE_FEATURES_SQL}
    SELECT COUNT(*) AS recomputed, COUNT(*) FILTER (has_seventh) AS still_degraded
    FROM features JOIN (SELECT md5(CAST(doc_id // 6 AS VARCHAR)) AS sha, bool_or(doc_id % 7 = 0) AS has_seventh
      FROM documents GROUP BY ALL) USING (sha)
    WHERE degraded""",
)
def degraded_counts(spark: SparkSession, folder: str) -> DataFrame:
    before = _features(spark, folder)
    plain = A.documents(spark, folder).select(
        F.lit(0).alias("repo_id"),
        F.md5(F.floor(F.col("doc_id") / 6).cast("string")).alias("sha"),
        F.lit("d").alias("path"),
        F.lit(None).cast("string").alias("old_path"),
        F.lit("added").alias("status"),
        F.when(F.col("doc_id") % 7 != 0, F.lit("+x")).alias("patch"),
    )
    after = features.recompute_degraded(before, plain)
    return features.degraded_counts(before, after).drop("repo_id")


@query(
    "comment_lines",
    """WITH l AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, COUNT(*) AS n_lines,
      COUNT(*) FILTER (regexp_matches(trim(line), '^(//|/[*]|[*]|#|<!--|%|;|--)')) AS code_comments,
      COUNT(*) FILTER (regexp_matches(trim(line), '^(//|/[*]|[*]|<!--|%|;|--)')) AS doc_comments
    FROM l GROUP BY doc_id""",
)
def comment_lines(spark: SparkSession, folder: str) -> DataFrame:
    from changelore.functions import text as X

    split = F.split("text", "\n")
    return A.documents(spark, folder).select(
        "doc_id",
        F.size(split).cast("long").alias("n_lines"),
        F.size(F.filter(split, lambda x: X.is_commentish(x, F.lit(".js")))).cast("long").alias("code_comments"),
        F.size(F.filter(split, lambda x: X.is_commentish(x, F.lit(".md")))).cast("long").alias("doc_comments"),
    )


@query(
    "detect_renames",
    r"""WITH RECURSIVE f AS (
      SELECT md5(lang) AS sha, doc_id, doc_id % 2 = 0 AS gone, text,
        list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_$]+')) AS words
      FROM documents
    ), numbered AS (
      SELECT *, 'd' || CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY sha, text, gone
        ORDER BY left(md5('d' || CAST(doc_id AS VARCHAR)), 2), 'd' || CAST(doc_id AS VARCHAR)) AS nth FROM f
    ), exact AS (
      SELECT a.sha, a.path AS old_path, b.path, a.doc_id AS old_id, b.doc_id AS new_id
      FROM numbered a JOIN numbered b ON a.sha = b.sha AND a.text = b.text AND a.nth = b.nth AND a.gone AND NOT b.gone
    ), dup AS (SELECT old_id AS doc_id FROM exact UNION ALL SELECT new_id FROM exact
    ), p AS (
      SELECT a.sha, a.doc_id AS old_id, b.doc_id AS new_id,
        len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) AS s
      FROM f a JOIN f b ON a.sha = b.sha AND a.gone AND NOT b.gone
      WHERE a.doc_id NOT IN (SELECT doc_id FROM dup) AND b.doc_id NOT IN (SELECT doc_id FROM dup)
        AND len(a.words) >= 0.5 * len(b.words) AND len(b.words) >= 0.5 * len(a.words)
    ), scored AS (SELECT *, 'd' || CAST(old_id AS VARCHAR) AS old_path, 'd' || CAST(new_id AS VARCHAR) AS path
      FROM p WHERE s >= 0.5
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY s DESC, old_path, path) AS n FROM scored
    ), greedy AS (
      SELECT sha, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS old_path, CAST(NULL AS VARCHAR) AS path, 0.0::DOUBLE AS s
      FROM (SELECT DISTINCT sha FROM ranked)
      UNION ALL
      SELECT r.sha, r.n,
        CASE WHEN list_contains(g.used, '-' || r.old_path) OR list_contains(g.used, '+' || r.path) THEN g.used
          ELSE list_concat(g.used, ['-' || r.old_path, '+' || r.path]) END,
        CASE WHEN list_contains(g.used, '-' || r.old_path) OR list_contains(g.used, '+' || r.path) THEN NULL ELSE r.old_path END,
        r.path, r.s
      FROM greedy g JOIN ranked r ON r.sha = g.sha AND r.n = g.n + 1)
    SELECT sha, old_path, path, round(s, 6) AS similarity FROM greedy WHERE old_path IS NOT NULL
    UNION ALL SELECT sha, old_path, path, 1.0 FROM exact""",
)
def detect_renames(spark: SparkSession, folder: str) -> DataFrame:
    """documents of a language as one commit: even ids deleted, odd ids added."""
    files = A.documents(spark, folder).select(
        F.lit(0).alias("repo_id"),
        F.md5("lang").alias("sha"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, "deleted").otherwise("added").alias("status"),
        "text",
    )
    pairs = features.detect_renames(files)
    return pairs.select(
        "sha", "old_path", "path", F.round("similarity", 6).alias("similarity")
    )


# ------------------------------------------------------------------ snapshot


@query(
    "head_paths",
    f"""WITH {A.COMMITS_SQL}, {A.CHANGES_SQL}, dated AS (
      SELECT c.*, m.committed_at FROM changes c JOIN commits m ON c.sha = m.sha
    ), ev AS (
      SELECT repo_id, path, committed_at, sha, 1 AS k, status != 'deleted' AS alive FROM dated
      UNION ALL
      SELECT repo_id, old_path, committed_at, sha, 0, false FROM dated WHERE status = 'renamed')
    SELECT repo_id, path FROM ev
    QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY committed_at DESC, sha DESC, k DESC, alive DESC) = 1
      AND alive""",
)
def head_paths(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.head_paths(A.changes(spark, folder), A.commits(spark, folder))


@query(
    "last_touched",
    f"""WITH {A.COMMITS_SQL}, {A.CHANGES_SQL}
    SELECT c.repo_id, c.path, strftime(MAX(m.committed_at), '%Y-%m-%d') AS last_touched
    FROM changes c JOIN commits m ON c.sha = m.sha GROUP BY ALL""",
)
def last_touched(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshot.last_touched(A.changes(spark, folder), A.commits(spark, folder))
    return rows.withColumn("last_touched", F.date_format("last_touched", "yyyy-MM-dd"))


LIVENESS_SQL = """touched AS (
  SELECT DISTINCT o_orderkey AS chunk_id, l_partkey AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
), scored AS (
  SELECT chunk_id, AVG(CASE WHEN p_size < 25 THEN 1.0 ELSE 0.0 END) AS s
  FROM touched LEFT JOIN part ON p_partkey = part GROUP BY chunk_id
)"""


@query(
    "stale_flags",
    f"""WITH {LIVENESS_SQL}
    SELECT chunk_id, round(s, 6) AS liveness_score, s < 0.34 AS stale FROM scored""",
)
def stale_flags(spark: SparkSession, folder: str) -> DataFrame:
    """orders as chunks, their parts as files; parts below size 25 exist at HEAD."""
    orders = A.table(spark, folder, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    items = A.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").cast("string").alias("path")
    )
    touched = orders.join(items.distinct(), "chunk_id", "left").withColumn("repo_id", F.lit(0))
    alive = (
        A.table(spark, folder, "part")
        .where(F.col("p_size") < 25)
        .select(F.lit(0).alias("repo_id"), F.col("p_partkey").cast("string").alias("path"))
    )
    scored = snapshot.liveness(touched, alive, ["chunk_id"])
    return snapshot.with_stale(scored).withColumn("liveness_score", F.round("liveness_score", 6))


# ------------------------------------------------------------------ incremental


@query(
    "incremental_anti",
    f"""WITH {A.COMMITS_SQL} SELECT repo_id, sha, subject FROM commits WHERE ord % 3 != 0""",
)
def incremental_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Every third commit is stored already; the batch repeats each commit."""
    batch = A.commits(spark, folder)
    stored = batch.where(F.col("ord") % 3 == 0)
    fresh = sinks.fresh_rows(stored, batch.unionByName(batch), ["repo_id", "sha"])
    return fresh.select("repo_id", "sha", "subject")


@query(
    "fresh_children",
    f"""WITH {A.CHANGES_SQL} SELECT repo_id, sha, COUNT(*) AS changes FROM changes WHERE ord % 3 != 0 GROUP BY ALL""",
)
def fresh_children(spark: SparkSession, folder: str) -> DataFrame:
    batch = A.commits(spark, folder)
    fresh = sinks.fresh_rows(batch.where(F.col("ord") % 3 == 0), batch, ["repo_id", "sha"])
    rows = sinks.child_rows(A.changes(spark, folder), fresh)
    return rows.groupBy("repo_id", "sha").agg(F.count(F.lit(1)).alias("changes"))


@query(
    "pr_upsert",
    f"""WITH {A.PRS_SQL}
    SELECT repo_id, number, CASE WHEN number % 4 = 0 THEN 'stored' ELSE title END AS title,
      CASE WHEN number % 8 = 0 THEN 'kept' ELSE discussion END AS discussion
    FROM prs""",
)
def pr_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth request is stored with another title; half of those lack a discussion."""
    incoming = A.pull_requests(spark, folder)
    number = F.col("number")
    stored = (
        incoming.where(number % 4 == 0)
        .withColumn("title", F.lit("stored"))
        .withColumn("discussion", F.when(number % 8 == 0, F.lit("kept")))
    )
    merged = merge_requests.upsert_prs(stored, incoming)
    return merged.select("repo_id", "number", "title", "discussion")


@query(
    "new_pr_links",
    f"""WITH {A.PRS_SQL} SELECT repo_id, merge_sha AS sha, number AS pr_number FROM prs WHERE number % 2 = 1""",
)
def new_pr_links(spark: SparkSession, folder: str) -> DataFrame:
    prs = A.pull_requests(spark, folder)
    stored = merge_requests.pr_links(prs).where(F.col("pr_number") % 2 == 0)
    return merge_requests.new_links(stored, prs).select("repo_id", "sha", "pr_number")


# ------------------------------------------------------------------ graph


@query(
    "topological_order",
    """WITH RECURSIVE n AS (
      SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders
    ), up(k, anc, hops) AS (
      SELECT k, k, 0 FROM n
      UNION
      SELECT up.k, p.anc, up.hops + 1 FROM up,
        LATERAL (SELECT unnest([up.anc // 2, up.anc // 3]) AS anc) p WHERE up.anc != 0
    )
    SELECT md5(CAST(up.k AS VARCHAR)) AS sha, MAX(n.t + up.hops) AS order_time
    FROM up JOIN n ON n.k = up.anc GROUP BY up.k""",
)
def topological_order(spark: SparkSession, folder: str) -> DataFrame:
    """orders whose parents are the half and the third of their key."""
    log = commit_log(spark, folder).withColumn("commit_time", F.col("author_time"))
    rows = graph.topological_order(history.commits(log), history.explode_parents(log))
    return rows.select("sha", "order_time")


@query(
    "head_paths_reachable",
    f"""WITH RECURSIVE {A.CHANGES_SQL}, n AS (
      SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders
    ), reach(k) AS (
      SELECT MAX(k) FROM n UNION SELECT unnest([reach.k // 2, reach.k // 3]) FROM reach WHERE reach.k != 0
    ), up(k, anc, hops) AS (
      SELECT k, k, 0 FROM n WHERE k IN (SELECT k FROM reach)
      UNION
      SELECT up.k, p.anc, up.hops + 1 FROM up,
        LATERAL (SELECT unnest([up.anc // 2, up.anc // 3]) AS anc) p WHERE up.anc != 0
    ), times AS (
      SELECT up.k, MAX(n.t + up.hops) AS order_time FROM up JOIN n ON n.k = up.anc GROUP BY up.k
    ), dated AS (
      SELECT c.*, order_time FROM changes c JOIN times ON times.k = c.ord
    ), ev AS (
      SELECT path, order_time, sha, 1 AS k, status != 'deleted' AS alive FROM dated
      UNION ALL SELECT old_path, order_time, sha, 0, false FROM dated WHERE status = 'renamed')
    SELECT path FROM ev
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY order_time DESC, sha DESC, k DESC, alive DESC) = 1 AND alive""",
)
def head_paths_reachable(spark: SparkSession, folder: str) -> DataFrame:
    """The order with the largest key is HEAD; most orders are on side branches it never merged."""
    log = commit_log(spark, folder).withColumn("commit_time", F.col("author_time"))
    commits, parents = history.commits(log), history.explode_parents(log)
    one = commits.select("repo_id").distinct().first()["repo_id"]
    newest = A.table(spark, folder, "orders").agg(F.md5(F.max("o_orderkey").cast("string")).alias("head_sha"))
    heads = newest.select(F.lit(one).alias("repo_id"), "head_sha")
    changes = A.changes(spark, folder).withColumn("repo_id", F.lit(one))
    return snapshot.head_paths_of(heads, changes, commits, parents).select("path")


EVENT_EDGES_SQL = """edges AS (
  SELECT event_id AS child, event_id // 2 AS parent FROM events WHERE event_id > 0
  UNION ALL
  SELECT event_id, prev FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
  WHERE prev IS NOT NULL
)"""


@query(
    "graph_ancestors",
    f"""WITH RECURSIVE {EVENT_EDGES_SQL}, reached(id) AS (
      SELECT MAX(event_id) FROM events
      UNION
      SELECT e.parent FROM reached r JOIN edges e ON e.child = r.id
    ) SELECT md5(CAST(id AS VARCHAR)) AS sha FROM reached""",
)
def graph_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """events as commits: half the id is the first parent, the user's previous event the second."""
    from pyspark.sql import Window as W

    events = A.table(spark, folder, "events").select("event_id", "user_id")
    previous = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    edges = events.withColumn("previous", previous).select(
        F.lit(0).alias("repo_id"),
        F.col("event_id"),
        F.posexplode(F.array(F.floor(F.col("event_id") / 2), "previous")).alias("position", "parent"),
    ).where((F.col("event_id") > 0) & F.col("parent").isNotNull())
    parents = edges.select(
        "repo_id",
        F.md5(F.col("event_id").cast("string")).alias("child_sha"),
        F.md5(F.col("parent").cast("string")).alias("parent_sha"),
        "position",
    )
    heads = events.agg(F.max("event_id").alias("h")).select(
        F.lit(0).alias("repo_id"), F.md5(F.col("h").cast("string")).alias("head_sha")
    )
    return graph.ancestors(heads, parents).select("sha")


# ------------------------------------------------------------------ status


@query(
    "label_distribution",
    f"""WITH {A.COMMITS_SQL}, {A.SIMPLE_LABELS_SQL}
    SELECT repo_id, label, COUNT(*) AS commits,
      round(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY repo_id), 1) AS share_pct
    FROM (SELECT c.repo_id, coalesce(l.label, 'significant') AS label FROM commits c LEFT JOIN simple_labels l USING (sha))
    GROUP BY repo_id, label""",
)
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Every commit counts; one without a label has the default."""
    key = ["repo_id", "sha"]
    labels = A.commits(spark, folder).select(*key).join(A.simple_labels(spark, folder), key, "left")
    return stats.label_distribution(labels.withColumn("label", F.coalesce("label", F.lit(C.SIGNIFICANT))))


def _status_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = A.doc_chunks(spark, folder)
    model = F.when(F.col("embedding").isNotNull(), F.concat(F.lit("m"), (F.col("chunk_id") % 2).cast("string")))
    return docs.select("repo_id", "embedding", model.alias("embedding_model"))


STATUS_SQL = f"""WITH {A.REPOS_SQL}, {A.COMMITS_SQL}, {A.SIMPLE_LABELS_SQL}, chunk_rows AS (
  SELECT CAST(substr(source, 4) AS INTEGER) AS repo_id, vec_id IS NOT NULL AS embedded,
    CASE WHEN vec_id IS NOT NULL THEN 'm' || CAST(doc_id % 2 AS VARCHAR) END AS model
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id
), status AS (
  SELECT r.id AS repo_id, r.name,
    (SELECT COUNT(*) FROM commits c WHERE c.repo_id = r.id) AS commits,
    (SELECT string_agg(label || '=' || CAST(n AS VARCHAR), ',' ORDER BY label)
      FROM (SELECT label, COUNT(*) AS n FROM simple_labels s WHERE s.repo_id = r.id GROUP BY label)) AS significance,
    (SELECT COUNT(*) FROM chunk_rows k WHERE k.repo_id = r.id) AS chunks,
    (SELECT COUNT(*) FILTER (embedded) FROM chunk_rows k WHERE k.repo_id = r.id) AS embedded_chunks,
    (SELECT coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') FROM chunk_rows k WHERE k.repo_id = r.id) AS embedding_models,
    coalesce(head_sha = indexed_through_sha, false) AS complete_at_head
  FROM repos r
)"""


def _status(spark: SparkSession, folder: str) -> DataFrame:
    return stats.repo_status(
        A.repos(spark, folder),
        A.commits(spark, folder),
        A.simple_labels(spark, folder),
        _status_chunks(spark, folder),
    )


@query("repo_status", f"""{STATUS_SQL} SELECT * FROM status""")
def repo_status(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.transform(
        F.map_entries("significance"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return _status(spark, folder).select(
        "repo_id",
        "name",
        "commits",
        F.array_join(pairs, ",").alias("significance"),
        "chunks",
        "embedded_chunks",
        F.array_join("embedding_models", ",").alias("embedding_models"),
        "complete_at_head",
    )


@query(
    "repo_totals",
    f"""{STATUS_SQL} SELECT COUNT(*) AS repos, CAST(SUM(commits) AS BIGINT) AS commits,
      CAST(SUM(chunks) AS BIGINT) AS chunks FROM status""",
)
def repo_totals(spark: SparkSession, folder: str) -> DataFrame:
    return stats.repo_totals(_status(spark, folder))


@query(
    "needs_ingest",
    f"""WITH {A.REPOS_SQL}
    SELECT id, name FROM repos WHERE NOT (id % 2 = 0 AND coalesce(head_sha = indexed_through_sha, false))""",
)
def needs_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Odd repositories have moved on since they were indexed."""
    repos = A.repos(spark, folder)
    heads = repos.select(
        "id", F.when(F.col("id") % 2 == 0, F.col("head_sha")).otherwise(F.lit("new")).alias("current_head")
    )
    return catalog.needs_ingest(repos, heads).select("id", "name")


@query(
    "over_cap",
    f"""WITH {A.COMMITS_SQL}, c AS (SELECT o_custkey % 7 AS repo_id, COUNT(*) AS commits FROM orders GROUP BY ALL)
    SELECT CAST(repo_id AS INTEGER) AS repo_id, commits FROM c WHERE commits > 100""",
)
def over_cap(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.table(spark, folder, "orders").select((F.col("o_custkey") % 7).cast("int").alias("repo_id"))
    return catalog.over_cap(rows, cap=100)


@query(
    "repo_lookup",
    f"""WITH {A.REPOS_SQL}, asked AS (
      SELECT c_custkey, 'owner' || CAST(c_nationkey % 6 AS VARCHAR) || '/NATION_' || CAST(c_nationkey AS VARCHAR) AS repo
      FROM customer)
    SELECT a.c_custkey, coalesce(r.id, -1) AS repo_id, r.id IS NOT NULL AS known_repo FROM asked a LEFT JOIN repos r ON r.name = a.repo""",
)
def repo_lookup(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_nationkey").cast("string")
    asked = A.table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(
            F.lit("owner"), (F.col("c_nationkey") % 6).cast("string"), F.lit("/NATION_"), key
        ).alias("repo"),
    )
    found = catalog.resolve_repos(asked, A.repos(spark, folder))
    return found.select("c_custkey", F.coalesce("repo_id", F.lit(-1)).alias("repo_id"), "known_repo")


# ------------------------------------------------------------------ export


@query(
    "slim_snapshot_counts",
    f"""WITH {A.REPOS_SQL}, {A.COMMITS_SQL}, gone AS (SELECT id FROM repos WHERE id % 5 = 0)
    SELECT 'repos' AS table_name, (SELECT COUNT(*) FROM repos WHERE id NOT IN (SELECT id FROM gone)) AS rows
    UNION ALL SELECT 'commits', (SELECT COUNT(*) FROM commits WHERE repo_id NOT IN (SELECT id FROM gone))
    UNION ALL SELECT 'file_changes', 0
    UNION ALL SELECT 'discussion_chunks',
      (SELECT COUNT(*) FROM documents WHERE CAST(substr(source, 4) AS INTEGER) NOT IN (SELECT id FROM gone))""",
)
def slim_snapshot_counts(spark: SparkSession, folder: str) -> DataFrame:
    repos = A.repos(spark, folder)
    tables = {
        "repos": repos,
        "commits": A.commits(spark, folder),
        "file_changes": A.changes(spark, folder),
        "discussion_chunks": A.doc_chunks(spark, folder).drop("tokens"),
    }
    slim = export.slim_snapshot(tables, repos.where(F.col("id") % 5 == 0))
    return export.snapshot_counts(slim)


@query(
    "chunkable_counts",
    f"""WITH {A.COMMITS_SQL} SELECT repo_id, COUNT(*) AS chunkable FROM commits GROUP BY ALL""",
)
def chunkable_counts(spark: SparkSession, folder: str) -> DataFrame:
    from changelore.operators import chunks

    return chunks.count_chunkable(A.commits(spark, folder))

