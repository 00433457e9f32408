"""Threads, chunking, rendering and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import schemas
from changelore.functions import text as X
from changelore.operators import chunks, snapshot, threads
from changelore.plans import adapters as A
from changelore.plans.registry import query
from changelore.sources import merge_requests

SEP = "chr(10) || '---' || chr(10)"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"

# ------------------------------------------------------------------ threads


@query(
    "discussion_threads",
    f"""WITH {A.DISCUSSIONS_SQL} SELECT conv_id, md5(discussion) AS digest, length(discussion) AS n_chars FROM talks""",
)
def discussion_threads(spark: SparkSession, folder: str) -> DataFrame:
    turns = A.table(spark, folder, "conversations").withColumnRenamed("text", "body").withColumnRenamed("role", "author")
    talk = threads.discussions(turns, ["conv_id"], "turn")
    return talk.select(
        "conv_id", F.md5("discussion").alias("digest"), F.char_length("discussion").cast("long").alias("n_chars")
    )


# The sequential packing as a recursion: one step per emitted fragment.
BINS_SQL = f"""segs AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) AS INTEGER) AS i, seg
  FROM (SELECT conv_id, i, trim(string_split(discussion, {SEP})[i], {BLANKS}) AS seg
    FROM (SELECT conv_id, discussion, unnest(range(1, len(string_split(discussion, {SEP})) + 1)) AS i FROM talks))
  WHERE seg != ''
), walk(conv_id, step, i, rest, bin, size, open, out_bin, out_text) AS (
  SELECT conv_id, 0, i, seg, 1, 0, false, 0, '' FROM segs WHERE i = 1
  UNION ALL
  SELECT w.conv_id, w.step + 1,
    CASE WHEN w.big THEN w.i ELSE w.i + 1 END,
    CASE WHEN w.big THEN trim(substr(w.rest, CAST(w.cut + 1 AS BIGINT)), {BLANKS}) ELSE n.seg END,
    CASE WHEN w.big THEN w.target + 1 ELSE w.target END,
    CASE WHEN w.big THEN 0 WHEN w.target != w.bin OR NOT w.open THEN CAST(length(w.rest) AS INTEGER) + 5
      ELSE w.size + CAST(length(w.rest) AS INTEGER) + 5 END,
    NOT w.big, w.target,
    CASE WHEN w.big THEN trim(left(w.rest, w.cut), {BLANKS}) ELSE w.rest END
  FROM (SELECT *,
      CASE WHEN raw_cut <= 0 THEN 1600 ELSE raw_cut END AS cut,
      CASE WHEN open AND (big OR size + length(rest) > 1600) THEN bin + 1 ELSE bin END AS target
    FROM (SELECT *, length(rest) > 1600 AS big,
        CASE WHEN instr(reverse(left(rest, 1600)), chr(10) || chr(10)) = 0 THEN 1600
          ELSE 1599 - instr(reverse(left(rest, 1600)), chr(10) || chr(10)) END AS raw_cut
      FROM walk WHERE rest IS NOT NULL)) w
  LEFT JOIN segs n ON n.conv_id = w.conv_id AND n.i = w.i + 1
), bins AS (
  SELECT conv_id, out_bin AS bin, string_agg(out_text, {SEP} ORDER BY step) AS body
  FROM walk WHERE step > 0 GROUP BY ALL
)"""


@query(
    "discussion_bins",
    f"""WITH RECURSIVE {A.DISCUSSIONS_SQL}, {BINS_SQL}
    SELECT conv_id, CAST(bin AS INTEGER) AS bin, length(body) AS n_chars, md5(body) AS digest FROM bins""",
)
def discussion_bins(spark: SparkSession, folder: str) -> DataFrame:
    turns = A.table(spark, folder, "conversations").withColumnRenamed("text", "body").withColumnRenamed("role", "author")
    talk = threads.discussions(turns, ["conv_id"], "turn")
    binned = talk.select("conv_id", F.posexplode(chunks.split_discussion("discussion")))
    return binned.select(
        "conv_id",
        (F.col("pos") + 1).alias("bin"),
        F.char_length("col").cast("long").alias("n_chars"),
        F.md5("col").alias("digest"),
    )


# ------------------------------------------------------------------ markdown

# HTML to markdown-like text: headings open sections, paragraphs are set apart, all text stays.
_HTML_STEPS = (
    (r"<h1>|<article>", "\n## "),
    (r"</?p>|<br>|</h1>", "\n\n"),
    (r"<[^>]*>", ""),
)


def _page_sql() -> str:
    out = "html"
    for pattern, to in _HTML_STEPS:
        shown = to.replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern}', '{shown}', 'g')"
    return out


PAGES_SQL = f"""docs AS (
  SELECT page_id, 'docs/page' || CAST(page_id AS VARCHAR) || '.md' AS path, {_page_sql()} AS content FROM pages
), sections AS (
  SELECT page_id, i, trim(s, {BLANKS}) AS section FROM (
    SELECT page_id, i, CASE WHEN i = 1 THEN parts[i] ELSE '## ' || parts[i] END AS s
    FROM (SELECT page_id, string_split(content, chr(10) || '## ') AS parts FROM docs), unnest(range(1, len(parts) + 1)) AS t(i))
  WHERE trim(s, {BLANKS}) != ''
)"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    content = F.col("html")
    for pattern, to in _HTML_STEPS:
        content = F.regexp_replace(content, pattern, to)
    return A.table(spark, folder, "pages").select(
        (F.col("page_id") % 25).cast("int").alias("repo_id"),
        "page_id",
        F.concat(F.lit("docs/page"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        content.alias("content"),
    )


@query(
    "markdown_sections",
    f"""WITH {PAGES_SQL}
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS section,
      length(section) AS n_chars, md5(section) AS digest FROM sections""",
)
def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages(spark, folder).select("page_id", F.posexplode(chunks.sections("content")))
    return rows.select(
        "page_id",
        (F.col("pos") + 1).alias("section"),
        F.char_length("col").cast("long").alias("n_chars"),
        F.md5("col").alias("digest"),
    )


MARKDOWN_BINS_SQL = f"""paras AS (
  SELECT page_id, i AS sec, j, string_split(section, chr(10) || chr(10))[j] AS para, length(section) > 1600 AS long
  FROM (SELECT page_id, i, section, unnest(range(1, len(string_split(section, chr(10) || chr(10))) + 1)) AS j FROM sections)
), pack(page_id, sec, j, bin, used, para) AS (
  SELECT page_id, sec, j, 1, length(para) + 2, para FROM paras WHERE j = 1
  UNION ALL
  SELECT n.page_id, n.sec, n.j,
    CASE WHEN n.long AND p.used + length(n.para) + 2 > 1600 THEN p.bin + 1 ELSE p.bin END,
    CASE WHEN n.long AND p.used + length(n.para) + 2 > 1600 THEN 0 ELSE p.used END + length(n.para) + 2, n.para
  FROM pack p JOIN paras n ON n.page_id = p.page_id AND n.sec = p.sec AND n.j = p.j + 1
), packed AS (
  SELECT page_id, sec, bin, trim(string_agg(para, chr(10) || chr(10) ORDER BY j), {BLANKS}) AS body
  FROM pack GROUP BY ALL
), md_bins AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sec, bin) AS INTEGER) AS bin, body,
    COUNT(*) OVER (PARTITION BY page_id) AS n_bins
  FROM packed WHERE body != ''
)"""


@query(
    "markdown_bins",
    f"""WITH RECURSIVE {PAGES_SQL}, {MARKDOWN_BINS_SQL}
    SELECT page_id, bin, length(body) AS n_chars, md5(body) AS digest FROM md_bins""",
)
def markdown_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages(spark, folder).select("page_id", F.posexplode(chunks.split_markdown("content")))
    return rows.select(
        "page_id",
        (F.col("pos") + 1).alias("bin"),
        F.char_length("col").cast("long").alias("n_chars"),
        F.md5("col").alias("digest"),
    )


DOC_CHUNKS_SQL = f"""{MARKDOWN_BINS_SQL}, doc_chunks AS (
  SELECT CAST(d.page_id % 25 AS INTEGER) AS repo_id, 'doc_file' AS source_type,
    CASE WHEN n_bins > 1 THEN path || '#' || CAST(bin AS VARCHAR) ELSE path END AS source_id,
    path || ': ' || left(split_part(ltrim(content, '# '), chr(10), 1), 120) AS title, body, path
  FROM md_bins b JOIN docs d USING (page_id)
)"""


@query(
    "doc_chunks",
    f"""WITH RECURSIVE {PAGES_SQL}, {DOC_CHUNKS_SQL}
    SELECT repo_id, source_id, md5(title) AS title_digest, md5(body) AS body_digest, strftime(last, '%Y-%m-%d') AS authored_on
    FROM doc_chunks LEFT JOIN (
      SELECT 'docs/page' || CAST(o_orderkey % 300 AS VARCHAR) || '.md' AS path, MAX(o_orderdate) AS last FROM orders GROUP BY ALL) USING (path)""",
)
def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks.doc_chunks(pages(spark, folder), _touches(spark, folder))
    return rows.select(
        "repo_id",
        "source_id",
        F.md5("title").alias("title_digest"),
        F.md5("body").alias("body_digest"),
        F.date_format("authored_at", "yyyy-MM-dd").alias("authored_on"),
    )


def _touches(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a commit that touches one page."""
    page = F.col("o_orderkey") % 300
    made = A.table(spark, folder, "orders").select(
        (page % 25).cast("int").alias("repo_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("sha"),
        F.concat(F.lit("docs/page"), page.cast("string"), F.lit(".md")).alias("path"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
    )
    return snapshot.last_touched(made.select("repo_id", "sha", "path"), made.select("repo_id", "sha", "committed_at"))


# ------------------------------------------------------------------ commits

NOISE_SQL = """CASE WHEN starts_with(subject, 'Merge ') OR starts_with(subject, 'Revert ') THEN true
    WHEN regexp_matches(subject, '#[0-9]+[)]') THEN false ELSE length(trim(body)) < 20 END"""

PATHS_SQL = """paths AS (
  SELECT repo_id, sha, path, row_number() OVER (PARTITION BY repo_id, sha ORDER BY path) AS nth,
    COUNT(*) OVER (PARTITION BY repo_id, sha) AS n FROM (SELECT DISTINCT repo_id, sha, path FROM changes)
), heads AS (
  SELECT repo_id, sha, string_agg(path, ', ' ORDER BY path) AS shown, CAST(MAX(n) AS INTEGER) AS n_files
  FROM paths WHERE nth <= 5 GROUP BY ALL
)"""


@query(
    "noise_filter",
    f"""WITH {A.COMMITS_SQL} SELECT repo_id, sha, {NOISE_SQL} AS noise FROM commits""",
)
def noise_filter(spark: SparkSession, folder: str) -> DataFrame:
    return A.commits(spark, folder).select("repo_id", "sha", X.is_noise("subject", "body").alias("noise"))


@query(
    "message_noise",
    """SELECT conv_id, turn, CASE WHEN starts_with(text, 'Merge ') OR starts_with(text, 'Revert ') THEN true
      WHEN regexp_matches(text, '#[0-9]+[)]') THEN false ELSE length(trim(text)) < 20 END AS noise FROM conversations""",
)
def message_noise(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "conversations").select(
        "conv_id", "turn", X.is_noise("text", "text").alias("noise")
    )


@query(
    "paths_by_commit",
    f"""WITH {A.CHANGES_SQL}, {PATHS_SQL} SELECT repo_id, sha, shown, n_files FROM heads""",
)
def paths_by_commit(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks.paths_by_commit(A.changes(spark, folder))
    return rows.select("repo_id", "sha", F.array_join("files_head", ", ").alias("shown"), "n_files")


COMMIT_CHUNKS_SQL = f"""{A.COMMITS_SQL}, {A.CHANGES_SQL}, {PATHS_SQL}, commit_chunks AS (
  SELECT c.repo_id, c.sha, c.committed_at, trim(c.subject) AS title,
    CASE WHEN trim(c.body) = '' THEN trim(c.subject) ELSE trim(c.body) END AS body,
    h.shown, coalesce(h.n_files, 0) AS n_files
  FROM commits c LEFT JOIN heads h ON h.repo_id = c.repo_id AND h.sha = c.sha WHERE NOT {NOISE_SQL}
)"""


def _commit_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.commit_chunks(A.commits(spark, folder), A.changes(spark, folder))


@query(
    "commit_chunks",
    f"""WITH {COMMIT_CHUNKS_SQL} SELECT repo_id, sha AS source_id, title, body, n_files FROM commit_chunks""",
)
def commit_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _commit_chunks(spark, folder).select("repo_id", "source_id", "title", "body", "n_files")


@query(
    "render_chunks",
    f"""WITH {COMMIT_CHUNKS_SQL}
    SELECT repo_id, sha AS source_id, '[' || strftime(committed_at, '%Y-%m-%d') || ']'
      || coalesce(' ' || shown || CASE WHEN n_files > 5 THEN ' (+' || CAST(n_files - 5 AS VARCHAR) || ' more)' ELSE '' END, '')
      || chr(10) || title || chr(10) || '---' || chr(10) || body AS text
    FROM commit_chunks""",
)
def render_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.with_text(_commit_chunks(spark, folder)).select("repo_id", "source_id", "text")


@query(
    "newest_chunks",
    f"""WITH {COMMIT_CHUNKS_SQL}
    SELECT repo_id, sha AS source_id, title FROM commit_chunks ORDER BY committed_at DESC NULLS LAST, repo_id, sha LIMIT 200""",
)
def newest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.newest(_commit_chunks(spark, folder), 200).select("repo_id", "source_id", "title")


@query(
    "unseen_chunks",
    f"""WITH {COMMIT_CHUNKS_SQL} SELECT repo_id, sha AS source_id FROM commit_chunks WHERE left(sha, 1) >= '8'""",
)
def unseen_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the chunks (by hash) are stored already."""
    stored = _commit_chunks(spark, folder).where(F.left("source_id", F.lit(1)) < "8")
    rows = chunks.commit_chunks(A.commits(spark, folder), A.changes(spark, folder), stored)
    return rows.select("repo_id", "source_id")


# ------------------------------------------------------------------ merge requests

PR_CHUNKS_SQL = f"""{BINS_SQL}, pr_chunks AS (
  SELECT repo_id, 'pr_body' AS source_type, 'pr:' || CAST(number AS VARCHAR) AS source_id,
    'PR #' || CAST(number AS VARCHAR) || ': ' || title AS title, trim(body, {BLANKS}) AS body, merge_sha AS linked_sha, merged_at
  FROM prs WHERE trim(body, {BLANKS}) != ''
  UNION ALL
  SELECT p.repo_id, 'pr_discussion', 'pr:' || CAST(number AS VARCHAR) || '#' || CAST(b.bin AS VARCHAR),
    'PR #' || CAST(number AS VARCHAR) || ' discussion: ' || title, b.body, merge_sha, merged_at
  FROM prs p JOIN bins b ON b.conv_id = p.number
)"""


def _pr_chunks(spark: SparkSession, folder: str) -> DataFrame:
    prs = A.pull_requests(spark, folder)
    return chunks.pr_chunks(prs, merge_requests.pr_links(prs), A.changes(spark, folder))


@query(
    "pr_chunks",
    f"""WITH RECURSIVE {A.PRS_SQL}, {A.CHANGES_SQL}, {PATHS_SQL}, {PR_CHUNKS_SQL}
    SELECT c.repo_id, source_type, source_id, title, md5(body) AS body_digest, linked_sha,
      strftime(merged_at, '%Y-%m-%d') AS authored_on, coalesce(h.n_files, 0) AS n_files
    FROM pr_chunks c LEFT JOIN heads h ON h.repo_id = c.repo_id AND h.sha = c.linked_sha""",
)
def pr_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _pr_chunks(spark, folder).select(
        "repo_id",
        "source_type",
        "source_id",
        "title",
        F.md5("body").alias("body_digest"),
        "linked_sha",
        X.iso_date("authored_at").alias("authored_on"),
        "n_files",
    )


@query(
    "chunk_union",
    f"""WITH RECURSIVE {COMMIT_CHUNKS_SQL}, {A.PRS_SQL}, {PR_CHUNKS_SQL}, {PAGES_SQL}, {DOC_CHUNKS_SQL}
    SELECT source_type, COUNT(*) AS chunks, CAST(SUM(length(body)) AS BIGINT) AS body_chars FROM (
      SELECT 'commit_message' AS source_type, body FROM commit_chunks
      UNION ALL SELECT source_type, body FROM pr_chunks
      UNION ALL SELECT source_type, body FROM doc_chunks) GROUP BY ALL""",
)
def chunk_union(spark: SparkSession, folder: str) -> DataFrame:
    docs = chunks.doc_chunks(pages(spark, folder), _touches(spark, folder))
    rows = chunks.all_chunks(_commit_chunks(spark, folder), _pr_chunks(spark, folder), docs)
    return rows.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("body")).alias("body_chars")
    )


@query(
    "chunk_liveness",
    f"""WITH {COMMIT_CHUNKS_SQL}, touched AS (
      SELECT c.repo_id, c.sha AS source_id, x.path FROM commit_chunks c
      LEFT JOIN (SELECT DISTINCT repo_id, sha, path FROM changes) x ON x.repo_id = c.repo_id AND x.sha = c.sha
    ), alive AS (
      SELECT repo_id, path FROM (
        SELECT c.repo_id, path, c.committed_at, ch.sha, 1 AS k, status != 'deleted' AS alive FROM changes ch JOIN commits c ON c.sha = ch.sha
        UNION ALL
        SELECT c.repo_id, old_path, c.committed_at, ch.sha, 0, false FROM changes ch JOIN commits c ON c.sha = ch.sha WHERE status = 'renamed')
      QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY committed_at DESC, sha DESC, k DESC, alive DESC) = 1 AND alive)
    SELECT t.repo_id, t.source_id, round(AVG(CASE WHEN a.path IS NULL THEN 0.0 ELSE 1.0 END), 6) AS liveness_score
    FROM touched t LEFT JOIN alive a ON a.repo_id = t.repo_id AND a.path = t.path GROUP BY ALL""",
)
def chunk_liveness(spark: SparkSession, folder: str) -> DataFrame:
    """Liveness of commit chunks against the paths at HEAD of the same history."""
    changes = A.changes(spark, folder)
    alive = snapshot.head_paths(changes, A.commits(spark, folder))
    files = chunks.chunk_files(_commit_chunks(spark, folder), changes)
    scored = snapshot.liveness(files, alive, ["repo_id", "source_id"])
    return scored.withColumn("liveness_score", F.round("liveness_score", 6))


# ------------------------------------------------------------------ landed pages


def _page_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a landed page with one merge request."""
    text = F.col("text")
    nobody = F.lit(None).cast("struct<login:string>")

    def comment(author: Column | None, body: Column) -> Column:
        who = nobody if author is None else F.struct(author.alias("login"))
        return F.struct(who.alias("author"), body.alias("body"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"))

    comments = F.array(
        comment(F.col("role"), text), comment(None, F.concat(F.lit("re "), text)), comment(F.col("role"), F.lit("  "))
    )
    node = F.struct(
        (F.col("conv_id") * 100 + F.col("turn")).alias("number"),
        F.col("role").alias("title"),
        text.alias("body"),
        F.lit("MERGED").alias("state"),
        F.lit("2024-01-01T00:00:00Z").alias("createdAt"),
        F.lit("2024-01-02T03:04:05Z").alias("mergedAt"),
        F.when(F.col("turn") != 1, F.struct(F.col("role").alias("login"))).alias("author"),
        F.struct(F.md5(text).alias("oid")).alias("mergeCommit"),
        F.struct(F.lit(3).alias("totalCount"), comments.alias("nodes")).alias("comments"),
    )
    page = F.struct(
        F.struct(
            F.struct(
                F.struct(F.col("turn").cast("string").alias("endCursor"), (F.col("turn") < 3).alias("hasNextPage")).alias("pageInfo"),
                F.array(node).alias("nodes"),
            ).alias("pullRequests")
        ).alias("repository"),
        F.struct(F.lit(4900).alias("remaining")).alias("rateLimit"),
    )
    landed = A.table(spark, folder, "conversations").select(F.to_json(F.struct(page.alias("data"))).alias("value"))
    return landed.select(F.from_json("value", schemas.PR_PAGE).alias("p")).select("p.*")


@query(
    "pr_pages",
    f"""SELECT conv_id * 100 + turn AS number, role AS title, md5(nullif(text, '')) AS body_digest,
      CASE WHEN turn != 1 THEN role END AS author, '2024-01-02 03:04:05' AS merged_at, md5(text) AS merge_sha,
      3 AS comment_count,
      md5(role || ': ' || text || {SEP} || 'unknown: re ' || text) AS discussion_digest
    FROM conversations""",
)
def pr_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = merge_requests.parse_pr_pages(_page_json(spark, folder))
    return rows.select(
        "number",
        "title",
        F.md5("body").alias("body_digest"),
        "author",
        F.date_format("merged_at", "yyyy-MM-dd HH:mm:ss").alias("merged_at"),
        "merge_sha",
        "comment_count",
        F.md5("discussion").alias("discussion_digest"),
    )


@query(
    "page_info",
    """SELECT CAST(turn AS VARCHAR) AS end_cursor, turn < 3 AS has_next, COUNT(*) AS pages, 4900 AS rate_remaining,
      COUNT(*) AS fetched FROM conversations GROUP BY ALL""",
)
def page_info(spark: SparkSession, folder: str) -> DataFrame:
    rows = merge_requests.page_info(_page_json(spark, folder))
    return rows.groupBy("end_cursor", "has_next").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min("rate_remaining").alias("rate_remaining"),
        F.sum("fetched").alias("fetched"),
    )

