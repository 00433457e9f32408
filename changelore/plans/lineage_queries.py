"""Symbols, line-range lineage, timelines, evidence, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.functions import text as X
from changelore.operators import catalog, evidence, lineage, retrieval, router, symbols
from changelore.plans import adapters as A
from changelore.plans import retrieval_queries  # noqa: F401  its SQL is used here
from changelore.plans.registry import ORACLES, query
from changelore.runtime import checkpointed, dealt

# ------------------------------------------------------------------ code files

# One code file per part: p_size comment lines, a function, an arrow, a class
# with a method.  m = p_size mod 7 lines stand in the function.
CODE = """repeat('// line' || char(10), p_size)
  || 'export function make_' || replace(p_name, ' ', '_') || '(a) {' || char(10)
  || repeat('  a += 1;' || char(10), p_size % 7) || '  if (a) { return a; }' || char(10) || '}' || char(10)
  || 'const wrap' || CAST(p_partkey AS STRING) || ' = (evt) => {' || char(10) || '  return { a: evt };' || char(10)
  || '};' || char(10) || 'class Box' || CAST(p_partkey AS STRING) || ' {' || char(10) || '  run(step) {' || char(10)
  || '    this.n += step; // {' || char(10) || '  }' || char(10) || '}' || char(10)"""

SYMBOLS_SQL = f"""code AS (
  SELECT p_partkey AS f, {A.path_sql("p_partkey")} AS path, replace(p_name, ' ', '_') AS nm,
    p_size AS s, p_size + p_size % 7 AS t FROM part WHERE p_partkey % 5 IN (0, 1, 4)
), symbols AS (
  SELECT f, path, 'make_' || nm AS name, 'function_declaration' AS kind, s + 1 AS start_line, t + 3 AS end_line FROM code
  UNION ALL SELECT f, path, 'wrap' || CAST(f AS VARCHAR), 'variable_declarator', t + 4, t + 6 FROM code
  UNION ALL SELECT f, path, 'Box' || CAST(f AS VARCHAR), 'class_declaration', t + 7, t + 11 FROM code
  UNION ALL SELECT f, path, 'run', 'method_definition', t + 8, t + 10 FROM code
)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A stored row is a few bytes and its file many lines: rows are dealt out before they grow."""
    return dealt(A.table(spark, folder, "part"), "p_partkey").select(
        F.lit(0).alias("repo_id"), F.expr(A.path_of("p_partkey")).alias("path"), F.expr(CODE).alias("content")
    )


@query(
    "code_files",
    f"""WITH {SYMBOLS_SQL} SELECT path FROM code""",
)
def code_files(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.code_files(files(spark, folder)).select("path")


@query(
    "symbol_guard",
    f"""WITH {SYMBOLS_SQL} SELECT path FROM code WHERE 'make_' || nm IN (SELECT 'make_' || replace(p_name, ' ', '_') FROM part WHERE p_size > 45)""",
)
def symbol_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Files that mention the name of a large part."""
    asked = A.table(spark, folder, "part").where(F.col("p_size") > 45).select(
        F.concat(F.lit("make_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("symbol")
    )
    return symbols.files_with_symbols(files(spark, folder), asked).select("path")


@query(
    "symbol_index",
    f"""WITH {SYMBOLS_SQL} SELECT path, name, kind, start_line, end_line FROM symbols""",
)
def symbol_index(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.symbol_index(files(spark, folder)).drop("repo_id")


ASKED_SQL = """asked AS (
  SELECT p_partkey AS question_id, CASE p_partkey % 4 WHEN 0 THEN 'make_' || replace(p_name, ' ', '_')
      WHEN 1 THEN 'wrap' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'Box' || CAST(p_partkey AS VARCHAR) ELSE 'nope' END AS symbol,
    CASE WHEN p_partkey % 4 = 1 THEN p_partkey END AS file
  FROM part
), located AS (
  SELECT a.question_id, a.symbol, s.path, s.f, s.start_line, s.end_line FROM asked a
  JOIN symbols s ON s.name = a.symbol AND (a.file IS NULL OR s.f = a.file)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY path) = 1
)"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """A question per part: a shared name, an own name with its file, one without, an unknown one."""
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    return A.table(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"),
        F.lit(0).alias("repo_id"),
        F.when(kind == 0, F.concat(F.lit("make_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
        .when(kind == 1, F.concat(F.lit("wrap"), key))
        .when(kind == 2, F.concat(F.lit("Box"), key))
        .otherwise("nope")
        .alias("symbol"),
        F.when(kind == 1, F.expr(A.path_of("p_partkey"))).alias("file"),
    )


def _located(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.locate(questions(spark, folder), symbols.symbol_index(files(spark, folder)))


@query(
    "locate_symbols",
    f"""WITH {SYMBOLS_SQL}, {ASKED_SQL} SELECT question_id, symbol, path, start_line, end_line FROM located""",
)
def locate_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder).select("question_id", "symbol", "path", "start_line", "end_line")


# ------------------------------------------------------------------ range walk

HUNKS_SQL = """raw_hunks AS (
  SELECT l_orderkey AS ord, l_partkey AS f, 1 + MAX(l_suppkey) % 30 AS line_at, CAST(MAX(l_quantity) AS BIGINT) % 5 AS n,
    CAST(MAX(l_linenumber) AS BIGINT) % 4 AS o FROM lineitem GROUP BY ALL
), sized AS (SELECT ord, f, line_at, CASE WHEN n = 0 AND o = 0 THEN 1 ELSE n END AS nl, o AS ol FROM raw_hunks
), hunks AS (
  SELECT ord, f, CASE WHEN nl = 0 THEN line_at - 1 ELSE line_at END AS ns, nl, CASE WHEN ol = 0 THEN line_at - 1 ELSE line_at END AS os, ol,
    row_number() OVER (PARTITION BY f ORDER BY ord DESC) AS step FROM sized
)"""

WALK_SQL = """walk(f, symbol, step, ord, s, e, hit) AS (
  SELECT f, name, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(start_line AS BIGINT), CAST(end_line AS BIGINT), false FROM spans
  UNION ALL
  SELECT w.f, w.symbol, h.step, h.ord,
    CASE WHEN h.first <= w.s AND h.last >= w.s THEN (CASE WHEN ol > 0 THEN os ELSE os + 1 END)
      WHEN h.last < w.s THEN w.s - (nl - ol) ELSE w.s END,
    CASE WHEN h.first <= w.e AND h.last >= w.e THEN (CASE WHEN ol > 0 THEN os + ol - 1 ELSE os END)
      WHEN h.last < w.e THEN w.e - (nl - ol) ELSE w.e END,
    CASE WHEN nl > 0 THEN h.first <= w.e AND h.last >= w.s ELSE h.first > w.s AND h.first <= w.e END
  FROM walk w JOIN (SELECT *, CASE WHEN nl > 0 THEN ns ELSE ns + 1 END AS first,
    CASE WHEN nl > 0 THEN ns ELSE ns + 1 END + nl - 1 AS last FROM hunks) h
  ON h.f = w.f AND h.step = w.step + 1 WHERE w.s <= w.e
)"""


def hunks(spark: SparkSession, folder: str) -> DataFrame:
    """One hunk per order and part; the order key is the commit's position."""
    at = F.col("at")
    sized = (
        A.table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(
            (1 + F.max("l_suppkey") % 30).alias("at"),
            (F.max("l_quantity").cast("long") % 5).alias("n"),
            (F.max("l_linenumber").cast("long") % 4).alias("old_len"),
        )
        .withColumn("new_len", F.when((F.col("n") == 0) & (F.col("old_len") == 0), 1).otherwise(F.col("n")))
    )
    return sized.select(
        F.lit(0).alias("repo_id"),
        F.expr(A.path_of("l_partkey")).alias("path"),
        F.md5(F.col("l_orderkey").cast("string")).alias("sha"),
        F.col("l_orderkey").alias("ord"),
        F.when(F.col("new_len") == 0, at - 1).otherwise(at).alias("new_start"),
        "new_len",
        F.when(F.col("old_len") == 0, at - 1).otherwise(at).alias("old_start"),
        "old_len",
    )


@query(
    "walk_ranges",
    f"""WITH RECURSIVE {SYMBOLS_SQL}, spans AS (SELECT * FROM symbols), {HUNKS_SQL}, {WALK_SQL}
    SELECT {A.path_sql("f")} AS path, symbol, md5(CAST(ord AS VARCHAR)) AS sha, ord FROM walk WHERE hit""",
)
def walk_ranges(spark: SparkSession, folder: str) -> DataFrame:
    spans = symbols.symbol_index(files(spark, folder)).withColumnRenamed("name", "symbol").drop("kind")
    return lineage.walk_ranges(spans, hunks(spark, folder)).drop("repo_id")


@query(
    "lineage_materialize",
    f"""WITH RECURSIVE {SYMBOLS_SQL}, spans AS (SELECT * FROM symbols WHERE name != 'run'), {HUNKS_SQL}, {WALK_SQL}
    SELECT {A.path_sql("f")} AS path, symbol,
      CASE WHEN starts_with(symbol, 'Box') THEN 'stored' ELSE md5(CAST(ord AS VARCHAR)) END AS sha,
      starts_with(symbol, 'Box') AS cache_hit, COUNT(*) AS n
    FROM walk WHERE hit AND NOT starts_with(symbol, 'Box') GROUP BY ALL
    UNION ALL SELECT path, name, 'stored', true, 1 FROM symbols WHERE starts_with(name, 'Box')""",
)
def lineage_materialize(spark: SparkSession, folder: str) -> DataFrame:
    """The lineage of every class is stored already; the others are walked."""
    index = symbols.symbol_index(files(spark, folder)).where(F.col("name") != "run")
    spans = checkpointed(index.withColumnRenamed("name", "symbol").drop("kind").withColumn("head_sha", F.lit("h")))
    stored = spans.where(F.col("symbol").startswith("Box")).select(
        "repo_id", "path", "symbol", "head_sha", F.lit("stored").alias("sha"), F.lit(0).cast("long").alias("ord")
    )
    rows = lineage.materialize(spans, hunks(spark, folder), stored)
    return rows.groupBy("path", "symbol", "sha", "cache_hit").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ renames

NAMES_SQL = """views AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
)"""


def _name(user: str, n: Column) -> Column:
    return F.concat(F.lit("u"), F.col(user).cast("string"), F.lit("/n"), (n % 3).cast("string"))


def _views(spark: SparkSession, folder: str) -> DataFrame:
    """Every event of a user renames the user's file; three names take turns."""
    views = A.table(spark, folder, "events").select("user_id", "event_id")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return views.withColumn("n", n).select(
        F.lit(0).alias("repo_id"),
        F.lit("renamed").alias("status"),
        _name("user_id", F.col("n") - 1).alias("old_path"),
        _name("user_id", F.col("n")).alias("path"),
        F.col("event_id").alias("ord"),
        "user_id",
        "n",
    )


@query(
    "rename_chain",
    f"""WITH {NAMES_SQL}
    SELECT v.event_id AS ord, 'u' || CAST(user_id AS VARCHAR) || '/n' || CAST((n - 1) % 3 AS VARCHAR) AS old_path,
      'u' || CAST(user_id AS VARCHAR) || '/n' || CAST(n % 3 AS VARCHAR) AS path,
      'u' || CAST(user_id AS VARCHAR) || '/n' || CAST(MAX(n) OVER (PARTITION BY user_id) % 3 AS VARCHAR) AS final_path
    FROM views v""",
)
def rename_chain(spark: SparkSession, folder: str) -> DataFrame:
    rows = lineage.rename_chain(_views(spark, folder), width=1000)
    return rows.select("ord", "old_path", "path", "final_path")


# ------------------------------------------------------------------ timelines

TIMELINE_SQL = f"""lineage AS (
  SELECT DISTINCT l_partkey AS question_id, l_orderkey AS ord, md5(CAST(l_orderkey AS VARCHAR)) AS sha FROM lineitem
), timeline AS (
  SELECT l.question_id, l.ord, l.sha, left(l.sha, 9) AS evidence_id,
    CASE WHEN l.ord = MIN(l.ord) OVER (PARTITION BY l.question_id) THEN 'introduced' ELSE 'modified' END AS role,
    coalesce(c.subject, '') AS subject, c.author_name AS author, c.committed_at, c.body,
    CAST(NULLIF(regexp_extract(c.subject, '[(]#([0-9]+)[)]', 1), '') AS BIGINT) AS pr_ref,
    coalesce(s.label, 'significant') AS label
  FROM lineage l LEFT JOIN commits c ON c.sha = l.sha LEFT JOIN simple_labels s ON s.sha = l.sha
)"""
HISTORY_SQL = f"{A.COMMITS_SQL}, {A.SIMPLE_LABELS_SQL}, {TIMELINE_SQL}"


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as symbol questions, the orders with the part as their lineage."""
    return (
        A.table(spark, folder, "lineitem")
        .select(
            F.col("l_partkey").alias("question_id"),
            (F.col("l_orderkey") % 25).cast("int").alias("repo_id"),
            F.md5(F.col("l_orderkey").cast("string")).alias("sha"),
            F.col("l_orderkey").alias("ord"),
        )
        .distinct()
    )


def _timeline(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.timeline(
        _lineage(spark, folder), A.commits(spark, folder), A.simple_labels(spark, folder)
    )


@query(
    "timeline_roles",
    f"""WITH {HISTORY_SQL}
    SELECT question_id, ord, evidence_id, role, subject, author, strftime(committed_at, '%Y-%m-%d') AS committed_on,
      coalesce(pr_ref, -1) AS pr_ref, label
    FROM timeline WHERE label = 'significant'""",
)
def timeline_roles(spark: SparkSession, folder: str) -> DataFrame:
    rows = lineage.evidence(_timeline(spark, folder))
    return rows.select(
        "question_id", "ord", "evidence_id", "role", "subject", "author", "committed_on",
        F.coalesce("pr_ref", F.lit(-1)).alias("pr_ref"), "label",
    )


GATE_SQL = """gated AS (
  SELECT p_partkey AS question_id, COUNT(*) FILTER (label = 'significant') AS evidence,
    COUNT(*) FILTER (label != 'significant') AS noise_dropped,
    MAX(CASE WHEN label = 'significant' AND role = 'introduced' THEN evidence_id END) AS introduced_id,
    coalesce(bool_or(label = 'significant' AND role = 'introduced' AND pr_ref IS NULL
      AND (trim(coalesce(body, '')) = '' OR trim(body) = trim(subject))), false) AS weak
  FROM part LEFT JOIN timeline ON question_id = p_partkey GROUP BY p_partkey
), answers AS (
  SELECT question_id, evidence, noise_dropped, introduced_id,
    CASE WHEN question_id % 11 = 0 THEN 'unknown_repo' WHEN question_id % 7 = 0 THEN 'symbol_not_found'
      WHEN evidence = 0 THEN 'no_significant_history' WHEN evidence = 1 AND weak THEN 'single_uncited_commit' END AS reason
  FROM gated
), statuses AS (
  SELECT question_id, CASE WHEN reason IS NULL THEN 'answered' WHEN reason = 'single_uncited_commit' THEN 'low_confidence'
    ELSE 'abstained' END AS status, reason, evidence, noise_dropped, introduced_id FROM answers
)"""


def _gate(questions: DataFrame, rows: DataFrame) -> DataFrame:
    asked = questions.withColumn("known_repo", F.col("question_id") % 11 != 0)
    return lineage.gate(asked, rows, asked.where(F.col("question_id") % 7 != 0))


def _part_questions(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "part").select(F.col("p_partkey").alias("question_id"))


@query(
    "abstention_gate",
    f"""WITH {HISTORY_SQL}, {GATE_SQL} SELECT * FROM statuses""",
)
def abstention_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _gate(_part_questions(spark, folder), _timeline(spark, folder))


SHORT_HISTORY_SQL = HISTORY_SQL.replace(
    "SELECT DISTINCT l_partkey AS question_id", "SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS question_id"
)
SHORT_GATE_SQL = GATE_SQL.replace(
    "SELECT p_partkey AS question_id,", "SELECT q.question_id AS question_id,"
).replace(
    "FROM part LEFT JOIN timeline ON question_id = p_partkey GROUP BY p_partkey",
    "FROM (SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS question_id FROM lineitem) q "
    "LEFT JOIN timeline t ON t.question_id = q.question_id GROUP BY q.question_id",
)


@query(
    "abstention_gate_short",
    f"""WITH {SHORT_HISTORY_SQL}, {SHORT_GATE_SQL} SELECT * FROM statuses""",
)
def abstention_gate_short(spark: SparkSession, folder: str) -> DataFrame:
    """Every (part, supplier) pair as a question: most histories are a single commit."""
    short = (
        A.table(spark, folder, "lineitem")
        .select(
            (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("question_id"),
            (F.col("l_orderkey") % 25).cast("int").alias("repo_id"),
            F.md5(F.col("l_orderkey").cast("string")).alias("sha"),
            F.col("l_orderkey").alias("ord"),
        )
        .distinct()
    )
    rows = lineage.timeline(short, A.commits(spark, folder), A.simple_labels(spark, folder))
    return _gate(short.select("question_id").distinct(), rows)


WHY_SQL = f"""WITH RECURSIVE {SYMBOLS_SQL}, {ASKED_SQL}, spans AS (SELECT DISTINCT f, path, symbol AS name, start_line, end_line FROM located),
    {HUNKS_SQL}, {WALK_SQL}, {A.COMMITS_SQL}, {A.SIMPLE_LABELS_SQL}, rows_ AS (
      SELECT l.question_id, w.ord, coalesce(s.label, 'significant') AS label, c.subject, c.body,
        left(c.sha, 9) AS evidence_id, w.ord = MIN(w.ord) OVER (PARTITION BY l.question_id) AS is_first
      FROM located l JOIN walk w ON w.f = l.f AND w.symbol = l.symbol AND w.hit
      JOIN commits c ON c.ord = w.ord LEFT JOIN simple_labels s ON s.sha = c.sha
    ), g AS (
      SELECT question_id, COUNT(*) FILTER (label = 'significant') AS evidence,
        COUNT(*) FILTER (label != 'significant') AS noise_dropped,
        MAX(CASE WHEN label = 'significant' AND is_first THEN evidence_id END) AS introduced_id,
        bool_or(label = 'significant' AND is_first AND NOT regexp_matches(subject, '[(]#[0-9]+[)]') AND trim(body) = trim(subject)) AS weak
      FROM rows_ GROUP BY question_id
    ), r AS (
      SELECT a.question_id, coalesce(evidence, 0) AS evidence, coalesce(noise_dropped, 0) AS noise_dropped, introduced_id,
        CASE WHEN l.question_id IS NULL THEN 'symbol_not_found' WHEN coalesce(evidence, 0) = 0 THEN 'no_significant_history'
          WHEN evidence = 1 AND weak THEN 'single_uncited_commit' END AS reason
      FROM asked a LEFT JOIN located l USING (question_id) LEFT JOIN g USING (question_id))
    SELECT question_id, CASE WHEN reason IS NULL THEN 'answered' WHEN reason = 'single_uncited_commit' THEN 'low_confidence'
      ELSE 'abstained' END AS status, reason, evidence, noise_dropped, introduced_id FROM r"""


@query("why_symbols", WHY_SQL)
def why_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Locate, walk, hydrate, filter and gate a table of symbol questions."""
    zero = F.lit(0).alias("repo_id")
    commits = A.commits(spark, folder).drop("repo_id").select(zero, "*")
    labels = A.simple_labels(spark, folder).drop("repo_id").select(zero, "*")
    answers, _ = lineage.why(
        questions(spark, folder), _located(spark, folder), hunks(spark, folder), commits, labels
    )
    return answers


@query(
    "answer_any",
    f"""SELECT 'p' || CAST(question_id AS VARCHAR) AS question_id, 'A' AS path, status, reason, CAST(evidence AS BIGINT) AS evidence
    FROM ({WHY_SQL})
    UNION ALL
    SELECT 'q' || CAST(query_id AS VARCHAR), 'B', CASE WHEN hits = 0 THEN 'abstained' ELSE 'answered' END, abstained_reason, hits
    FROM ({ORACLES["search_outcomes"]})""",
)
def answer_any(spark: SparkSession, folder: str) -> DataFrame:
    """Names and prose in one table of questions: each is routed, and its branch is run."""
    named = questions(spark, folder).select(
        F.concat(F.lit("p"), F.col("question_id").cast("string")).alias("question_id"),
        F.col("symbol").alias("question"), "repo_id", "file", F.lit(None).cast("array<float>").alias("vector"),
    )
    prose = A.questions(spark, folder).select(
        F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question_id"), "question", "vector"
    )
    zero = F.lit(0).alias("repo_id")
    commits = A.commits(spark, folder).drop("repo_id").select(zero, "*")
    labels = A.simple_labels(spark, folder).drop("repo_id").select(zero, "*")

    def by_lineage(asked: DataFrame) -> DataFrame:
        located = symbols.locate(asked, symbols.symbol_index(symbols.files_with_symbols(files(spark, folder), asked)))
        return lineage.why(asked, located, hunks(spark, folder), commits, labels)[0]

    def by_search(asked: DataFrame) -> DataFrame:
        hits = retrieval.hybrid_search(asked, A.doc_vectors(spark, folder), top_n=3, lexical_index=A.lexical_index(spark, folder))
        return retrieval.search_outcome(asked, hits)

    return router.answer(named.unionByName(prose, allowMissingColumns=True), by_lineage, by_search)


RENAMES = """SELECT l_partkey AS f, MIN(l_orderkey) + (MAX(l_orderkey) - MIN(l_orderkey)) DIV 3 AS first,
    MIN(l_orderkey) + 2 * (MAX(l_orderkey) - MIN(l_orderkey)) DIV 3 AS second FROM {lines} GROUP BY l_partkey"""


def _names(key: str) -> list[Column]:
    """The names of a part's file: at HEAD, before its second and before its first rename."""
    old = A.OLD_PATH.format(key=key, text="STRING")
    return [F.expr(A.path_of(key)), F.expr(old), F.concat(F.lit("older/"), F.expr(old))]


@query(
    "why_renamed",
    WHY_SQL.replace("  JOIN symbols s ON s.name = a.symbol AND", "  JOIN symbols s ON a.question_id % 13 != 0 AND s.name = a.symbol AND")
    .replace("CASE WHEN l.question_id IS NULL THEN", "CASE WHEN a.question_id % 13 = 0 THEN 'unknown_repo' WHEN l.question_id IS NULL THEN"),
)
def why_renamed(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job over files that were renamed twice; it finds what it would have found under one name.

    Every thirteenth question names an unknown repository; the lineage of the classes is stored already.
    """
    zero = F.lit(0).alias("repo_id")
    lines = A.table(spark, folder, "lineitem")
    when = checkpointed(spark.sql(RENAMES.format(lines="{lines}"), lines=lines))
    head, middle, oldest = _names("f")
    renamed = lambda ord_, old, new: when.select(
        zero, F.lit(C.RENAMED).alias("status"), old.alias("old_path"), new.alias("path"), F.col(ord_).alias("ord")
    )
    changes = renamed("first", oldest, middle).unionByName(renamed("second", middle, head))
    at_head = hunks(spark, folder)
    by_name = at_head.join(when.select(head.alias("path"), middle.alias("_middle"), oldest.alias("_oldest"), "first", "second"), "path")
    name = F.when(F.col("ord") >= F.col("second"), F.col("path")).when(F.col("ord") >= F.col("first"), F.col("_middle")).otherwise(F.col("_oldest"))
    walked = by_name.withColumn("path", name).select(*at_head.columns)
    commits = A.commits(spark, folder).drop("repo_id").select(zero, "*")
    labels = A.simple_labels(spark, folder).drop("repo_id").select(zero, "*")
    repos = A.repos(spark, folder)
    here = repos.where("id = 0").first()
    unknown = F.col("question_id") % 13 == 0
    repo = F.when(unknown, F.lit("nobody/nothing")).otherwise(F.lit(here["name"]))
    asked = questions(spark, folder).drop("repo_id").withColumn("repo", repo)
    classes = symbols.symbol_index(files(spark, folder)).where(F.col("name").startswith("Box")).withColumnRenamed("name", "symbol")
    stored = lineage.walk_ranges(classes.drop("kind"), at_head).withColumn("head_sha", F.lit(here["head_sha"]))
    answers, _ = lineage.why_job(asked, repos, files(spark, folder), walked, commits, labels, changes, checkpointed(stored))
    return answers


# ------------------------------------------------------------------ evidence


@query(
    "evidence_bundle",
    f"""WITH {HISTORY_SQL}, ev AS (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ord, sha) AS nth FROM timeline WHERE label = 'significant' QUALIFY nth <= 14
    ), entries AS (
      SELECT question_id, nth, '[' || evidence_id || '] ' || strftime(committed_at, '%Y-%m-%d') || ' ' || author
        || coalesce(' (PR #' || CAST(pr_ref AS VARCHAR) || ')', '') || ': ' || subject || chr(10)
        || array_to_string(['    ' || trim(b) for b in string_split(trim(body), chr(10)) if trim(b) != ''], chr(10)) || chr(10) AS entry
      FROM ev
    ), texts AS (SELECT question_id, string_agg(entry, chr(10) ORDER BY nth) AS t FROM entries GROUP BY ALL)
    SELECT p_partkey AS question_id, md5(left('Question: why does ' || p_name || ' exist?' || chr(10)
      || 'Anchor: ' || p_brand || ':' || CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 9 AS VARCHAR) || chr(10) || chr(10)
      || 'Evidence (chronological):' || coalesce(chr(10) || t, ''), 9000)) AS digest
    FROM part LEFT JOIN texts ON question_id = p_partkey""",
)
def evidence_bundle(spark: SparkSession, folder: str) -> DataFrame:
    anchors = A.table(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"),
        F.col("p_name").alias("symbol"),
        F.col("p_brand").alias("path"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + 9).alias("end_line"),
    )
    texts = evidence.bundle(anchors, lineage.evidence(_timeline(spark, folder)))
    return texts.select("question_id", F.md5("bundle").alias("digest"))


LINKS_SQL = """links AS (
  SELECT DISTINCT CAST(o_orderkey % 25 AS INTEGER) AS repo_id, md5(CAST(o_orderkey AS VARCHAR)) AS sha, o_custkey % 200 AS pr_number FROM orders
)"""


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "orders").select(
        (F.col("o_orderkey") % 25).cast("int").alias("repo_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("sha"),
        (F.col("o_custkey") % 200).alias("pr_number"),
    )


@query(
    "link_prefix_join",
    f"""WITH {HISTORY_SQL}, {LINKS_SQL}
    SELECT DISTINCT t.question_id, l.repo_id, l.pr_number FROM timeline t
    JOIN links l ON starts_with(l.sha, t.evidence_id) AND l.sha = t.sha WHERE t.label = 'significant'""",
)
def link_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.link_prefix_join(lineage.evidence(_timeline(spark, folder)), _links(spark, folder))


SNIPPETS_SQL = """ids AS (
  SELECT question_id, pr_number, row_number() OVER (PARTITION BY question_id ORDER BY pr_number) AS nth
  FROM (SELECT DISTINCT t.question_id, l.pr_number FROM timeline t JOIN links l ON l.sha = t.sha WHERE t.label = 'significant')
  QUALIFY nth <= 3
), first_turn AS (SELECT conv_id, arg_min(text, turn) AS body FROM conversations GROUP BY ALL
), snippets AS (
  SELECT question_id, nth, 'pr:' || CAST(pr_number AS VARCHAR) AS evidence_id, left(trim(body, ' ' || chr(10)), 700) AS snippet
  FROM ids JOIN first_turn ON conv_id = pr_number WHERE trim(body, ' ' || chr(10)) != ''
)"""


def _snippets(spark: SparkSession, folder: str) -> DataFrame:
    zero = F.lit(0).alias("repo_id")
    shown = lineage.evidence(_timeline(spark, folder)).drop("repo_id").select(zero, "*")
    links = _links(spark, folder).drop("repo_id").select(zero, "*")
    turns = A.table(spark, folder, "conversations").select(
        zero,
        F.lit(C.SOURCE_PR_DISCUSSION).alias("source_type"),
        F.concat(
            F.lit("pr:"), F.col("conv_id").cast("string"), F.lit("#"), (F.col("turn") + 1).cast("string")
        ).alias("source_id"),
        F.col("text").alias("body"),
    )
    return evidence.discussion_snippets(shown, links, turns)


@query(
    "discussion_snippets",
    f"""WITH {HISTORY_SQL}, {LINKS_SQL}, {SNIPPETS_SQL} SELECT question_id, CAST(nth AS INTEGER) AS nth, evidence_id, snippet FROM snippets""",
)
def discussion_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return _snippets(spark, folder)


@query(
    "bundle_with_snippets",
    f"""WITH {HISTORY_SQL}, {LINKS_SQL}, {SNIPPETS_SQL}, x AS (
      SELECT question_id, string_agg('[' || evidence_id || ']' || chr(10) || snippet || chr(10), chr(10) ORDER BY nth) AS t FROM snippets GROUP BY ALL)
    SELECT p_partkey AS question_id, md5(CASE WHEN t IS NULL THEN p_name ELSE
      left(p_name || chr(10) || chr(10) || 'Linked PR discussion excerpts:' || chr(10) || t, 11100) END) AS digest
    FROM part LEFT JOIN x ON question_id = p_partkey""",
)
def bundle_with_snippets(spark: SparkSession, folder: str) -> DataFrame:
    bundles = A.table(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"), F.col("p_name").alias("bundle")
    )
    rows = evidence.with_snippets(bundles, _snippets(spark, folder))
    return rows.select("question_id", F.md5("bundle").alias("digest"))


@query(
    "timeline_view",
    f"""WITH {HISTORY_SQL}
    SELECT question_id, evidence_id, role, subject, strftime(committed_at, '%Y-%m-%d') AS date, coalesce(pr_ref, -1) AS pr_ref
    FROM timeline WHERE label = 'significant' QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY ord, sha) <= 20""",
)
def timeline_view(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.timeline_view(lineage.evidence(_timeline(spark, folder)), n=20)
    return rows.withColumn("pr_ref", F.coalesce("pr_ref", F.lit(-1)))


@query(
    "evidence_arc",
    f"""WITH {HISTORY_SQL}, b AS (
      SELECT question_id, ord, epoch(committed_at) AS t, MIN(epoch(committed_at)) OVER (PARTITION BY question_id) AS lo,
        MAX(epoch(committed_at)) OVER (PARTITION BY question_id) AS hi FROM timeline WHERE label = 'significant')
    SELECT question_id, ord, round(CASE WHEN hi = lo THEN 0 ELSE (t - lo) / (hi - lo) END, 6) AS position FROM b""",
)
def evidence_arc(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.arc(lineage.evidence(_timeline(spark, folder)))
    return rows.select("question_id", "ord", "position")


@query(
    "hits_bundle",
    f"""WITH h AS (
      SELECT conv_id AS query_id, turn + 1 AS rank, role AS title, text AS body FROM conversations WHERE turn + 1 <= 10
    ), e AS (
      SELECT query_id, rank, '[pr:' || CAST(query_id AS VARCHAR) || '#' || CAST(rank AS VARCHAR) || '] 2024-01-01 ' || title || chr(10)
        || '    ' || CASE WHEN length(trim(body, ' ' || chr(10))) > 350 THEN left(trim(body, ' ' || chr(10)), 350) || '...' ELSE trim(body, ' ' || chr(10)) END
        || chr(10) AS entry FROM h)
    SELECT query_id, md5(left('Question: q' || CAST(query_id AS VARCHAR) || chr(10) || chr(10) || 'Evidence (ranked by relevance):' || chr(10)
      || string_agg(entry, chr(10) ORDER BY rank), 9000)) AS digest FROM e GROUP BY query_id""",
)
def hits_bundle(spark: SparkSession, folder: str) -> DataFrame:
    turns = A.table(spark, folder, "conversations")
    rank = F.col("turn") + 1
    hits = turns.select(
        F.col("conv_id").alias("query_id"),
        rank.alias("rank"),
        F.lit(C.SOURCE_PR_DISCUSSION).alias("source_type"),
        F.concat(F.lit("pr:"), F.col("conv_id").cast("string"), F.lit("#"), rank.cast("string")).alias("source_id"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("authored_at"),
        F.col("role").alias("title"),
        F.col("text").alias("body"),
    )
    asked = turns.select(
        F.col("conv_id").alias("query_id"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question")
    ).distinct()
    return evidence.hits_bundle(asked, hits).select("query_id", F.md5("bundle").alias("digest"))


@query(
    "answer_batch",
    f"""WITH {HISTORY_SQL}, {GATE_SQL}
    SELECT question_id, 'A' AS path, status, reason, evidence FROM statuses
    UNION ALL
    SELECT d.doc_id, 'B', CASE WHEN l.doc_id IS NULL THEN 'abstained' ELSE 'answered' END,
      CASE WHEN l.doc_id IS NULL THEN 'no_hits' WHEN l.quality = 0 THEN 'all_stale' END, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def answer_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol answers of all parts with search outcomes of all documents; a label is a hit."""
    asked = A.documents(spark, folder).select(F.col("doc_id").alias("query_id"))
    hits = A.table(spark, folder, "labels").select(
        F.col("doc_id").alias("query_id"), F.col("quality").cast("double").alias("liveness_score")
    )
    outcome = retrieval.search_outcome(asked, hits)
    answers = _gate(_part_questions(spark, folder), _timeline(spark, folder))
    return router.answer_batch(answers, outcome)


@query(
    "slugs",
    """WITH r AS (
      SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'a' || c_name WHEN 1 THEN 'own/' || replace(c_name, '#', '-')
        WHEN 2 THEN 'https://github.com/own/' || replace(c_name, '#', '-') || '.git' WHEN 3 THEN 'github.com/own/x' || CAST(c_custkey AS VARCHAR) || '/tree/main'
        WHEN 4 THEN 'https://gitlab.com/a/b' WHEN 5 THEN 'github.com/a' WHEN 6 THEN 'a/b/c' ELSE ' www.github.com/o/n' || CAST(c_custkey AS VARCHAR) || '?tab=x ' END AS raw
      FROM customer), s AS (
      SELECT c_custkey, CASE c_custkey % 8 WHEN 1 THEN raw WHEN 2 THEN 'own/' || split_part(split_part(raw, '/own/', 2), '.git', 1)
        WHEN 3 THEN 'own/x' || CAST(c_custkey AS VARCHAR) WHEN 7 THEN 'o/n' || CAST(c_custkey AS VARCHAR) END AS slug FROM r)
    SELECT c_custkey, slug, split_part(slug, '/', 1) AS owner, split_part(slug, '/', 2) AS short_name FROM s""",
)
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    key, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 8
    name = F.replace("c_name", F.lit("#"), F.lit("-"))
    raw = (
        F.when(kind == 0, F.concat(F.lit("a"), "c_name"))
        .when(kind == 1, F.concat(F.lit("own/"), name))
        .when(kind == 2, F.concat(F.lit("https://github.com/own/"), name, F.lit(".git")))
        .when(kind == 3, F.concat(F.lit("github.com/own/x"), key, F.lit("/tree/main")))
        .when(kind == 4, F.lit("https://gitlab.com/a/b"))
        .when(kind == 5, F.lit("github.com/a"))
        .when(kind == 6, F.lit("a/b/c"))
        .otherwise(F.concat(F.lit(" www.github.com/o/n"), key, F.lit("?tab=x ")))
    )
    rows = catalog.normalize(A.table(spark, folder, "customer").select("c_custkey", raw.alias("raw")))
    return rows.select("c_custkey", "slug", "owner", "short_name")


@query(
    "pr_refs",
    f"""WITH {A.COMMITS_SQL}
    SELECT sha, coalesce(CAST(NULLIF(regexp_extract(subject, '[(]#([0-9]+)[)]', 1), '') AS BIGINT), -1) AS pr_ref,
      array_to_string(list_sort(list_distinct([CAST(x AS BIGINT) for x in regexp_extract_all(body, '#([0-9]{{2,6}})', 1)])), ',') AS mentions
    FROM commits""",
)
def pr_refs(spark: SparkSession, folder: str) -> DataFrame:
    return A.commits(spark, folder).select(
        "sha",
        F.coalesce(X.pr_ref("subject"), F.lit(-1)).alias("pr_ref"),
        F.array_join(X.pr_mentions("body").cast("array<string>"), ",").alias("mentions"),
    )
