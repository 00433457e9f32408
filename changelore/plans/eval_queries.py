"""Evaluation, accounting and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import schemas
from changelore import constants as C
from changelore.operators import chunks, citations, evalkit, retrieval, snapshot, stats
from changelore.plans import adapters as A
from changelore.plans import history_queries as H
from changelore.plans import retrieval_queries as R
from changelore.plans.chunk_queries import _page_json
from changelore.plans.registry import ORACLES, query
from changelore.runtime import checkpoint_dir
from changelore.sources import history, sinks
from changelore.streaming import ingest

# ------------------------------------------------------------------ report

P95 = "list_sort(list({value}))[CAST(floor(0.95 * (COUNT({value}) - 1)) AS BIGINT) + 1]"


@query(
    "eval_report",
    f"""WITH r AS (
      SELECT event_type AS kind, user_id % 3 AS p, value / 1000 AS s, value > 20 AS passed, event_id % 13 = 0 AS skipped FROM events)
    SELECT CASE p WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'S' END AS path, kind,
      COUNT(*) FILTER (NOT skipped AND passed) AS passed, COUNT(*) FILTER (NOT skipped) AS total,
      COUNT(*) FILTER (skipped) AS skipped, round(1000 * AVG(s) FILTER (NOT skipped), 6) AS avg_ms,
      round(1000 * list_sort(list(s) FILTER (NOT skipped))[CAST(floor(0.95 * (COUNT(s) FILTER (NOT skipped) - 1)) AS BIGINT) + 1], 6) AS p95_ms
    FROM r GROUP BY ALL""",
)
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    """events as case results: value = latency and outcome, every thirteenth skipped."""
    p = F.col("user_id") % 3
    results = A.table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(p == 0, "A").when(p == 1, "B").otherwise("S").alias("path"),
        F.col("event_type").alias("kind"),
        (F.col("value") > 20).alias("passed"),
        (F.col("event_id") % 13 == 0).alias("skipped"),
        (F.col("value") / 1000).alias("latency_s"),
    )
    return evalkit.report(results)


@query(
    "report_lines",
    f"""WITH r AS (
      SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'attribution' WHEN 1 THEN 'retrieval' ELSE 'synthesis' END AS kind,
        user_id % 3 + CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN 2 ELSE 3 END AS section,
        value / 1000 AS s, value > 20 AS passed, event_type = 'error' AS skipped FROM events
    ), g AS (
      SELECT kind, section, COUNT(*) FILTER (NOT skipped AND passed) AS passed, COUNT(*) FILTER (NOT skipped) AS total,
        round(1000 * AVG(s) FILTER (NOT skipped), 6) AS avg_ms,
        1000 * list_sort(list(s) FILTER (NOT skipped))[CAST(floor(0.95 * (COUNT(s) FILTER (NOT skipped) - 1)) AS BIGINT) + 1] AS p95_ms
      FROM r GROUP BY ALL
    ), l AS (
      SELECT 0 AS section, 0 AS part, '' AS id, '# Events' AS line UNION ALL SELECT 0, 1, '', ''
      UNION ALL SELECT section, 0, '', '## ' || kind || ' (A)' FROM g
      UNION ALL SELECT section, 1, '', '' FROM g
      UNION ALL SELECT section, 2, '', '**' || CAST(passed AS VARCHAR) || '/' || CAST(total AS VARCHAR) || '** passed - avg '
        || CAST(CAST(floor(avg_ms + 0.5) AS BIGINT) AS VARCHAR) || 'ms - p95 ' || CAST(CAST(floor(p95_ms + 0.5) AS BIGINT) AS VARCHAR) || 'ms' FROM g
      UNION ALL SELECT section, 3, '', '' FROM g
      UNION ALL SELECT section, 4, '', '| case | ok | detail | latency ms |' FROM g
      UNION ALL SELECT section, 5, '', '|---|---|---|---|' FROM g
      UNION ALL SELECT section, 6, CAST(event_id AS VARCHAR), '| ' || CAST(event_id AS VARCHAR) || ' | '
        || CASE WHEN skipped THEN 'skip' WHEN passed THEN 'yes' ELSE '**NO**' END || ' | d | '
        || CAST(CAST(floor(1000 * s + 0.5) AS BIGINT) AS VARCHAR) || ' |' FROM r
      UNION ALL SELECT section, 7, '', '' FROM g)
    SELECT CAST(section AS INTEGER) AS section, part, id, line FROM l""",
)
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """events as results of three kinds, every case with its latency."""
    p = F.col("user_id") % 3
    results = A.table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.lit("A").alias("path"),
        F.when(p == 0, "attribution").when(p == 1, "retrieval").otherwise("synthesis").alias("kind"),
        (F.col("value") > 20).alias("passed"),
        (F.col("event_type") == "error").alias("skipped"),
        F.lit("d").alias("detail"),
        (F.col("value") / 1000).alias("latency_s"),
    )
    return evalkit.report_lines(results, "Events")


@query(
    "trace_accounting",
    f"""WITH t AS (
      SELECT event_type AS stage, 'm' || CAST(user_id % 4 AS VARCHAR) AS model, value AS latency_ms,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens, user_id AS completion_tokens FROM events)
    SELECT stage, model, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens,
      CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens, round(AVG(latency_ms), 6) AS avg_latency_ms,
      {P95.format(value="latency_ms")} AS p95_latency_ms
    FROM t GROUP BY ALL""",
)
def trace_accounting(spark: SparkSession, folder: str) -> DataFrame:
    traces = A.table(spark, folder, "events").select(
        F.col("event_type").alias("stage"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.col("value").alias("latency_ms"),
        F.from_json("props", "k BIGINT")["k"].alias("prompt_tokens"),
        F.col("user_id").alias("completion_tokens"),
    )
    return stats.trace_accounting(traces)


# ------------------------------------------------------------------ recall

TRUTH_SQL = """truth AS (
  SELECT b.item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS INTEGER) AS nth,
    lpad(CAST(doc_id AS VARCHAR), 9, '0') AS expected_id
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)
), hit_ids AS (SELECT query_id, rank, lpad(CAST(chunk_id AS VARCHAR), 9, '0') AS hit_id FROM sparse WHERE rank <= 10)"""


INNER = 3


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a whole passage.

    The first and last word of a passage may go on in the text; the others are whole words there too.  So
    passage and text meet in an equi-join on three inner words in a row, and only those pairs are compared
    in full.  Passages with fewer inner words are a checked small set that is held against every text.
    """
    words = F.col("words")
    run = lambda i: F.xxhash64(F.array_join(F.slice(words, i, INNER), " "))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (INNER - 1), F.lit(1))), run)
    split = F.split("text", r"\s+")
    asked = A.table(spark, folder, "benchmark").where(F.col("text").isNotNull()).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("passage"), split.alias("words")
    )
    long = F.size("words") >= INNER + 2
    keys = retrieval.broadcast_if_small(asked.where(long).select("query_id", run(F.lit(2)).alias("inner")))
    short = retrieval.broadcast_if_small(asked.where(~long).select("query_id", "passage"))
    docs = A.documents(spark, folder).select("doc_id", "text")
    candidates = (
        docs.select("doc_id", split.alias("words"))
        .select("doc_id", F.explode_outer(F.array_distinct(runs)).alias("inner"))
        .join(keys, "inner")
        .select("query_id", "doc_id")
    )
    met = (
        candidates.join(asked.select("query_id", "passage"), "query_id")
        .join(docs, "doc_id")
        .where(F.col("text").contains(F.col("passage")))
        .select("query_id", "doc_id")
        .unionByName(docs.join(short, F.col("text").contains(F.col("passage"))).select("query_id", "doc_id"))
    )
    return met.select(
        "query_id",
        F.col("doc_id").alias("nth"),
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("expected_id"),
        F.lit(10).alias("top_k"),
    )


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.sparse_topk(A.questions(spark, folder), A.doc_chunks(spark, folder), k=10)
    return hits.select(
        "query_id", "rank", F.lpad(F.col("chunk_id").cast("string"), 9, "0").alias("hit_id")
    )


@query(
    "recall_at_k",
    f"""WITH {R.LEXICAL_SQL}, {TRUTH_SQL}, m AS (
      SELECT t.query_id, expected_id AS matched_id, rank AS matched_rank FROM truth t JOIN hit_ids h ON h.query_id = t.query_id AND starts_with(hit_id, expected_id)
      QUALIFY row_number() OVER (PARTITION BY t.query_id ORDER BY nth, rank) = 1)
    SELECT DISTINCT t.query_id, 10 AS top_k, m.matched_id, CAST(coalesce(m.matched_rank, -1) AS INTEGER) AS matched_rank, m.query_id IS NOT NULL AS found
    FROM truth t LEFT JOIN m USING (query_id)""",
)
def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = evalkit.recall_at_k(truth(spark, folder), _hits(spark, folder))
    return rows.withColumn("matched_rank", F.coalesce("matched_rank", F.lit(-1)))


def _case_lines(spark: SparkSession, folder: str) -> DataFrame:
    """benchmark items as JSON case lines; ten items are followed by a blank or comment line."""
    expected = truth(spark, folder).groupBy("query_id").agg(
        F.array_sort(F.collect_list("expected_id")).alias("expected_shas")
    )
    case = F.struct(
        F.concat(F.lit("case"), F.col("item_id").cast("string")).alias("id"),
        F.lit("B").alias("path"),
        F.when(F.col("expected_shas").isNull(), "known_gap").otherwise("retrieval").alias("kind"),
        F.lit("src").alias("repo"),
        F.col("text").alias("query"),
        F.lit(10).alias("top_k"),
        F.coalesce("expected_shas", F.array(F.lit("missing"))).alias("expected_shas"),
        F.lit("verified absent").alias("note"),
    )
    items = A.table(spark, folder, "benchmark").join(
        expected, F.col("query_id") == F.col("item_id"), "left"
    )
    padding = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("  "), F.lit("# note"))).otherwise(
        F.array().cast("array<string>")
    )
    return items.select(F.explode(F.concat(F.array(F.to_json(case)), padding)).alias("value"))


@query(
    "eval_cases",
    f"""WITH {R.LEXICAL_SQL}, {TRUTH_SQL}, e AS (SELECT query_id, string_agg(expected_id, ',' ORDER BY expected_id) AS ids FROM truth GROUP BY ALL)
    SELECT 'case' || CAST(item_id AS VARCHAR) AS id, CASE WHEN ids IS NULL THEN 'known_gap' ELSE 'retrieval' END AS kind,
      md5(text) AS query_digest, coalesce(ids, 'missing') AS expected FROM benchmark LEFT JOIN e ON query_id = item_id""",
)
def eval_cases(spark: SparkSession, folder: str) -> DataFrame:
    cases = evalkit.parse_cases(_case_lines(spark, folder))
    return cases.select(
        "id", "kind", F.md5("query").alias("query_digest"), F.array_join("expected_shas", ",").alias("expected")
    )


@query(
    "score_retrieval",
    f"""WITH {R.LEXICAL_SQL}, {TRUTH_SQL}, ranked AS (
      SELECT t.query_id, expected_id, rank FROM truth t JOIN hit_ids h ON h.query_id = t.query_id AND starts_with(hit_id, expected_id)
      QUALIFY row_number() OVER (PARTITION BY t.query_id ORDER BY nth, rank) = 1)
    SELECT 'case' || CAST(item_id AS VARCHAR) AS id, 'B' AS path,
      CASE WHEN t.query_id IS NULL THEN 'known_gap' ELSE 'retrieval' END AS kind,
      t.query_id IS NULL OR r.query_id IS NOT NULL AS passed, false AS skipped,
      CASE WHEN t.query_id IS NULL THEN 'gap confirmed (truth absent from corpus); verified absent'
        WHEN r.query_id IS NULL THEN 'no match in top 10'
        ELSE 'matched ' || r.expected_id || ' at rank ' || CAST(r.rank AS VARCHAR) END AS detail
    FROM benchmark b LEFT JOIN (SELECT DISTINCT query_id FROM truth) t ON t.query_id = b.item_id
    LEFT JOIN ranked r ON r.query_id = b.item_id""",
)
def score_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    cases = evalkit.parse_cases(_case_lines(spark, folder))
    hits = _hits(spark, folder).withColumn("id", F.concat(F.lit("case"), F.col("query_id").cast("string")))
    return evalkit.score_retrieval(cases, hits.select("id", "rank", "hit_id"))


def _order_cases(spark: SparkSession, folder: str) -> DataFrame:
    """orders as attribution (even) and abstention (odd) cases."""
    key = F.col("o_orderkey")
    return A.table(spark, folder, "orders").select(
        key.cast("string").alias("id"),
        F.lit("A").alias("path"),
        F.when(key % 2 == 0, evalkit.ATTRIBUTION).otherwise(evalkit.ABSTENTION).alias("kind"),
        F.md5((key - key % 3).cast("string")).alias("expected_sha"),
        F.when(F.col("o_orderstatus") == "P", "answered").otherwise("abstained").alias("expect_status"),
        F.md5(key.cast("string")).alias("_sha"),
        "o_orderpriority",
    )


def _order_answers(spark: SparkSession, folder: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return _order_cases(spark, folder).select(
        "id",
        F.when(urgent, "answered").otherwise("abstained").alias("status"),
        F.when(~urgent, F.lit("no_significant_history")).alias("reason"),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.left("_sha", F.lit(9))).alias("introduced_id"),
    )


@query(
    "score_attribution",
    """WITH o AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey - o_orderkey % 3 AS VARCHAR)) AS expected,
      CASE WHEN o_orderpriority != '2-HIGH' THEN left(md5(CAST(o_orderkey AS VARCHAR)), 9) END AS got,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'answered' ELSE 'abstained' END AS status FROM orders WHERE o_orderkey % 2 = 0)
    SELECT CAST(k AS VARCHAR) AS id, 'A' AS path, 'attribution' AS kind, coalesce(starts_with(got, left(expected, 9)), false) AS passed,
      false AS skipped, CASE WHEN coalesce(starts_with(got, left(expected, 9)), false) THEN 'introduced ' || got
        ELSE 'expected ' || expected || ', got ' || coalesce(got, 'none') || ' (' || status || ')' END AS detail FROM o""",
)
def score_attribution(spark: SparkSession, folder: str) -> DataFrame:
    return evalkit.score_attribution(_order_cases(spark, folder), _order_answers(spark, folder))


@query(
    "score_abstention",
    """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'answered' ELSE 'abstained' END AS expected,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'answered' ELSE 'abstained' END AS status,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'none' ELSE 'no_significant_history' END AS reason FROM orders WHERE o_orderkey % 2 = 1)
    SELECT CAST(k AS VARCHAR) AS id, 'A' AS path, 'abstention' AS kind, status = expected AS passed, false AS skipped,
      'status=' || status || ' reason=' || reason AS detail FROM o""",
)
def score_abstention(spark: SparkSession, folder: str) -> DataFrame:
    return evalkit.score_abstention(_order_cases(spark, folder), _order_answers(spark, folder))


@query(
    "score_synthesis",
    f"""WITH {R.CITED_SQL}, cited AS (SELECT question_id, evidence_id FROM direct UNION ALL SELECT question_id, evidence_id FROM fallback
    ), c AS (
      SELECT question_id AS id, conv_id, CASE WHEN turn % 2 = 0 THEN 'answer' ELSE 'abstain' END AS expect, status, turn % 7 = 6 AS skipped,
        CASE WHEN EXISTS (SELECT 1 FROM cited x WHERE x.question_id = k.question_id
          AND (x.evidence_id = 'pr:' || CAST(conv_id AS VARCHAR) OR starts_with(x.evidence_id, 'pr:' || CAST(conv_id AS VARCHAR) || '#'))) THEN 0 ELSE 1 END AS missing
      FROM checked k)
    SELECT id, 'S' AS path, 'synthesis' AS kind,
      coalesce(CASE WHEN skipped THEN false WHEN expect = 'abstain' THEN status = 'abstained'
        ELSE status = 'answered' AND missing = 0 END, false) AS passed, skipped,
      CASE WHEN skipped THEN 'llm_unavailable' ELSE 'status=' || status || ' missing=' || CAST(missing AS VARCHAR) END AS detail
    FROM c""",
)
def score_synthesis(spark: SparkSession, folder: str) -> DataFrame:
    return evalkit.score_synthesis(*_synthesis(spark, folder))


def _synthesis(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversation answers as synthesis cases; a seventh of the turns has no answer."""
    answers = R._answers(spark, folder)
    turn = F.split_part("question_id", F.lit("-"), F.lit(2)).cast("int")
    cases = answers.select(
        F.col("question_id").alias("id"),
        F.lit("S").alias("path"),
        F.lit("synthesis").alias("kind"),
        F.when(turn % 2 == 0, "answer").otherwise("abstain").alias("expect"),
        F.array(F.concat(F.lit("pr:"), F.col("conv_id").cast("string"))).alias("expected_citations"),
    )
    checked = citations.answer_status(answers)
    cited = citations.citations(checked, R._answer_ids(spark, folder)).withColumnRenamed("question_id", "id")
    present = checked.where(turn % 7 != 6).withColumnRenamed("question_id", "id")
    return cases, present, cited


@query(
    "eval_run",
    f"""SELECT s.*, o_totalprice / 1000000 AS latency_s FROM (
      SELECT * FROM ({ORACLES["score_attribution"]}) UNION ALL SELECT * FROM ({ORACLES["score_abstention"]})
      UNION ALL SELECT * FROM ({ORACLES["score_retrieval"]}) UNION ALL SELECT * FROM ({ORACLES["score_synthesis"]})
    ) s LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = s.id""",
)
def eval_run(spark: SparkSession, folder: str) -> DataFrame:
    """One case table of all kinds, scored in one run; the order cases have a latency."""
    synthesis, checked, cited = _synthesis(spark, folder)
    cases = evalkit.parse_cases(_case_lines(spark, folder))
    for more in (_order_cases(spark, folder).drop("_sha", "o_orderpriority"), synthesis):
        cases = cases.unionByName(more, allowMissingColumns=True)
    hits = _hits(spark, folder).withColumn("id", F.concat(F.lit("case"), F.col("query_id").cast("string")))
    latencies = A.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), (F.col("o_totalprice") / 1_000_000).alias("latency_s")
    )
    return evalkit.run(cases, _order_answers(spark, folder), hits.select("id", "rank", "hit_id"), checked, cited, latencies)


# ------------------------------------------------------------------ streaming


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables as a file stream."""
    schema = A.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


@query(
    "stream_ingest_commits",
    """SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderkey % 100 = 0 AS undated,
      CASE WHEN o_orderkey = 0 THEN 0 WHEN o_orderkey // 2 = o_orderkey // 3 THEN 1 ELSE 2 END AS parents, len(string_split(o_orderpriority, '-')) AS changes FROM orders""",
)
def stream_ingest_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Land orders as JSON log records, ingest them twice, read the tables back."""
    base = _scratch(spark, "commits")
    log = H.commit_log(spark, folder)
    log.write.json(f"{base}/landed")
    for run in ("first", "again"):
        ingest.ingest_commits(spark, f"{base}/landed", f"{base}/tables", f"{base}/progress-{run}").awaitTermination()
    stored = sinks.read_table(spark, f"{base}/tables/commits", schemas.COMMITS)
    key = ["repo_id", "sha"]
    parents = (
        sinks.read_table(spark, f"{base}/tables/commit_parents", schemas.COMMIT_PARENTS)
        .groupBy("repo_id", F.col("child_sha").alias("sha"))
        .agg(F.count(F.lit(1)).cast("int").alias("parents"))
    )
    changes = (
        sinks.read_table(spark, f"{base}/tables/file_changes", schemas.FILE_CHANGES)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("changes"))
    )
    return (
        stored.join(parents, key, "left")
        .join(changes, key, "left")
        .select("sha", F.col("committed_at").isNull().alias("undated"), F.coalesce("parents", F.lit(0)).alias("parents"), "changes")
    )


@query(
    "stream_label_counts",
    """SELECT CAST(user_id % 25 AS INTEGER) AS repo_id, event_type AS label, COUNT(*) AS commits FROM events GROUP BY ALL""",
)
def stream_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Running label counts of the event stream; every trigger replaces the small result."""
    base = _scratch(spark, "labels")
    labels = _stream(spark, folder, "events").select(
        (F.col("user_id") % 25).cast("int").alias("repo_id"), F.col("event_type").alias("label")
    )

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/counts")

    (
        ingest.label_counts(labels)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{base}/counts")


@query(
    "stream_distinct_commits",
    """SELECT DISTINCT CAST(user_id % 25 AS INTEGER) AS repo_id, md5(CAST(event_id // 2 AS VARCHAR)) AS sha
    FROM (SELECT event_id, FIRST_VALUE(user_id) OVER (PARTITION BY event_id // 2 ORDER BY event_id) AS user_id FROM events)""",
)
def stream_distinct_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Two neighbouring events carry the same hash; the stream keeps one of them."""
    base = _scratch(spark, "distinct")
    events = _stream(spark, folder, "events")
    half = F.floor(F.col("event_id") / 2)
    owners = A.table(spark, folder, "events").groupBy(half.alias("half")).agg(
        F.min_by("user_id", "event_id").alias("owner")
    )
    commits = events.withColumn("half", half).join(owners, "half").select(
        (F.col("owner") % 25).cast("int").alias("repo_id"),
        F.md5(F.col("half").cast("string")).alias("sha"),
        F.col("ts").cast("timestamp").alias("committed_at"),
    )
    (
        ingest.distinct_commits(commits)
        .writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{base}/rows").select("repo_id", "sha")


@query(
    "stream_embed_new",
    rf"""WITH t AS (
      SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS repo_id,
        [w for w in regexp_extract_all(lower(lang || ' ' || text), '[\p{{L}}\p{{N}}_]+') if w NOT IN ({A.sql_list(C.STOP_WORDS)})] AS tokens
      FROM documents
    ), alive AS (SELECT p_partkey AS n, p_size < 25 AS here FROM part),
    live AS (
      SELECT doc_id, AVG(CASE WHEN here AND n % 25 = repo_id THEN 1.0 ELSE 0.0 END) AS liveness
      FROM (SELECT doc_id, repo_id, unnest([doc_id % 200, doc_id % 200 // 25 * 25 + repo_id, repo_id]) AS part FROM t) LEFT JOIN alive ON n = part
      GROUP BY doc_id)
    SELECT repo_id, 'd' || CAST(doc_id AS VARCHAR) AS source_id, 384 AS dim, 'hashing-384' AS embedding_model,
      md5(array_to_string(tokens, ' ')) AS tokens_digest, round(liveness, 6) AS liveness_score, liveness < 0.34 AS stale
    FROM t JOIN live USING (doc_id)""",
)
def stream_embed_new(spark: SparkSession, folder: str) -> DataFrame:
    """Documents stream into the chunk table with vector, tokens and liveness; a second query finds nothing new.

    A document has three parts as files; a part exists in one repository, when it is small.
    """
    base = _scratch(spark, "embed")
    drafts = _stream(spark, folder, "documents").select(
        F.expr("CAST(substring(source, 4) AS INT)").alias("repo_id"),
        F.lit("doc_file").alias("source_type"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"),
        F.lit(None).cast("timestamp").alias("authored_at"),
        F.col("lang").alias("title"),
        F.col("text").alias("body"),
        F.array().cast("array<string>").alias("files_head"),
        F.lit(0).alias("n_files"),
        F.lit(None).cast("string").alias("linked_sha"),
    )
    doc, repo = F.col("doc_id"), F.expr("CAST(substring(source, 4) AS INT)")
    held = F.array(doc % 200, F.floor(doc % 200 / 25) * 25 + repo, repo.cast("long"))
    path = F.explode(F.transform(held, lambda n: F.concat(F.lit("p"), n.cast("string"))))
    files = A.table(spark, folder, "documents").select(
        repo.alias("repo_id"),
        F.lit("doc_file").alias("source_type"),
        F.concat(F.lit("d"), doc.cast("string")).alias("source_id"),
        path.alias("path"),
    )
    alive = A.table(spark, folder, "part").where("p_size < 25").select(
        (F.col("p_partkey") % 25).cast("int").alias("repo_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path")
    )
    for run in ("first", "again"):
        ingest.embed_new(
            spark, drafts.select(*chunks.CHUNK_COLUMNS), f"{base}/chunks", f"{base}/progress-{run}", files=files, alive=alive
        ).awaitTermination()
    stored = sinks.read_table(spark, f"{base}/chunks", schemas.CHUNKS, sinks.CHUNK_PARTITIONS)
    return snapshot.with_stale(stored).select(
        "repo_id",
        "source_id",
        F.size("embedding").alias("dim"),
        "embedding_model",
        F.md5(F.array_join("tokens", " ")).alias("tokens_digest"),
        F.round("liveness_score", 6).alias("liveness_score"),
        "stale",
    )


@query(
    "stream_backfill_prs",
    """SELECT conv_id * 100 + turn AS number, role AS title, md5(text) AS merge_sha FROM conversations""",
)
def stream_backfill_prs(spark: SparkSession, folder: str) -> DataFrame:
    """Land conversation turns as pages, backfill them some pages at a time, resume once."""
    base = _scratch(spark, "prs")
    _page_json(spark, folder).repartition(4).write.json(f"{base}/landed")
    for _ in range(2):
        ingest.backfill_prs(
            spark, f"{base}/landed", f"{base}/tables", 0, f"{base}/progress", max_pages=2
        ).awaitTermination()
    rows = ingest.stored_prs(spark, f"{base}/tables")
    return rows.select("number", "title", "merge_sha")


@query(
    "stream_backfill_counts",
    """SELECT COUNT(*) AS pages, COUNT(*) AS fetched, COUNT(DISTINCT conv_id * 100 + turn % 3) AS stored_new FROM conversations""",
)
def stream_backfill_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose requests come again on later pages: the counters of all batches, added up."""
    base = _scratch(spark, "counts")
    number = F.col("conv_id") * 100 + F.col("turn") % 3
    node = F.struct(
        number.alias("number"), F.col("role").alias("title"), F.col("text").alias("body"), F.lit("2024-01-01T00:00:00Z").alias("createdAt")
    )
    page = F.struct(F.struct(F.struct(F.struct(F.array(node).alias("nodes")).alias("pullRequests")).alias("repository")).alias("data"))
    A.table(spark, folder, "conversations").select(page.alias("p")).select("p.*").repartition(4).write.json(f"{base}/landed")
    ingest.backfill_prs(spark, f"{base}/landed", f"{base}/tables", 0, f"{base}/progress", max_pages=1).awaitTermination()
    counts = ingest.backfill_counts(spark, f"{base}/tables")
    return counts.agg(*[F.sum(c).alias(c) for c in ("pages", "fetched", "stored_new")])


@query(
    "append_idempotent",
    f"""WITH {A.COMMITS_SQL} SELECT repo_id, COUNT(*) AS commits FROM commits GROUP BY ALL""",
)
def append_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    """The same batch appended twice is stored once."""
    base = _scratch(spark, "append")
    batch = history.commits(H.commit_log(spark, folder)).drop("repo_id")
    rows = A.commits(spark, folder).select("repo_id", "sha").join(batch, "sha")
    for _ in range(2):
        sinks.append_new(spark, rows, f"{base}/commits", schemas.COMMITS, ["repo_id", "sha"])
    stored = sinks.read_table(spark, f"{base}/commits", schemas.COMMITS)
    return stored.groupBy("repo_id").agg(F.count(F.lit(1)).alias("commits"))


@query(
    "append_traces",
    """SELECT event_type AS stage, COUNT(*) AS calls, CAST(SUM(floor(value)) AS BIGINT) AS latency_ms FROM events GROUP BY ALL""",
)
def append_traces(spark: SparkSession, folder: str) -> DataFrame:
    """events appended to the trace table and read back."""
    base = _scratch(spark, "traces")
    nothing = F.lit(None)
    rows = A.table(spark, folder, "events").select(
        F.col("event_type").alias("stage"),
        F.lit("m").alias("model"),
        nothing.cast("string").alias("prompt"),
        nothing.cast("string").alias("response"),
        F.floor("value").cast("int").alias("latency_ms"),
        nothing.cast("int").alias("prompt_tokens"),
        nothing.cast("int").alias("completion_tokens"),
        nothing.cast("string").alias("eval_case_id"),
        nothing.cast("int").alias("repo_id"),
        F.col("props").alias("extra"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    sinks.append_traces(rows, f"{base}/traces")
    stored = sinks.read_table(spark, f"{base}/traces", schemas.TRACES, partitions=())
    return stored.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("latency_ms").alias("latency_ms")
    )
