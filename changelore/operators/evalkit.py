"""Evaluation: cases against results, recall, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import constants as C
from changelore import schemas
from changelore.functions import text as X
from changelore.operators import skew

ATTRIBUTION = "attribution"
ABSTENTION = "abstention"
RETRIEVAL = "retrieval"
KNOWN_GAP = "known_gap"
SYNTHESIS = "synthesis"

_ORDER = [ATTRIBUTION, ABSTENTION, RETRIEVAL, KNOWN_GAP, SYNTHESIS]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return parse_cases(spark.read.text(path))


def parse_cases(lines: DataFrame, column: str = "value") -> DataFrame:
    """One case per JSON line; blank lines and `#` comments are skipped."""
    text = X.strip(column)
    kept = lines.where((text != "") & ~text.startswith("#"))
    return kept.select(F.from_json(text, schemas.CASES).alias("c")).select("c.*")


def _names(expected: Column, found: Column) -> Column:
    """Whether a found id is the expected one: hashes agree on the shown digits, request ids up to their part."""
    request = (found == expected) | found.startswith(F.concat(expected, F.lit("#")))
    return F.when(expected.startswith("pr:"), request).otherwise(
        found.startswith(X.cut(expected, C.SHA_SHOWN))
    )


def matched_rank(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Best rank per query at which an expected id starts a hit's id.

    `expected`: query_id, nth, expected_id, top_k.  `hits`: query_id, rank, hit_id.
    The first listed id that occurs counts, as its best rank.  Hits per query
    are few, so both sides meet on query_id.
    """
    met = (
        expected.join(hits, "query_id")
        .where(
            _names(F.col("expected_id"), F.col("hit_id")) & (F.col("rank") <= F.col("top_k"))
        )
        .groupBy("query_id")
        .agg(F.min(F.struct("nth", "rank", "expected_id")).alias("m"))
    )
    return met.select(
        "query_id", F.col("m.expected_id").alias("matched_id"), F.col("m.rank").alias("matched_rank")
    )


def recall_at_k(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: found or not, and where."""
    queries = expected.select("query_id", "top_k").distinct()
    return queries.join(matched_rank(expected, hits), "query_id", "left").withColumn(
        "found", F.col("matched_rank").isNotNull()
    )


def score_attribution(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """`answers`: id, status, introduced_id."""
    rows = cases.where(F.col("kind") == ATTRIBUTION).join(answers, "id", "left")
    passed = F.coalesce(_names(F.col("expected_sha"), F.col("introduced_id")), F.lit(False))
    detail = F.when(passed, F.concat(F.lit("introduced "), "introduced_id")).otherwise(
        F.concat(
            F.lit("expected "),
            F.coalesce("expected_sha", F.lit("none")),
            F.lit(", got "),
            F.coalesce("introduced_id", F.lit("none")),
            F.lit(" ("),
            F.coalesce("status", F.lit("none")),
            F.lit(")"),
        )
    )
    return _results(rows, passed, detail)


def score_abstention(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """`answers`: id, status, reason."""
    rows = cases.where(F.col("kind") == ABSTENTION).join(answers, "id", "left")
    detail = F.concat(
        F.lit("status="),
        F.coalesce("status", F.lit("none")),
        F.lit(" reason="),
        F.coalesce("reason", F.lit("none")),
    )
    return _results(rows, F.col("status").eqNullSafe(F.col("expect_status")), detail)


def score_retrieval(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Retrieval and known-gap cases; a known gap always passes and says if it surfaced.

    `hits`: id, rank, hit_id.
    """
    asked = cases.where(F.col("kind").isin(RETRIEVAL, KNOWN_GAP))
    expected = asked.select(
        F.col("id").alias("query_id"),
        F.posexplode("expected_shas").alias("nth", "expected_id"),
        "top_k",
    )
    met = matched_rank(expected, hits.withColumnRenamed("id", "query_id")).withColumnRenamed(
        "query_id", "id"
    )
    rows = asked.join(met, "id", "left")
    is_gap = F.col("kind") == KNOWN_GAP
    found = F.col("matched_rank").isNotNull()
    gap_state = F.when(found, "expected commit surfaced anyway").otherwise("truth absent from corpus")
    detail = (
        F.when(
            is_gap,
            F.concat(
                F.lit("gap confirmed ("), gap_state, F.lit("); "), F.coalesce("note", F.lit(""))
            ),
        )
        .when(
            found,
            F.concat(
                F.lit("matched "), "matched_id", F.lit(" at rank "), F.col("matched_rank").cast("string")
            ),
        )
        .otherwise(F.concat(F.lit("no match in top "), F.col("top_k").cast("string")))
    )
    return _results(rows, is_gap | found, detail)


def score_synthesis(cases: DataFrame, checked: DataFrame, cited: DataFrame) -> DataFrame:
    """`checked`: id, status, reason (no row: the service failed, skipped);
    `cited`: id, evidence_id."""
    asked = cases.where(F.col("kind") == SYNTHESIS)
    wanted = asked.select("id", F.explode(F.array_distinct("expected_citations")).alias("wanted"))
    met = (
        wanted.join(cited, "id")
        .where(_names(F.col("wanted"), F.col("evidence_id")))
        .select("id", "wanted")
        .distinct()
    )
    missing = wanted.join(met, ["id", "wanted"], "left_anti").groupBy("id").agg(
        F.count(F.lit(1)).alias("missing")
    )
    present = checked.select("id", "status", "reason", F.lit(True).alias("_ran"))
    rows = asked.join(present, "id", "left").join(missing, "id", "left")
    wants_abstention = F.coalesce("expect", F.lit("answer")) == "abstain"
    no_missing = F.coalesce("missing", F.lit(0)) == 0
    passed = F.when(wants_abstention, F.col("status") == C.ABSTAINED).otherwise(
        (F.col("status") == C.ANSWERED) & no_missing
    )
    detail = F.when(F.col("_ran").isNull(), F.lit("llm_unavailable")).otherwise(
        F.concat(
            F.lit("status="),
            F.coalesce("status", F.lit("none")),
            F.lit(" missing="),
            F.coalesce("missing", F.lit(0)).cast("string"),
        )
    )
    return _results(rows, passed, detail, F.col("_ran").isNull())


def _results(
    rows: DataFrame, passed: Column, detail: Column, skipped: Column | None = None
) -> DataFrame:
    return rows.select(
        "id",
        "path",
        "kind",
        F.coalesce(passed, F.lit(False)).alias("passed"),
        (F.lit(False) if skipped is None else skipped).alias("skipped"),
        detail.alias("detail"),
    )


def run(
    cases: DataFrame,
    lineage_answers: DataFrame,
    hits: DataFrame,
    checked: DataFrame,
    cited: DataFrame,
    latencies: DataFrame | None = None,
) -> DataFrame:
    """Score every kind of case with one join each; a case of unknown kind fails the job."""
    known = F.coalesce(
        F.col("kind").isin(ATTRIBUTION, ABSTENTION, RETRIEVAL, KNOWN_GAP, SYNTHESIS), F.lit(False)
    )
    failure = F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("none"))))
    out = (
        score_attribution(cases, lineage_answers)
        .unionByName(score_abstention(cases, lineage_answers))
        .unionByName(score_retrieval(cases, hits))
        .unionByName(score_synthesis(cases, checked, cited))
        .unionByName(_results(cases.where(~known), F.lit(False), failure.cast("string")))
    )
    if latencies is None:
        return out.withColumn("latency_s", F.lit(None).cast("double"))
    return out.join(latencies.select("id", "latency_s"), "id", "left")


def report(results: DataFrame) -> DataFrame:
    """Per path and kind: passed, total, skipped, mean and p95 latency.

    The p95 is the element at the floored index, so with two cases it is the
    smaller one.
    """
    key = ["path", "kind"]
    counted = ~F.col("skipped")
    latency = F.when(counted, F.col("latency_s"))
    totals = results.groupBy(*key).agg(
        F.count_if(counted & F.col("passed")).alias("passed"),
        F.count_if(counted).alias("total"),
        F.count_if("skipped").alias("skipped"),
        F.round(1000 * F.avg(latency), 6).alias("avg_ms"),
    )
    p95 = skew.order_statistic(results.where(counted), key, "latency_s", 0.95, "_p95")
    return (
        totals.join(p95, key, "left")
        .withColumn("p95_ms", F.round(1000 * F.col("_p95"), 6))
        .drop("_p95")
    )


def report_lines(results: DataFrame, title: str) -> DataFrame:
    """The report as ordered lines: section, part, id, line."""
    number = F.lit(None).cast("int")
    for n, kind in reversed(list(enumerate(_ORDER))):
        number = F.when(F.col("kind") == kind, n + 1).otherwise(number)
    ms = "%.0f"
    score = F.format_string(
        f"**%d/%d** passed - avg {ms}ms - p95 {ms}ms",
        F.col("passed"),
        F.col("total"),
        F.coalesce("avg_ms", F.lit(0.0)),
        F.coalesce("p95_ms", F.lit(0.0)),
    )
    skipped = F.format_string("**SKIPPED (%d)**", F.col("skipped"))
    head = F.array(
        F.concat(F.lit("## "), "kind", F.lit(" ("), "path", F.lit(")")),
        F.lit(""),
        F.when(F.col("total") > 0, score).otherwise(skipped),
        F.lit(""),
        F.lit("| case | ok | detail | latency ms |"),
        F.lit("|---|---|---|---|"),
    )
    heads = report(results).select(
        number.alias("section"), F.posexplode(head).alias("part", "line")
    ).select("section", "part", F.lit("").alias("id"), "line")
    mark = F.when(F.col("skipped"), "skip").when(F.col("passed"), "yes").otherwise("**NO**")
    row = F.format_string(
        f"| %s | %s | %s | {ms} |", "id", mark, "detail", 1000 * F.coalesce("latency_s", F.lit(0.0))
    )
    rows = results.select(number.alias("section"), F.lit(6).alias("part"), "id", row.alias("line"))
    ends = heads.where(F.col("part") == 0).select(
        "section", F.lit(7).alias("part"), "id", F.lit("").alias("line")
    )
    top = results.sparkSession.createDataFrame(
        [(0, 0, "", f"# {title}"), (0, 1, "", "")], "section INT, part INT, id STRING, line STRING"
    )
    return top.unionByName(heads).unionByName(rows).unionByName(ends)


def write_report(results: DataFrame, title: str, path: str) -> None:
    """The report as text, sorted by range, so a large case table stays distributed."""
    lines = report_lines(results, title).orderBy("section", "part", "id")
    lines.select("line").write.mode("overwrite").text(path)


def report_markdown(results: DataFrame, title: str) -> str:
    """The report of a case table that people read, line by line."""
    lines = report_lines(results, title).orderBy("section", "part", "id")
    return "\n".join(r["line"] for r in lines.select("line").toLocalIterator())
