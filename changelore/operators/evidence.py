"""Bounded evidence texts and timeline views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.functions import text as X
from changelore.operators import retrieval, skew

_BUNDLE_WITH_SNIPPETS = C.MAX_BUNDLE + C.MAX_SNIPPETS * C.SNIPPET_CHARS


def _entry(evidence_id: Column, date: Column, rest: Column, body_lines: Column) -> Column:
    """One cited entry: `[id] date rest`, indented body lines, an empty line."""
    dated = F.concat(
        F.lit("["), evidence_id, F.lit("]"), F.coalesce(F.concat(F.lit(" "), date), F.lit("")), F.lit(" "), rest
    )
    return F.concat_ws("\n", F.array(dated), body_lines, F.array(F.lit("")))


def _joined(rank: str, text: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(rank, text)))
    return F.array_join(F.transform(ordered, lambda e: e[text]), "\n")


def bundle(anchors: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence text per symbol question: the first fourteen entries, oldest first.

    `anchors`: question_id, symbol and the located path, start_line, end_line
    (NULL when unresolved).  Only fourteen rows per question are ever gathered.
    """
    prs = F.coalesce(
        F.concat(F.lit(" (PR #"), F.col("pr_ref").cast("string"), F.lit(")")), F.lit("")
    )
    body = X.ellipsis(X.strip(F.coalesce("body", F.lit(""))), C.MAX_EVIDENCE_BODY)
    indented = F.transform(
        F.filter(F.transform(X.lines(body), X.strip), lambda b: b != ""),
        lambda b: F.concat(F.lit("    "), b),
    )
    rest = F.concat(F.coalesce("author", F.lit("unknown")), prs, F.lit(": "), "subject")
    head = skew.top_per_key(
        evidence, ["question_id"], [F.col("ord"), F.col("full_sha")], C.MAX_EVIDENCE_COMMITS, "_rank"
    )
    entries = (
        head.withColumn("_entry", _entry(F.col("evidence_id"), F.col("committed_on"), rest, indented))
        .groupBy("question_id")
        .agg(_joined("_rank", "_entry").alias("_entries"))
    )
    anchor = F.when(
        F.col("path").isNotNull(),
        F.concat(
            F.lit("Anchor: "),
            "path",
            F.lit(":"),
            F.col("start_line").cast("string"),
            F.lit("-"),
            F.col("end_line").cast("string"),
        ),
    ).otherwise(F.lit("Anchor: unresolved"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Question: why does "), "symbol", F.lit(" exist?")),
        anchor,
        F.lit(""),
        F.lit("Evidence (chronological):"),
        F.col("_entries"),
    )
    return anchors.join(entries, "question_id", "left").select(
        "question_id", X.cut(text, C.MAX_BUNDLE).alias("bundle")
    )


def link_prefix_join(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(question_id, repo_id, pr_number): links of the commits shown, by their full hash.

    Nine shown digits name several commits in a large repository.
    """
    linked = links.select("repo_id", F.col("sha").alias("full_sha"), "pr_number").distinct()
    return (
        evidence.select("question_id", "repo_id", "full_sha")
        .join(linked, ["repo_id", "full_sha"])
        .select("question_id", "repo_id", "pr_number")
        .distinct()
    )


def discussion_snippets(evidence: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """First discussion chunk of the three lowest linked merge requests per question."""
    linked = skew.top_per_key(
        link_prefix_join(evidence, links),
        ["question_id"],
        [F.col("pr_number"), F.col("repo_id")],
        C.MAX_SNIPPETS,
        "nth",
    )
    first = (
        chunks.where(F.col("source_type") == C.SOURCE_PR_DISCUSSION)
        .select(
            "repo_id",
            F.regexp_extract("source_id", r"^pr:([0-9]+)#", 1).cast("long").alias("pr_number"),
            "source_id",
            "body",
        )
        .groupBy("repo_id", "pr_number")
        .agg(F.min_by("body", "source_id").alias("body"))
    )
    text = X.cut(X.strip(F.coalesce("body", F.lit(""))), C.SNIPPET_CHARS)
    return (
        linked.join(first, ["repo_id", "pr_number"])
        .select(
            "question_id",
            "nth",
            F.concat(F.lit("pr:"), F.col("pr_number").cast("string")).alias("evidence_id"),
            text.alias("snippet"),
        )
        .where(F.col("snippet") != "")
    )


def with_snippets(bundles: DataFrame, snippets: DataFrame) -> DataFrame:
    """Append the linked discussion excerpts under their citable ids."""
    entry = F.concat_ws(
        "\n", F.concat(F.lit("["), "evidence_id", F.lit("]")), F.col("snippet"), F.lit("")
    )
    excerpts = (
        snippets.withColumn("_entry", entry)
        .groupBy("question_id")
        .agg(_joined("nth", "_entry").alias("_excerpts"))
    )
    enriched = F.concat_ws(
        "\n", F.col("bundle"), F.lit(""), F.lit("Linked PR discussion excerpts:"), F.col("_excerpts")
    )
    return bundles.join(excerpts, "question_id", "left").select(
        "question_id",
        F.when(F.col("_excerpts").isNull(), F.col("bundle"))
        .otherwise(X.cut(enriched, _BUNDLE_WITH_SNIPPETS))
        .alias("bundle"),
    )


def hits_bundle(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Evidence text per prose question: its first ten hits in rank order.

    `hits`: query_id, rank, source_type, source_id, authored_at, title, body.
    """
    body = X.ellipsis(X.strip(F.coalesce("body", F.lit(""))), C.MAX_HIT_BODY)
    lines = F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("    "), body))
    )
    entries = (
        hits.where(F.col("rank") <= C.MAX_QUESTION_HITS)
        .withColumn(
            "_entry",
            _entry(
                retrieval.display_id("source_type", "source_id"),
                X.iso_date("authored_at"),
                X.cut(F.coalesce("title", F.lit("")), C.TITLE_SHOWN),
                lines,
            ),
        )
        .groupBy("query_id")
        .agg(_joined("rank", "_entry").alias("_entries"))
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Question: "), "question"),
        F.lit(""),
        F.lit("Evidence (ranked by relevance):"),
        F.col("_entries"),
    )
    return queries.join(entries, "query_id").select(
        "query_id", X.cut(text, C.MAX_BUNDLE).alias("bundle")
    )


def timeline_view(evidence: DataFrame, n: int | None = None) -> DataFrame:
    """Short rows of a timeline, oldest first; with `n`, the first n per question."""
    rows = evidence
    if n is not None:
        rows = skew.top_per_key(rows, ["question_id"], [F.col("ord"), F.col("full_sha")], n, "nth")
    return rows.select(
        "question_id", "evidence_id", "role", "subject", F.col("committed_on").alias("date"), "pr_ref"
    )


def arc(points: DataFrame, key: str = "question_id", at: str = "committed_at") -> DataFrame:
    """Position of every dated point between the first and the last one, 0.0 to 1.0.

    The bounds are a small aggregate joined back, not a window over each group.
    """
    seconds = F.unix_seconds(F.col(at)).cast("double")
    dated = points.where(F.col(at).isNotNull())
    bounds = dated.groupBy(key).agg(F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    position = F.when(span == 0, F.lit(0.0)).otherwise((seconds - F.col("_lo")) / span)
    return (
        dated.join(bounds, key)
        .withColumn("position", F.round(position, 6))
        .drop("_lo", "_hi")
    )
