"""Answer texts checked against the evidence they may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.functions import text as X


def answer_status(answers: DataFrame) -> DataFrame:
    """Status, reason, text and diagram of every (question_id, answer) row."""
    answer = F.coalesce("answer", F.lit(""))
    insufficient = answer.startswith(C.INSUFFICIENT_PREFIX)
    empty = X.is_blank(answer)
    answered = ~(insufficient | empty)
    return answers.select(
        "question_id",
        F.when(answered, C.ANSWERED).otherwise(C.ABSTAINED).alias("status"),
        F.when(insufficient, answer).when(empty, C.EMPTY_GENERATION).alias("reason"),
        F.when(answered, X.without_mermaid(answer)).alias("answer_text"),
        F.when(answered, X.mermaid_block(answer)).alias("diagram"),
    )


def _cites(answer: Column, evidence_id: Column) -> Column:
    opened = F.concat(F.lit("["), evidence_id)
    whole = answer.contains(F.concat(opened, F.lit("]"))) | (
        ~evidence_id.contains("#") & answer.contains(F.concat(opened, F.lit("#")))
    )
    return F.when(evidence_id.startswith("pr:"), whole).otherwise(answer.contains(opened))


def citations(checked: DataFrame, evidence_ids: DataFrame) -> DataFrame:
    """(question_id, evidence_id, direct): ids cited as `[id`, else `#N` mentions among the hits.

    A hash may be cited with more digits than are shown; a request id must end there or at its part
    (`#`), so `[pr:71]` does not cite `pr:7`.  One row per citation, so no answer gathers its evidence
    in one cell.
    """
    answered = checked.where(F.col("status") == C.ANSWERED).select("question_id", "answer_text")
    ids = evidence_ids.select("question_id", "evidence_id").distinct()
    direct = (
        answered.join(ids, "question_id")
        .where(_cites(F.col("answer_text"), F.col("evidence_id")))
        .select("question_id", "evidence_id")
    )
    mentioned = (
        answered.join(direct, "question_id", "left_anti")
        .select("question_id", F.explode(X.pr_mentions("answer_text")).alias("number"))
        .select("question_id", F.concat(F.lit("pr:"), F.col("number").cast("string")).alias("evidence_id"))
    )
    hit_requests = ids.where(F.col("evidence_id").startswith("pr:")).select(
        "question_id", F.substring_index("evidence_id", "#", 1).alias("evidence_id")
    ).distinct()
    fallback = mentioned.join(hit_requests, ["question_id", "evidence_id"], "left_semi")
    return direct.withColumn("direct", F.lit(True)).unionByName(
        fallback.withColumn("direct", F.lit(False))
    )


def check(answers: DataFrame, evidence_ids: DataFrame) -> DataFrame:
    """Answer status with the number of citations."""
    checked = answer_status(answers)
    counted = citations(checked, evidence_ids).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("citations"), F.bool_and("direct").alias("direct")
    )
    return checked.join(counted, "question_id", "left").withColumn(
        "citations", F.coalesce("citations", F.lit(0))
    )
