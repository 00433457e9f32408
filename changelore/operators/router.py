"""Route questions: symbol-shaped ones to lineage (A), prose to retrieval (B)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.functions import text as X
from changelore.runtime import checkpointed


def route(questions: DataFrame, question: str = "question") -> DataFrame:
    return questions.withColumn(
        "path", F.when(X.looks_like_symbol(question), F.lit("A")).otherwise(F.lit("B"))
    )


def answer(
    questions: DataFrame,
    by_lineage: Callable[[DataFrame], DataFrame],
    by_search: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Route a table of questions (question_id, question) and answer each branch by its own job.

    `by_lineage` turns the symbol-shaped questions, their name as `symbol`, into answers (`lineage.why` or
    `lineage.why_job`); `by_search` turns the others, their id as `query_id`, into outcomes
    (`retrieval.search_outcome`).  Further columns of the questions travel with them.
    """
    routed = checkpointed(route(questions))
    symbol = routed.where(F.col("path") == "A").withColumn("symbol", F.col("question")).drop("path")
    prose = routed.where(F.col("path") == "B").withColumnRenamed("question_id", "query_id").drop("path")
    return answer_batch(by_lineage(symbol), by_search(prose))


def answer_batch(lineage_answers: DataFrame, search_outcomes: DataFrame) -> DataFrame:
    """One result table from both branches: question_id, path, status, reason, evidence."""
    symbol = lineage_answers.select(
        "question_id", F.lit("A").alias("path"), "status", "reason", "evidence"
    )
    found = F.col("abstained_reason").eqNullSafe(F.lit(C.NO_HITS))
    prose = search_outcomes.select(
        F.col("query_id").alias("question_id"),
        F.lit("B").alias("path"),
        F.when(found, C.ABSTAINED).otherwise(C.ANSWERED).alias("status"),
        F.col("abstained_reason").alias("reason"),
        F.col("hits").alias("evidence"),
    )
    return symbol.unionByName(prose)
