"""Significance labels: pure functions of stored features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelore import constants as C

KEY = ["repo_id", "sha"]


def floor_label() -> Column:
    return (
        F.when(F.col("pure_rename"), C.SIGNIFICANT)
        .when(F.col("whitespace_only"), C.INSIGNIFICANT_WHITESPACE)
        .when(F.col("comment_only"), C.INSIGNIFICANT_COMMENT)
        .otherwise(C.SIGNIFICANT)
    )


def layered_label() -> Column:
    """The floor label, refined by the format verdict; NULL means not applicable."""
    formatted = F.coalesce(F.col("ast_format_only"), F.lit(False))
    floor = floor_label()
    return F.when((floor == C.SIGNIFICANT) & formatted, C.INSIGNIFICANT_FORMAT).otherwise(floor)


def floor_labels(features: DataFrame) -> DataFrame:
    return features.select(
        *KEY, floor_label().alias("label"), F.lit(C.RULE_FLOOR).alias("rule_version")
    )


def relabel(features: DataFrame) -> DataFrame:
    """Layered labels from stored features: a projection, history is not read again."""
    return features.select(
        *KEY, layered_label().alias("label"), F.lit(C.RULE_LAYERED).alias("rule_version")
    )


def backfill(features: DataFrame, verdicts: DataFrame, force: bool = False) -> DataFrame:
    """Set the format verdict of the rows that have none yet (`force`: of all rows)."""
    pending = F.lit(True) if force else F.col("ast_extractor_version").isNull()
    judged = verdicts.select(*KEY, F.col("ast_format_only").alias("_verdict"))
    return (
        features.withColumn("_pending", pending)
        .join(judged, KEY, "left")
        .withColumn(
            "ast_format_only",
            F.when(F.col("_pending"), F.col("_verdict")).otherwise(F.col("ast_format_only")),
        )
        .withColumn(
            "ast_extractor_version",
            F.when(F.col("_pending"), F.lit(C.FORMAT_VERSION)).otherwise(
                F.col("ast_extractor_version")
            ),
        )
        .drop("_pending", "_verdict")
    )


def relabel_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per repository and new label: commits, and how many changed their label."""
    before = old.select(*KEY, F.col("label").alias("_old"))
    return (
        new.join(before, KEY, "left")
        .groupBy("repo_id", "label")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.count_if(~F.col("label").eqNullSafe(F.col("_old"))).alias("relabeled"),
        )
    )
