"""Positional operators that stay parallel inside one huge group.

A plain window sorts a whole key group in one task.  These helpers cut every
group into buckets, work inside the buckets, and carry one small row per bucket
across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Dense 1-based numbers inside each key group, ordered by md5 bucket, then by `order`.

    The bucket is the first two digits of the md5 of the order columns; `order`
    must identify a row inside its group.
    """
    bucket = F.left(F.md5(F.concat_ws("|", *order)), F.lit(2))
    bucketed = df.withColumn("_b", bucket)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return (
        bucketed.withColumn("_rn", inside)
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_b", "_rn", "_offset")
    )


def carry_backward(
    df: DataFrame, keys: list[str], at: str, value: str, width: int, name: str
) -> DataFrame:
    """For every row, the nearest non-NULL `value` at a strictly later `at` of its key.

    `at` is a long; buckets are `width` wide.  Rows of one bucket are sorted in
    one task, buckets of one key only meet as one row each.
    """
    bucketed = df.withColumn("_b", F.floor(F.col(at) / F.lit(width)).cast("long"))
    later = (
        W.partitionBy(*keys, "_b")
        .orderBy(F.col(at).desc())
        .rangeBetween(W.unboundedPreceding, -1)
    )
    inside = F.last(value, ignorenulls=True).over(later)
    present = bucketed.where(F.col(value).isNotNull())
    firsts = present.groupBy(*keys, "_b").agg(F.min_by(value, at).alias("_first"))
    buckets = bucketed.select(*keys, "_b").distinct().join(firsts, [*keys, "_b"], "left")
    next_buckets = (
        W.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    )
    carried = buckets.select(
        *keys, "_b", F.last("_first", ignorenulls=True).over(next_buckets).alias("_carried")
    )
    return (
        bucketed.withColumn("_inside", inside)
        .join(carried, [*keys, "_b"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_b", "_inside", "_carried")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows per key.

    The rank filter sits directly on the window, so the plan cuts every
    partition to k rows per key before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def order_statistic(
    df: DataFrame, keys: list[str], value: str, fraction: float, name: str, accuracy: int = 2000
) -> DataFrame:
    """The exact element at 0-based index `floor(fraction * (n - 1))` of each sorted group.

    A mergeable sketch brackets the element; only the values inside the bracket
    are ranked, after equal values are counted together, and the rows below it
    are merely counted.
    """
    slack = 4.0 / accuracy
    bracket = [max(0.0, fraction - slack), min(1.0, fraction + slack)]
    small = F.col("_n") <= 2 * accuracy
    bounds = (
        df.groupBy(*keys)
        .agg(
            F.percentile_approx(value, bracket, accuracy).alias("_q"),
            F.count(value).alias("_n"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
        )
        .select(
            *keys,
            F.floor(F.lit(fraction) * (F.col("_n") - 1)).cast("long").alias("_index"),
            F.when(small, F.col("_min")).otherwise(F.col("_q")[0]).alias("_low"),
            F.when(small, F.col("_max")).otherwise(F.col("_q")[1]).alias("_high"),
        )
    )
    placed = df.where(F.col(value).isNotNull()).join(bounds, keys)
    kept = F.when(F.col(value).between(F.col("_low"), F.col("_high")), F.col(value))
    counted = (
        placed.where(F.col(value) <= F.col("_high"))
        .groupBy(*keys, "_index", kept.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    running = W.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_c").over(running))
    return (
        ranked.where(F.col("_v").isNotNull() & (F.col("_upto") > F.col("_index")))
        .groupBy(*keys)
        .agg(F.min("_v").alias(name))
    )
