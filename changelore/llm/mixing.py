"""Mix sources to target weights: weighted sampling without replacement inside a source, whole epochs first.

Targets come from a table with one row per source.  A source whose target is k times its size and a rest
takes every document k times, then documents in the order of an exponential key divided by their quality
weight (Efraimidis-Spirakis) until their sizes, summed in that order, fill the rest.

No source is ever sorted in one task: keys are cut into bins by value, bins are summed, and only the bin
in which the budget ends is ordered row by row.  The number of bins of a source follows its counted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelore.llm.common import word_count

MAX_EPOCHS = 3
#: Sources in order take these weights in turn.
WEIGHTS = (1, 2, 3)
ROWS_PER_BIN = 2_000


def source_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): shares of all words by weight, at most `max_epochs` times the size.

    The excess of sources at their limit goes to the others by weight until none is above.  With sources
    ordered by limit over weight, the first one at which the common level does not exceed that ratio fixes
    the level of all others.  One row per source is handled, never a row per document.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS)) + 1)
    weighted = sources.withColumn("weight", weight.cast("double")).withColumn(
        "limit", F.lit(float(max_epochs)) * F.col("source_size")
    )
    ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    used = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) - used) / rest
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    return (
        weighted.withColumn("level", level)
        .withColumn("fit", F.first(fits, ignorenulls=True).over(ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("target", F.least(F.coalesce(F.col("fit") * F.col("weight"), F.col("limit")), F.col("limit")))
        .select("source", "source_size", "weight", "target")
    )


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of letters, digits and white space in a text, 0.1 for NULL and empty ones."""
    signs = F.char_length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", ""))
    share = 1 - signs / F.greatest(F.char_length(text), F.lit(1))
    return F.greatest(F.coalesce(F.when(F.char_length(text) > 0, share), F.lit(0.0)), F.lit(0.1))


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(16**13))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add size, source_size, target, epochs, part and taken; every input row stays.

    size counts words.  epochs is the number of whole takes of the document's source, part the words that
    the last, fractional take uses: the whole size, 0, or less for the one document at which the budget
    ends.  taken = epochs * size + part.  Rows of equal key (copies of a row) are ordered by their size and
    share their draw; NULL texts and empty ones have size 0 and take nothing.  An empty table stays empty.
    """
    sized = (
        docs.withColumn("size", word_count(F.col(text)))
        .withColumn("_weight", quality_weight(F.col(text)))
        .withColumn("_key", -F.log(uniform(F.col(key))) / F.col("_weight"))
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    plan = (
        source_targets(sources.drop("_rows"), max_epochs)
        .join(sources.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-9).cast("long"))
        .withColumn("_budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("_bins", F.ceil(F.col("_rows") / ROWS_PER_BIN))
        .select("_s", "source_size", "target", "epochs", "_budget", "_bins")
    )
    # 1 - exp(-key) spreads the keys over (0, 1) in their order
    bin_ = F.floor((1 - F.exp(-F.col("_key"))) * F.col("_bins")).cast("long")
    slim = sized.select(F.col("source").alias("_s"), F.col(key).alias("_k"), "size", "_key")
    placed = slim.join(plan, slim["_s"].eqNullSafe(plan["_s"])).drop(plan["_s"]).withColumn("_bin", bin_)
    sums = placed.groupBy("_s", "_bin", "_budget").agg(F.sum("size").alias("_in_bin"))
    upto = F.sum("_in_bin").over(W.partitionBy("_s").orderBy("_bin"))
    ends = sums.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_in_bin"))
    last = ends.where((F.col("_before") < F.col("_budget")) & (F.col("_upto") >= F.col("_budget")))
    last = last.select("_s", F.col("_bin").alias("_last"), F.col("_before").alias("_done"))
    cut = plan.join(last.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2")

    # in the last bin of a source: documents in key order until the budget is full
    inside = placed.join(
        last.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_bin") == F.col("_last"))
    ).drop("_s2")
    order = W.partitionBy("_s").orderBy("_key", F.col("_k").asc_nulls_last(), "size")
    summed = inside.withColumn("_sum", F.col("_done") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    border = (
        summed.where((F.col("_sum") >= F.col("_budget")) & (F.col("_sum") - F.col("size") < F.col("_budget")))
        .groupBy("_s")
        .agg(F.min(F.struct("_key", F.col("_k").alias("k"), (F.col("_budget") - F.col("_sum") + F.col("size")).alias("part"))).alias("_edge"))
    )
    cut = cut.join(border.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2")

    edge = F.col("_edge")
    at_edge = (F.col("_key") == edge["_key"]) & F.col(key).eqNullSafe(edge["k"])
    part = (
        F.when(F.col("_budget") <= 0, 0)
        .when(F.col("_last").isNull() | edge.isNull(), F.col("size"))
        .when(at_edge, F.least(F.col("size"), edge["part"]))
        .when(F.col("_key") < edge["_key"], F.col("size"))
        .when((F.col("_key") == edge["_key"]) & (F.col(key) < edge["k"]), F.col("size"))
        .otherwise(0)
    )
    return (
        sized.join(cut, sized["source"].eqNullSafe(cut["_s"]))
        .withColumn("part", part.cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .drop("_s", "_weight", "_key", "_budget", "_bins", "_last", "_done", "_edge")
    )
