"""Words, tables and keys shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space; the same in every operator.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; NULL and blank texts give an empty one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, without building them: breaks between a blank and a word."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """The same rows and columns; the named columns come out of a generator.

    Catalyst pushes a filter on a projected column below the projections that compute it and writes their
    expressions into it again, inside lambdas once for each element.  It does not cross a generator.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    done = F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in names]))).alias("_settled")
    order = [F.col(f"_settled.`{c}`" if c in names else f"`{c}`") for c in df.columns]
    return df.select(*others, done).select(*order)
