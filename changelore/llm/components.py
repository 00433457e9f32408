"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore.runtime import checkpointed, checkpointed_count

#: Rows of a partition that rounds over a known number of rows fill.
FILL_ROWS = 8_192


def filled(df: DataFrame, rows: int) -> DataFrame:
    """`df` in no more partitions than a known number of rows fills; no exchange."""
    return df.coalesce(rows // FILL_ROWS + 2)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b), both long: the smallest id reachable.

    Each round hangs the larger neighbours of an id on its smallest one, then the smaller neighbours of an
    id on the smallest of them.  Stars grow over all ids of a component in about log2 of its size rounds;
    every round is written to the shared checkpoint folder.  Rounds work on minima by aggregation, so an id
    with very many links is no group to gather.  Rounds write as many partitions as their edges fill, so
    many rounds over few edges leave few files.
    """
    edges, n = checkpointed_count(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        F.lit(True),
    )
    while n:
        fit = lambda df, n=n: filled(df, 2 * n)
        # large star: every larger neighbour of u is linked to the smallest neighbour of u (or u)
        both = fit(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = fit(large.unionByName(least.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v")))).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        large = checkpointed(fit(large))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        small = fit(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct()
        # done when every id hangs on one root and no root hangs anywhere
        edges, n = checkpointed_count(fit(small), F.lit(True))
        twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("u")
        hung = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if twice.unionByName(hung).isEmpty():
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
