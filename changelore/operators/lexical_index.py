"""A stored inverted index: postings bucketed by token, added batch by batch, searched without the texts.

A posting is one row of (token, chunk): how often, and how long the chunk is.  Positions are counted inside
the row of a chunk, so adding a batch shuffles postings, never positions.  A search reads the buckets of the
asked tokens: few tokens are literals that choose buckets and row groups, many are shuffled to the buckets,
and the stored side of the join stays where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore.runtime import checkpointed, checkpointed_count, is_small, small
from changelore.sources.bucketed import BucketedTable

BUCKETS = 64
#: Distinct asked tokens up to which they are literals of the scan.
LITERAL_TOKENS = 1_000


@dataclass(frozen=True)
class LexicalIndex:
    """Postings (token, scope, chunk_id, tf, chunk_length) and lengths (chunk_id, scope, chunk_length)."""

    postings: BucketedTable
    lengths: BucketedTable
    scope: tuple[str, ...]

    def counted(self, asked: DataFrame) -> DataFrame:
        """The postings of asked tokens; `asked` has the scope and `token`, each pair once."""
        rows = self.postings.read().drop("batch")
        few = is_small(asked, LITERAL_TOKENS)
        if few:
            tokens = [r["token"] for r in asked.select("token").distinct().collect()]
            rows = rows.where(F.col("token").isin(tokens))
        key = [*self.scope, "token"]
        return rows.join(F.broadcast(asked) if few or is_small(asked) else asked, key)


def open_index(spark: SparkSession, path: str, scope: Sequence[str] = (), buckets: int = BUCKETS) -> LexicalIndex:
    """The index below `path`, new or stored.  `scope` are DDL columns, such as `repo_id INT`; chunk ids are long."""
    shared = "".join(f", {c}" for c in scope)
    names = tuple(c.split()[0] for c in scope)
    return LexicalIndex(
        BucketedTable(spark, f"{path}/postings", f"token STRING{shared}, chunk_id BIGINT, tf INT, chunk_length INT", "token", buckets),
        BucketedTable(spark, f"{path}/lengths", f"chunk_id BIGINT{shared}, chunk_length INT", "chunk_id", buckets),
        names,
    )


def counted_tokens(chunks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, chunk_id, chunk_length, token, tf): runs of a chunk's sorted tokens, counted inside its row.

    Both steps come out of a generator, so that they are computed once.
    """
    keep = [*scope, "chunk_id", "chunk_length"]
    ordered = F.array_sort(F.filter("tokens", lambda t: t.isNotNull()))
    begins = F.filter(
        F.sequence(F.lit(0), F.size("s.t") - 1),
        lambda i: (i == 0) | (F.get("s.t", i) != F.get("s.t", F.greatest(i - 1, F.lit(0)))),
    )
    runs = F.transform(
        "b.at",
        lambda i, k: F.struct(
            F.get("t", i).alias("token"),
            (F.coalesce(F.get("b.at", k + 1), F.size("t")) - i).cast("int").alias("tf"),
        ),
    )
    return (
        chunks.where(F.size("tokens") > 0)
        .select(*scope, "chunk_id", F.size("tokens").alias("chunk_length"), F.explode(F.array(F.struct(ordered.alias("t")))).alias("s"))
        .where(F.size("s.t") > 0)
        .select(*keep, F.col("s.t").alias("t"), F.explode(F.array(F.struct(begins.alias("at")))).alias("b"))
        .select(*keep, F.explode(runs).alias("r"))
        .select(*keep, "r.token", "r.tf")
    )


def add(index: LexicalIndex, chunks: DataFrame, batch: int) -> None:
    """Index the chunks that no other batch holds; a repeated batch replaces itself.

    Chunks without tokens (NULL) are no part of the index; a chunk id that comes twice counts once, its
    longer token list.  Lengths are written last: they tell which chunks are known.
    """
    known = index.lengths.others(batch).select("chunk_id")
    given = chunks.where(F.col("tokens").isNotNull()).select("chunk_id", *index.scope, "tokens")
    fresh = checkpointed(given.join(known, "chunk_id", "left_anti"))
    # Ids alone tell which come twice; only their token lists are compared, the others are not sorted.
    twice, ids = checkpointed_count(
        fresh.groupBy(F.col("chunk_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"), F.lit(True)
    )
    if ids:
        same = F.col("chunk_id").eqNullSafe(F.col("_id"))
        best = F.max_by(F.struct(*index.scope, "tokens"), F.struct(F.size("tokens"), "tokens")).alias("c")
        longest = fresh.join(small(twice, ids), same, "left_semi").groupBy("chunk_id").agg(best)
        longest = longest.select("chunk_id", *[f"c.{x}" for x in index.scope], "c.tokens")
        fresh = fresh.join(small(twice, ids), same, "left_anti").unionByName(longest)
    index.postings.write(counted_tokens(fresh, index.scope), batch)
    index.lengths.write(fresh.select("chunk_id", *index.scope, F.size("tokens").alias("chunk_length")), batch)


def compact(index: LexicalIndex, into: LexicalIndex, batch: int = 0) -> None:
    """All batches as one batch of another index: one file per bucket again."""
    into.postings.write(index.postings.read(), batch)
    into.lengths.write(index.lengths.read(), batch)
