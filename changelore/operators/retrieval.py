"""Hybrid retrieval for whole tables of questions.

`queries`: query_id, question, vector, one row per question.
`chunks`: chunk_id, tokens and embedding (either may be NULL), plus what hits show.
`scope` names columns shared by both sides (for instance repo_id) that restrict
which chunks a question may see; without it every chunk is a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelore import constants as C
from changelore.functions import text as X
from changelore.operators import lexical, skew, snapshot, vector_index
from changelore.operators.lexical_index import LexicalIndex
from changelore.operators.vector_index import VectorIndex
from changelore.operators.vectors import Nearest, product_error
from changelore.runtime import (
    BROADCAST_ROWS,
    broadcast_if_small,
    checkpointed_count,
    is_small,
    small,
)

SLICE_ROWS = 32_768
QUERY_BLOCK = 2_048
#: Rows of a tile of chunks and of questions that meet in one group, more chunks while their vectors are short
#: (at most so many rows and values); scores of one matrix product, and its chunks.
TILE_CHUNKS, TILE_QUERIES, WIDE_CHUNKS, TILE_VALUES = 65_536, 16_384, 262_144, 1 << 24
BLOCK_PAIRS, PRODUCT_ROWS = 1 << 22, 4_096
#: (chunk, question) scores that one task of the lexical search adds up, at most, and its least chunks.
TASK_SCORES, TASK_CHUNKS = 4_000_000, 256
#: Scores of a task while there are few parts, and how many these are: a task that deals its rows out to no
#: more of them writes a file for each (`spark.shuffle.sort.bypassMergeThreshold`) and holds none in memory.
FEW_SCORES, FEW_PARTS = 500_000, 200
BM25_K1 = 1.2
BM25_B = 0.75
_SCOPE = "_scope"


# --------------------------------------------------------------------------- dense


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = values.reshape(len(flat), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _scored_tile(k: int, slice_rows: int, query_block: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Best k chunks of one tile for every query of it, a block of queries and a slice of chunks at a time.

    Products are float32; only pairs whose product can reach a query's k-th best so far are scored with all
    digits, rounded and sorted.  Similarities without a number come last.
    """
    width = min(slice_rows, PRODUCT_ROWS)

    def best_of(asked: np.ndarray, corpus: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = Nearest(len(asked), k, lambda r, c: np.einsum("ij,ij->i", asked[r], corpus[c]))
        every, wanted = np.arange(len(asked)), asked.astype(np.float32)
        room = np.full(len(asked), product_error(asked.shape[1]))
        whole = np.isfinite(wanted).all() and np.isfinite(short).all()
        for start in range(0, len(corpus), width):
            raw = wanted @ short[start : start + width].T
            if not whole:
                raw[np.isnan(raw)] = -np.inf
            near.offer(every, start, raw, room)
        rows, places, values = near.best()
        return rows, places, np.where(np.isinf(values), np.nan, values)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            right = right.take(pa.compute.sort_indices(right.column("chunk_id")))
            corpus = _matrix(right.column("embedding"))
            short = corpus.astype(np.float32)
            step = max(1, min(query_block, BLOCK_PAIRS // min(width, len(corpus))))
            for start in range(0, left.num_rows, step):
                rows, places, values = best_of(_matrix(left.column("vector").slice(start, step)), corpus, short)
                found.append((start + rows, places, values))
        rows, places, values = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table(
            {
                names[0]: left.column("query_id").take(pa.array(rows)),
                names[1]: right.column("chunk_id").take(pa.array(places)),
                names[2]: pa.array(values, from_pandas=False),
            }
        )

    return run


def _with_scope(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    if scope:
        return df.withColumn(_SCOPE, F.xxhash64(*scope))
    return df.withColumn(_SCOPE, F.lit(0).cast("long"))


def _best_per_slice(
    asked: DataFrame, vectors: DataFrame, k: int, slice_rows: int, query_block: int
) -> DataFrame:
    """Candidate rows (query_id, chunk_id, similarity): k per query and tile of chunks.

    Both sides carry `_scope`.  A scope is cut into tiles of chunks and of
    queries whose number follows its size; every pair of tiles is one group, and
    `slice_rows` and `query_block` bound the matrix products inside it.  A vector
    travels once for each tile of the other side, so tiles are as large as a task
    holds; those of questions are smaller while that leaves cores without work.
    """
    groups = F.lit(3 * vectors.sparkSession.sparkContext.defaultParallelism)
    n = F.count(F.lit(1))
    # chunks of a tile: more while vectors are short, as each question keeps k rows for every tile
    short = F.floor(F.lit(TILE_VALUES) / F.greatest(F.max(F.size("embedding")), F.lit(1)))
    wide = F.least(F.greatest(short, F.lit(TILE_CHUNKS)), F.lit(max(WIDE_CHUNKS, TILE_CHUNKS)))
    sides = vectors.groupBy(_SCOPE).agg(F.ceil(n / F.greatest(wide, F.lit(slice_rows))).alias("_least"), F.ceil(n / slice_rows).alias("_most")).join(
        asked.groupBy(_SCOPE).agg(F.ceil(n / max(TILE_QUERIES, query_block)).alias("_few"), F.ceil(n / query_block).alias("_many")), _SCOPE
    )
    fill = F.ceil(groups / F.greatest("_few", F.least(F.col("_many"), groups)))
    sizes, scopes = checkpointed_count(
        sides.withColumn("_slices", F.greatest("_least", F.least(F.col("_most"), fill)).cast("int"))
        .withColumn("_blocks", F.greatest("_few", F.least(F.col("_many"), F.ceil(groups / F.col("_slices")))).cast("int"))
        .select(_SCOPE, "_slices", "_blocks"),
        F.lit(True),
    )
    sizes = small(sizes, scopes)
    left = asked.join(sizes, _SCOPE).select(
        _SCOPE,
        F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"),
        "query_id",
        "vector",
    )
    right = vectors.join(sizes, _SCOPE).select(
        _SCOPE,
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"),
        F.pmod(F.xxhash64("chunk_id"), F.col("_slices")).cast("int").alias("_slice"),
        "chunk_id",
        "embedding",
    )
    key = [_SCOPE, "_block", "_slice"]
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    return (
        left.groupBy(*key)
        .cogroup(right.groupBy(*key))
        .applyInArrow(_scored_tile(k, slice_rows, query_block, schema.fieldNames()), schema)
    )


def _scan_corpus(block: pa.Table, vectors: DataFrame, k: int, query_type: T.DataType) -> DataFrame:
    """k rows per query and partition from one bounded block of queries, no shuffle of the corpus."""
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    if block.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        wanted = _matrix(asked.column("vector"))
        scopes = asked.column(_SCOPE).to_numpy()
        best = np.full((len(wanted), k), -np.inf)
        ids = np.zeros((len(wanted), k), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            corpus = _matrix(pa.chunked_array([batch.column("embedding")]))
            chunk_ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            chunk_scopes = batch.column(_SCOPE).to_numpy(zero_copy_only=False)
            for scope in np.intersect1d(scopes, chunk_scopes):
                q, c = np.flatnonzero(scopes == scope), np.flatnonzero(chunk_scopes == scope)
                similarity = np.round(wanted[q] @ corpus[c].T, 6)
                merged = np.concatenate([best[q], similarity], axis=1)
                named = np.concatenate(
                    [ids[q], np.broadcast_to(chunk_ids[c], (len(q), len(c)))], axis=1
                )
                order = np.lexsort((named, -merged), axis=-1)[:, :k]
                best[q] = np.take_along_axis(merged, order, axis=1)
                ids[q] = np.take_along_axis(named, order, axis=1)
        rows, places = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays(
            [
                asked.column("query_id").combine_chunks().take(pa.array(rows)),
                pa.array(ids[rows, places]).cast(_arrow_int(schema)),
                pa.array(best[rows, places]),
            ],
            names=schema.fieldNames(),
        )

    return vectors.select(_SCOPE, "chunk_id", "embedding").mapInArrow(run, schema)


def _arrow_int(schema: T.StructType) -> pa.DataType:
    return pa.int32() if isinstance(schema["chunk_id"].dataType, T.IntegerType) else pa.int64()


def dense_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = C.K_DENSE,
    scope: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact top k by cosine similarity: query_id, chunk_id, similarity, rank.

    One block of queries goes to every task and the corpus is scanned where it
    lies.  More queries meet the corpus in slices and blocks; a scope that holds
    most of the chunks simply gets more slices.  Equal similarities (six
    decimals) are ordered by chunk id.
    """
    vectors = _with_scope(chunks.where(F.col("embedding").isNotNull()), scope)
    asked = _with_scope(queries.where(F.col("vector").isNotNull()), scope)
    one_block = None
    if isinstance(vectors.schema["chunk_id"].dataType, (T.LongType, T.IntegerType)):
        one_block = asked.select("query_id", _SCOPE, "vector").limit(query_block + 1).toArrow()
    if one_block is not None and one_block.num_rows <= query_block:
        partial = _scan_corpus(one_block, vectors, k, asked.schema["query_id"].dataType)
    else:
        partial = _best_per_slice(asked, vectors, k, slice_rows, query_block)
    order = [F.col("similarity").desc(), F.col("chunk_id")]
    return skew.top_per_key(partial, ["query_id"], order, k, "rank")


def recall_against(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate list found, per query."""
    key = ["query_id", "chunk_id"]
    found = approximate.select(*key, F.lit(1).alias("_hit"))
    return (
        exact.join(found, key, "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
    )


# --------------------------------------------------------------------------- sparse


def postings(chunks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, chunk_id, chunk_length, token), one row per token position.

    The outer explode keeps the optimizer from adding a size filter that would
    tokenise every text a second time; NULL tokens fall out below.
    """
    return chunks.select(
        *scope,
        "chunk_id",
        F.size("tokens").alias("chunk_length"),
        F.explode_outer("tokens").alias("token"),
    ).where(F.col("token").isNotNull())


def query_terms(queries: DataFrame, scope: Sequence[str] = (), stemmed: bool = False) -> DataFrame:
    return queries.select(
        *scope, "query_id", F.explode(lexical.query_tokens("question", stemmed)).alias("token")
    )


def sparse_topk(
    queries: DataFrame,
    chunks: DataFrame | LexicalIndex,
    k: int = C.K_SPARSE,
    mode: str = "tf",
    scope: Sequence[str] = (),
    stemmed: bool = False,
) -> DataFrame:
    """Top k chunks with any question word: query_id, chunk_id, score, rank.

    `tf` counts matching positions; `bm25` weights them by rarity and length.
    `stemmed` says that the chunks' tokens are, and stems the question words.
    A stored index gives the postings of the asked words from their buckets.
    Without one, the small term table is broadcast when counted small, so
    positions are filtered where they are read; what is left is placed by chunk
    once, and both counting steps and the per-query cut reuse that placement:
    only k rows per query and partition are shuffled after it.
    """
    terms = query_terms(queries, scope, stemmed)
    key = [*scope, "token"]
    few = is_small(terms)
    asked = terms.select(*key).distinct()
    if few:
        terms = F.broadcast(terms)
    indexed = isinstance(chunks, LexicalIndex)
    parts = _placements(queries, chunks.lengths.read() if indexed else chunks)
    if indexed:
        counted, sized = chunks.counted(asked), chunks.lengths.read()
        placed = counted.repartition(parts, "chunk_id")
    else:
        counted = placed = (
            postings(chunks, scope)
            .join(F.broadcast(asked) if few else asked, key)
            .repartition(parts, "chunk_id")
            .groupBy("chunk_id", "chunk_length", *key)
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        sized = chunks.where(F.col("tokens").isNotNull()).withColumn("chunk_length", F.size("tokens"))
    if mode == "tf":
        matched, score = placed, F.sum("tf")
    elif mode == "bm25":
        matched, score = _with_bm25(placed, counted, sized, scope, key, few), F.round(F.sum("_weight"), 6)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    scored = matched.join(terms, key).groupBy("chunk_id", "query_id").agg(score.alias("score"))
    order = [F.col("score").desc(), F.col("chunk_id")]
    return skew.top_per_key(
        scored.select("query_id", "chunk_id", "score"), ["query_id"], order, k, "rank"
    )


def _placements(queries: DataFrame, chunks: DataFrame) -> int:
    """Parts in which chunks meet questions: a part's scores are bounded, however many chunks there are.

    Postings are short rows that grow by the questions with their token, which AQE does not see when it
    merges parts; so their number is fixed in front.  More parts than `FEW_PARTS` come only with scores that
    these cannot hold: then positions are held where they are dealt out.
    """
    n, asked = chunks.select("chunk_id").count(), queries.count()
    least = 3 * chunks.sparkSession.sparkContext.defaultParallelism
    light = min(FEW_PARTS, math.ceil(n * asked / FEW_SCORES))
    return max(1, min(math.ceil(n / TASK_CHUNKS), max(least, light, math.ceil(n * asked / TASK_SCORES))))


def _with_bm25(
    placed: DataFrame, counted: DataFrame, sized: DataFrame, scope: Sequence[str], key: list[str], few: bool
) -> DataFrame:
    """BM25 weight per (chunk, token); the weight table has one row per asked token at most."""
    totals = _with_scope(sized, scope).groupBy(_SCOPE).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("chunk_length").alias("_avg")
    )
    df = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = (
        _with_scope(df, scope)
        .join(totals, _SCOPE)
        .select(*key, "_avg", idf.alias("_idf"))
    )
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("chunk_length") / F.col("_avg"))
    return placed.join(F.broadcast(weights) if few else weights, key).withColumn(
        "_weight", F.col("_idf") * F.col("tf") * (BM25_K1 + 1) / norm
    )


# --------------------------------------------------------------------------- fusion


def rrf_fuse(lists: dict[str, DataFrame], k: int = C.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists, with the rank in each list as `<name>_rank`."""
    parts = []
    for name, ranked in lists.items():
        parts.append(
            ranked.select(
                "query_id",
                "chunk_id",
                F.col("rank").cast("int").alias("_rank"),
                F.lit(name).alias("_list"),
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    ranks = [
        F.max(F.when(F.col("_list") == name, F.col("_rank"))).alias(f"{name}_rank")
        for name in lists
    ]
    fused = F.round(F.sum(1.0 / (F.lit(k) + F.col("_rank"))), 9)
    return union.groupBy("query_id", "chunk_id").agg(fused.alias("score"), *ranks)


def fused_candidates(fused: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
    """The `max(50, top_n)` best fused chunks per query, dense hits first among equals."""
    order = [
        F.col("score").desc(),
        F.col("dense_rank").asc_nulls_last(),
        F.col("chunk_id"),
    ]
    return skew.top_per_key(fused, ["query_id"], order, max(C.MIN_FUSED, top_n), "fused_rank")


class PairScorer(Protocol):
    """Built once per task; scores (question, text) pairs."""

    def __call__(self, questions: list[str], texts: list[str]) -> np.ndarray: ...


class OverlapScorer:
    """Default scorer: share of the distinct question words that the text contains."""

    def __call__(self, questions: list[str], texts: list[str]) -> np.ndarray:
        out = np.zeros(len(questions))
        for i, (question, text) in enumerate(zip(questions, texts, strict=True)):
            words = set(question.lower().split())
            if words:
                out[i] = len(words & set(text.lower().split())) / len(words)
        return out


def rerank(
    pairs: DataFrame,
    scorer: Callable[[], PairScorer] = OverlapScorer,
    question: str = "question",
    text: str = "body",
) -> DataFrame:
    """Add `rerank_score` to (query, chunk) rows; pairs without a text stay NULL."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        for b in batches:
            texts = b.column(text).to_pylist()
            usable = [i for i, t in enumerate(texts) if t is not None]
            scores: list[float | None] = [None] * len(texts)
            if usable:
                asked = b.column(question).to_pylist()
                values = model([asked[i] or "" for i in usable], [texts[i] for i in usable])
                for i, v in zip(usable, values, strict=True):
                    scores[i] = float(v)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64())], names=schema.fieldNames()
            )

    return pairs.mapInArrow(run, schema)


def final_order(candidates: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
    """Rerank score first when there is one, then the fused order; unscored chunks last."""
    order = [F.col("fused_rank")]
    if "rerank_score" in candidates.columns:
        order = [F.col("rerank_score").desc_nulls_last(), *order]
    return skew.top_per_key(candidates, ["query_id"], order, top_n, "rank")


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    k_dense: int = C.K_DENSE,
    k_sparse: int = C.K_SPARSE,
    top_n: int = C.TOP_N,
    scope: Sequence[str] = (),
    sparse_mode: str = "tf",
    scorer: Callable[[], PairScorer] | None = None,
    lexical_index: LexicalIndex | None = None,
    vectors: VectorIndex | None = None,
) -> DataFrame:
    """Dense and lexical candidates, fused, optionally reranked, cut to top_n per query.

    Either list comes from a stored index when one is given; `chunks` then only
    shows the hits.  A vector index knows no scope.  Bodies are joined only to
    the few fused candidates, never carried through the ranking shuffles.
    """
    if vectors is not None and scope:
        raise ValueError("a stored vector index has no scope")
    dense = dense_topk(queries, chunks, k_dense, scope) if vectors is None else vector_index.topk(queries, vectors, k_dense)
    found = sparse_topk(queries, chunks if lexical_index is None else lexical_index, k_sparse, sparse_mode, scope)
    fused = rrf_fuse({"dense": dense, "sparse": found})
    candidates = fused_candidates(fused, top_n)
    shown = [c for c in chunks.columns if c not in ("tokens", "embedding", *scope)]
    # At most `per_query` rows per question are left: few questions, few rows.
    per_query = max(C.MIN_FUSED, top_n)
    few = is_small(queries.select("query_id", "question"), BROADCAST_ROWS // per_query)

    def hydrate(rows: DataFrame) -> DataFrame:
        return chunks.select(*shown).join(F.broadcast(rows) if few else rows, "chunk_id")

    if scorer is None:
        return hydrate(final_order(candidates, top_n))
    asked = queries.select("query_id", "question")
    pairs = hydrate(candidates).join(F.broadcast(asked) if few else asked, "query_id")
    return final_order(rerank(pairs, scorer).drop("question"), top_n)


def search_outcome(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: number of hits and the reason to abstain, if any."""
    counted = (
        snapshot.with_stale(hits)
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.count_if("stale").alias("stale_hits"))
    )
    n = F.coalesce("hits", F.lit(0))
    stale = F.coalesce("stale_hits", F.lit(0))
    return queries.select("query_id").join(counted, "query_id", "left").select(
        "query_id",
        n.alias("hits"),
        stale.alias("stale_hits"),
        F.when(n == 0, C.NO_HITS).when(n == stale, C.ALL_STALE).alias("abstained_reason"),
    )


def every_repo(queries: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per question and repository: the searches of a question to all repositories.

    Meets on a constant key because every combination is a search that was asked
    for; the repository dimension is small and checked to be.
    """
    dimension = broadcast_if_small(repos.select("repo_id").distinct().withColumn("_all", F.lit(0)))
    return queries.withColumn("_all", F.lit(0)).join(dimension, "_all").drop("_all")


def multi_repo_search(per_repo: DataFrame, n: int = C.MAX_QUESTION_HITS) -> DataFrame:
    """Merge per-repository result lists: query_id, repo_id, chunk_id, rank.

    A chunk found through several repositories counts once (its best rank, then
    the lowest repository); the lists are interleaved by rank, so every
    repository contributes.  A `rerank_score` column decides first.
    """
    order = [F.col("rank"), F.col("repo_id"), F.col("chunk_id")]
    others = [c for c in per_repo.columns if c not in ("query_id", "chunk_id")]
    once = (
        per_repo.groupBy("query_id", "chunk_id")
        .agg(F.min_by(F.struct(*others), F.struct("rank", "repo_id")).alias("r"))
        .select("query_id", "chunk_id", "r.*")
    )
    if "rerank_score" in per_repo.columns:
        order = [F.col("rerank_score").desc_nulls_last(), *order]
    return skew.top_per_key(once, ["query_id"], order, n, "merged_rank")


def rerank_merged(
    merged: DataFrame,
    queries: DataFrame,
    bodies: DataFrame,
    scorer: Callable[[], PairScorer] = OverlapScorer,
    n: int = C.MAX_QUESTION_HITS,
) -> DataFrame:
    """The merged candidates of all repositories, reranked as one list: adds rerank_score and rank.

    `bodies`: chunk_id, body; they meet only the few merged rows.  Chunks without a body come last, equal
    scores keep the merged order.
    """
    few = broadcast_if_small(merged.join(queries.select("query_id", "question"), "query_id"))
    pairs = few.join(bodies.select("chunk_id", "body").join(few.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", "left")
    scored = rerank(pairs, scorer).drop("question", "body")
    order = [F.col("rerank_score").desc_nulls_last(), F.col("merged_rank")]
    return skew.top_per_key(scored.drop("rank"), ["query_id"], order, n, "rank")


# --------------------------------------------------------------------------- views


def display_id(source_type: Column | str, source_id: Column | str) -> Column:
    """Nine characters of a commit hash; merge-request and document ids stay whole."""
    is_commit = X.col(source_type) == C.SOURCE_COMMIT
    return F.when(is_commit, X.cut(source_id, C.SHA_SHOWN)).otherwise(X.col(source_id))


def source_url(repo: Column | str, shown_id: Column | str) -> Column:
    """Link by the shape of an id: merge request, file or commit."""
    shown_id = X.col(shown_id)
    base = F.concat(F.lit("https://github.com/"), F.coalesce(X.col(repo), F.lit("")))
    plain = F.substring_index(shown_id, "#", 1)
    return (
        F.when(
            shown_id.startswith("pr:"),
            F.concat(base, F.lit("/pull/"), F.substr(plain, F.lit(4))),
        )
        .when(shown_id.contains("/"), F.concat(base, F.lit("/blob/HEAD/"), plain))
        .otherwise(F.concat(base, F.lit("/commit/"), shown_id))
    )


def hit_view(hits: DataFrame, repos: DataFrame) -> DataFrame:
    """What a hit shows: short id, cut title, date, ranks, staleness, link."""
    named = hits.join(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id", "left")
    shown = display_id("source_type", "source_id")
    return snapshot.with_stale(named).select(
        "query_id",
        "rank",
        "chunk_id",
        shown.alias("display_id"),
        X.cut(F.coalesce("title", F.lit("")), C.TITLE_SHOWN).alias("title"),
        X.iso_date("authored_at").alias("authored_on"),
        "score",
        "dense_rank",
        "sparse_rank",
        "liveness_score",
        "stale",
        "repo",
        X.repo_short("repo").alias("repo_short"),
        source_url("repo", shown).alias("url"),
    )
