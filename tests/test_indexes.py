"""Stored indexes: appended in batches, opened again, equal to the search over the chunks themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelore.operators import lexical, lexical_index, retrieval, vector_index
from tests.test_retrieval import as_queries, vector_table


def texts(spark, seed: int, n: int):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of"]
    rows = [(k, k % 3, None if k % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(n)]
    chunks = spark.createDataFrame(rows, "chunk_id BIGINT, repo_id INT, body STRING")
    return chunks.withColumn("tokens", lexical.tokens("body"))


def asked(spark):
    rows = [(1, 0, "w1 w2 the"), (2, 1, "w3 w59 w3"), (3, 2, "w7"), (4, 0, "nothing known"), (5, 1, "")]
    return spark.createDataFrame(rows, "query_id INT, repo_id INT, question STRING")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("mode", ["tf", "bm25"])
@pytest.mark.parametrize("scope", [(), ("repo_id",)])
def test_a_stored_index_grows_by_batches(spark, tmp_path, mode, scope):
    chunks, ddl = texts(spark, 3, 120), ["repo_id INT"] if scope else []
    queries = asked(spark)
    first = chunks.where("chunk_id < 50")
    index = lexical_index.open_index(spark, f"{tmp_path}/i", ddl, buckets=4)
    lexical_index.add(index, first, batch=0)
    assert rows_of(retrieval.sparse_topk(queries, index, 20, mode, scope)) == rows_of(retrieval.sparse_topk(queries, first, 20, mode, scope))
    # chunks that are known already and a batch that is repeated change nothing
    lexical_index.add(index, chunks.where("chunk_id >= 30"), batch=1)
    lexical_index.add(index, chunks.where("chunk_id >= 30"), batch=1)
    again = lexical_index.open_index(spark, f"{tmp_path}/i", ddl, buckets=4)
    want = rows_of(retrieval.sparse_topk(queries, chunks, 20, mode, scope))
    assert rows_of(retrieval.sparse_topk(queries, again, 20, mode, scope)) == want
    one = lexical_index.open_index(spark, f"{tmp_path}/compacted", ddl, buckets=4)
    lexical_index.compact(again, one)
    assert rows_of(retrieval.sparse_topk(queries, one, 20, mode, scope)) == want


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_reads_buckets_and_leaves_the_postings_where_they_lie(spark, tmp_path, monkeypatch):
    index = lexical_index.open_index(spark, f"{tmp_path}/i", buckets=4)
    lexical_index.add(index, texts(spark, 5, 80), batch=0)
    few = retrieval.query_terms(asked(spark).where("query_id = 3")).select("token")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # shows the chosen buckets
    try:
        plan = plan_of(index.counted(few))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in plan and "EqualTo(token,w7)" in plan

    # many tokens: an exchange of the question side alone
    monkeypatch.setattr(lexical_index, "is_small", lambda *a: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tokens = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"))
        joined = index.counted(tokens)
        plan = plan_of(joined)
        assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("SortMergeJoin")
        assert "SelectedBucketsCount: 4 out of 4" in plan
        side = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(side) == 1 and "tokens" not in side[0] and "body" not in side[0]
        assert joined.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_positions_are_counted_inside_the_row(spark):
    rows = [(1, ["b", "a", "b", None, "b"]), (2, []), (3, None), (4, ["x"] * 3000 + ["y"]), (5, [None])]
    got = lexical_index.counted_tokens(spark.createDataFrame(rows, "chunk_id BIGINT, tokens ARRAY<STRING>"))
    assert "Exchange" not in plan_of(got)
    assert rows_of(got) == [(1, 5, "a", 1), (1, 5, "b", 3), (4, 3001, "x", 3000), (4, 3001, "y", 1)]


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_recall_has_a_floor_at_any_number_of_bits(spark, tmp_path, bits):
    """Neighbours in clusters, and vectors without any structure: the worst case for patterns."""
    rng = np.random.default_rng(44)
    made = np.concatenate([np.repeat(rng.normal(size=(20, 24)), 20, axis=0) + 0.3 * rng.normal(size=(400, 24)), rng.normal(size=(400, 24))])
    chunks = vector_table(spark, made.astype(np.float32))
    index = vector_index.open_index(spark, f"{tmp_path}/v", bits=bits, buckets=4)
    vector_index.add(index, chunks.where("chunk_id < 300"), batch=0)
    vector_index.add(index, chunks.where("chunk_id >= 200"), batch=1)
    tuned = vector_index.calibrate(index, k=6)
    assert vector_index.open_index(spark, f"{tmp_path}/v", bits=bits, buckets=4).probes == tuned.probes
    queries = as_queries(chunks, 800)
    exact = retrieval.dense_topk(queries, chunks, k=6)
    found = vector_index.topk(queries, tuned, k=6)
    assert retrieval.recall_against(exact, found).agg(F.avg("recall")).first()[0] >= 0.9
    assert bits == 4 or tuned.probes < tuned.patterns  # fewer than everything


def test_no_bits_is_an_exact_search_over_codes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    made = np.concatenate([rng.normal(size=(150, 40)), np.zeros((2, 40)), np.repeat(rng.normal(size=(1, 40)), 60, axis=0)]).astype(np.float32)
    chunks = vector_table(spark, made)
    monkeypatch.setattr(vector_index, "CELL_ROWS", 30)
    index = vector_index.open_index(spark, f"{tmp_path}/v", bits=0, buckets=4)
    vector_index.add(index, chunks.withColumn("embedding", F.when(F.col("chunk_id") != 3, F.col("embedding"))), batch=0)
    assert index.directory.read().count() == 8  # one pattern, eight cells
    got = vector_index.topk(as_queries(chunks, 200), index, k=9).select("query_id", "chunk_id", "rank")
    want = retrieval.dense_topk(as_queries(chunks, 200), chunks.where("chunk_id <> 3"), k=9).select("query_id", "chunk_id", "rank")
    assert rows_of(got) == rows_of(want)


def test_bounds_hold_the_cosine():
    rng = np.random.default_rng(8)
    a, b = (vector_index._unit(rng.normal(size=(60, 33)) ** 3) for _ in range(2))
    low, high = vector_index.bounds(vector_index.coded(a), vector_index.coded(b))
    assert (low <= a @ b.T).all() and (a @ b.T <= high).all() and (high - low).max() < 0.15


def test_probes_come_in_the_order_of_their_cost():
    rng = np.random.default_rng(9)
    unit = vector_index._unit(rng.normal(size=(5, 16)))
    own = vector_index.patterns_of(unit, 5, 3, 7)
    order = vector_index.probe_order(unit, 5, 3, 7, 96)
    assert all(set(own[q]) <= set(order[q][:96]) and len(set(order[q])) == 96 for q in range(5))
    assert all(order[q][0] in own[q] for q in range(5))
    assert (vector_index.probe_order(unit, 5, 3, 7, 10) == order[:, :10]).all()


def test_hybrid_search_over_stored_indexes(spark, tmp_path):
    made = np.random.default_rng(10).normal(size=(90, 12)).astype(np.float32)
    chunks = texts(spark, 7, 90).join(vector_table(spark, made).drop("repo_id"), "chunk_id")
    words = lexical_index.open_index(spark, f"{tmp_path}/l", buckets=2)
    lexical_index.add(words, chunks, batch=0)
    near = vector_index.open_index(spark, f"{tmp_path}/v", bits=0, buckets=2)
    vector_index.add(near, chunks, batch=0)
    queries = asked(spark).join(as_queries(chunks, 6).select("query_id", "vector"), "query_id")
    shown = chunks.select("chunk_id", "body")
    got = retrieval.hybrid_search(queries, shown, lexical_index=words, vectors=near)
    assert rows_of(got.select("query_id", "rank", "chunk_id", "score")) == rows_of(
        retrieval.hybrid_search(queries, chunks).select("query_id", "rank", "chunk_id", "score")
    )
    with pytest.raises(ValueError):
        retrieval.hybrid_search(queries, shown, vectors=near, scope=["repo_id"])


def test_questions_of_a_cell_are_dealt_into_blocks(spark, tmp_path, monkeypatch):
    chunks = vector_table(spark, np.random.default_rng(8).uniform(-1, 1, (90, 6)).astype(np.float32))
    index = vector_index.open_index(spark, f"{tmp_path}/v", bits=0, buckets=4)
    vector_index.add(index, chunks, batch=0)
    queries = as_queries(chunks, 60)
    want = rows_of(vector_index.topk(queries, index, 5))
    monkeypatch.setattr(vector_index, "CELL_QUESTIONS", 16)
    seen = []
    meeting = vector_index._one_pass
    monkeypatch.setattr(vector_index, "_one_pass", lambda *a: seen.append(a[3]) or meeting(*a))
    assert rows_of(vector_index.topk(queries, index, 5)) == want
    assert seen == [4]


def test_chunk_ids_that_come_twice_or_are_null_count_once(spark, tmp_path):
    rows = [(1, ["a"]), (1, ["a", "b"]), (2, ["a"]), (None, ["c", "c"]), (None, ["c"]), (3, None)]
    index = lexical_index.open_index(spark, f"{tmp_path}/i", buckets=4)
    lexical_index.add(index, spark.createDataFrame(rows, "chunk_id BIGINT, tokens ARRAY<STRING>"), batch=0)
    got = index.lengths.read().select("chunk_id", "chunk_length").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2), (2, 1), (None, 2)]
    assert index.postings.read().count() == 4


@pytest.mark.parametrize(("bits", "probes"), [(3, 9), (9, 40)])
def test_a_question_finds_the_best_of_all_cells_it_probes(spark, tmp_path, monkeypatch, bits, probes):
    """One row a question travels, and a chunk that several tables hold counts once against the others."""
    monkeypatch.setattr(vector_index, "PIECE", 7)
    monkeypatch.setattr(vector_index, "TILE_ROWS", 50)
    made = np.random.default_rng(12).normal(size=(120, 10)).astype(np.float32)
    chunks = vector_table(spark, made)
    index = vector_index.open_index(spark, f"{tmp_path}/v", bits=bits, probes=probes, buckets=4)
    vector_index.add(index, chunks, batch=0)
    queries = as_queries(chunks, 120)
    assert vector_index._probed(index, queries).count() == 120
    unit = vector_index._unit(made.astype(np.float64))
    held = vector_index.patterns_of(unit, bits, index.tables, index.seed)
    order = vector_index.probe_order(unit, bits, index.tables, index.seed, probes)
    near = np.round(unit @ unit.T, 6)
    want = set()
    for q in range(120):
        met = [c for c in range(120) if set(held[c].tolist()) & set(order[q].tolist())]
        want |= {(q, c, r) for r, c in enumerate(sorted(met, key=lambda c: (-near[q, c], c))[:6], 1)}
    got = vector_index.topk(queries, index, 6).select("query_id", "chunk_id", "rank")
    assert {tuple(r) for r in got.collect()} == want
