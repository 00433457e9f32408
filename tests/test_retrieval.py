"""Dense, lexical and fused retrieval against plain computations on generated corpora."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.operators import citations, evalkit, export, lexical, retrieval, router, vectors


def vector_table(spark, made: np.ndarray):
    rows = [(k, k % 4, [float(x) for x in v]) for k, v in enumerate(made)]
    return spark.createDataFrame(rows, "chunk_id BIGINT, repo_id INT, embedding ARRAY<FLOAT>")


def as_queries(chunks, upto: int):
    return chunks.where(F.col("chunk_id") < upto).select(F.col("chunk_id").alias("query_id"), "repo_id", F.col("embedding").alias("vector"))


def cosines(made: np.ndarray) -> np.ndarray:
    unit = made.astype(np.float64) / np.linalg.norm(made.astype(np.float64), axis=1, keepdims=True)
    return unit @ unit.T


@pytest.mark.parametrize(("slice_rows", "query_block"), [(5_000, 5_000), (23, 11)])
def test_dense_hits_are_the_nearest_ones(spark, slice_rows, query_block):
    made = np.random.default_rng(41).uniform(-1, 1, (210, 12)).astype(np.float32)
    chunks = vector_table(spark, made)
    got = retrieval.dense_topk(as_queries(chunks, 25), chunks, k=7, slice_rows=slice_rows, query_block=query_block)
    found = defaultdict(list)
    for r in got.collect():
        found[r["query_id"]].append((r["rank"], r["chunk_id"]))
    near = cosines(made)
    for q in range(25):
        scores = [near[q][c] for _, c in sorted(found[q])]
        assert len(scores) == 7
        assert np.allclose(scores, np.sort(near[q])[::-1][:7], atol=3e-5)


def test_a_scope_is_never_left(spark):
    chunks = vector_table(spark, np.random.default_rng(42).normal(size=(80, 6)).astype(np.float32))
    got = retrieval.dense_topk(as_queries(chunks, 80), chunks, k=3, scope=["repo_id"], slice_rows=9).collect()
    assert len(got) == 240 and all(r["query_id"] % 4 == r["chunk_id"] % 4 for r in got)


def test_chunks_without_a_vector_are_no_hits(spark):
    chunks = vector_table(spark, np.random.default_rng(43).normal(size=(30, 6)).astype(np.float32))
    holed = chunks.withColumn("embedding", F.when(F.col("chunk_id") >= 12, F.col("embedding")))
    got = retrieval.dense_topk(as_queries(chunks, 5), holed, k=100).collect()
    assert Counter(r["query_id"] for r in got) == dict.fromkeys(range(5), 18)
    assert min(r["chunk_id"] for r in got) == 12


def test_fusion_adds_reciprocal_ranks(spark):
    rng = random.Random(45)
    ranked = {name: {q: rng.sample(range(40), rng.randint(0, 12)) for q in range(6)} for name in ("one", "two", "three")}
    tables = {
        name: spark.createDataFrame([(q, c, k + 1) for q, ids in lists.items() for k, c in enumerate(ids)], "query_id INT, chunk_id INT, rank INT")
        for name, lists in ranked.items()
    }
    want: Counter = Counter()
    for lists in ranked.values():
        for q, ids in lists.items():
            for k, c in enumerate(ids):
                want[q, c] += 1 / (C.RRF_K + k + 1)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.rrf_fuse(tables).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-7 for x in want)


NOUNS = ["cache", "socket", "parser", "ledger", "bucket", "thread"]


def word_corpus(spark, seed: int = 46, n: int = 40, alive: float = 0.05):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(NOUNS) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "chunk_id BIGINT, body STRING, embedding ARRAY<FLOAT>")
    return texts, df.withColumn("tokens", lexical.tokens("body")).withColumn("liveness_score", F.lit(alive))


def ask(spark, *questions: str):
    return spark.createDataFrame([(k, q, None) for k, q in enumerate(questions)], "query_id BIGINT, question STRING, vector ARRAY<FLOAT>")


def test_lexical_scores_count_the_words_asked(spark):
    texts, chunks = word_corpus(spark)
    got = retrieval.sparse_topk(ask(spark, "The ledger and the socket?"), chunks, k=1_000).collect()
    want = {k: sum(w in ("ledger", "socket") for w in t.split()) for k, t in enumerate(texts)}
    assert {r["chunk_id"]: r["score"] for r in got} == {k: s for k, s in want.items() if s}
    order = [(-r["score"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order)
    bm25 = retrieval.sparse_topk(ask(spark, "parser"), chunks, k=1_000, mode="bm25").collect()
    assert {r["chunk_id"] for r in bm25} == {k for k, t in enumerate(texts) if "parser" in t}


def test_outcomes_tell_why_nothing_can_be_said(spark):
    _, dead = word_corpus(spark, alive=C.STALE_BELOW / 2)
    queries = ask(spark, "bucket", "zeppelin")
    why = retrieval.search_outcome(queries, retrieval.hybrid_search(queries, dead)).collect()
    assert {r["query_id"]: r["abstained_reason"] for r in why} == {0: "all_stale", 1: "no_hits"}


class FewestWords:
    def __call__(self, questions, texts):
        return np.array([-float(len(t.split())) for t in texts])


def test_a_scorer_decides_the_order_and_unscored_hits_are_last(spark):
    texts, chunks = word_corpus(spark)
    lost = chunks.withColumn("body", F.when(F.col("chunk_id") % 5 != 0, F.col("body")))
    hits = retrieval.hybrid_search(ask(spark, "thread"), lost, scorer=FewestWords).orderBy("rank").collect()
    scored = [r["rerank_score"] for r in hits if r["rerank_score"] is not None]
    assert scored == sorted(scored, reverse=True) and all(r["rerank_score"] is None for r in hits[len(scored) :])
    assert all((r["rerank_score"] is None) == (r["chunk_id"] % 5 == 0) for r in hits)


def test_repositories_take_turns(spark):
    rng = random.Random(47)
    per = {repo: rng.sample(range(60), 8) for repo in ("x", "y", "z")}
    rows = [(1, repo, c, k + 1) for repo, ids in per.items() for k, c in enumerate(ids)]
    got = retrieval.multi_repo_search(spark.createDataFrame(rows, "query_id INT, repo_id STRING, chunk_id INT, rank INT"), n=50)
    shown = [(r["repo_id"], r["chunk_id"]) for r in got.orderBy("merged_rank").collect()]
    ids = [c for _, c in shown]
    assert sorted(ids) == sorted(set(sum(per.values(), [])))
    ranks = [per[repo].index(c) for repo, c in shown]
    assert ranks == sorted(ranks)


def test_quantised_vectors_point_the_same_way(spark):
    chunks = vector_table(spark, np.random.default_rng(48).normal(size=(40, 32)).astype(np.float32))
    back = vectors.dequantize(vectors.quantize("embedding"))
    assert chunks.select(F.min(vectors.cosine("embedding", back))).first()[0] > 0.999


def test_only_chunks_that_are_not_stored_are_embedded(spark):
    rows = [(k % 2, "commit", f"id{k}", f"words of {k}") for k in range(9)]
    chunks = spark.createDataFrame(rows, "repo_id INT, source_type STRING, source_id STRING, text STRING")
    assert vectors.embed(chunks).exceptAll(vectors.embed(chunks.coalesce(1))).isEmpty()
    stored = chunks.where("source_id IN ('id0', 'id4', 'id8')")
    assert {r["source_id"] for r in vectors.embed_new(chunks, stored).collect()} == {f"id{k}" for k in (1, 2, 3, 5, 6, 7)}
    assert vectors.embed_new(chunks, stored, force=True).count() == len(rows)


def test_snapshots_leave_repositories_out(spark):
    repos = spark.createDataFrame([(k, f"org/r{k}") for k in range(6)], "id INT, name STRING")
    chunks = spark.createDataFrame([(k % 6, [0.1 * k, 1.0]) for k in range(30)], "repo_id INT, embedding ARRAY<FLOAT>")
    slim = export.slim_snapshot({"repos": repos, "discussion_chunks": chunks, "file_changes": chunks}, repos.where("id >= 4"))
    counts = {r["table_name"]: r["rows"] for r in export.snapshot_counts(slim).collect()}
    assert counts == {"repos": 4, "discussion_chunks": 20, "file_changes": 0}


def test_names_and_prose_take_different_routes(spark):
    asked = {"openSocket": "A", "Ledger.close": "A", "why do threads wait": "B", "what is a bucket?": "B"}
    got = router.route(spark.createDataFrame([(q,) for q in asked], "question STRING")).collect()
    assert {r["question"]: r["path"] for r in got} == asked


@pytest.mark.parametrize(
    ("answer", "cited"),
    [
        ("so [pr:71] says", {"pr:71"}),
        ("so [pr:7#2] says", {"pr:7"}),
        ("so [pr:7] and [pr:71]", {"pr:7", "pr:71"}),
        ("by [0123456789ab] alone", {"012345678"}),
        ("see #71 only", {"pr:71"}),
        ("nothing here", set()),
    ],
)
def test_citations_name_whole_requests(spark, answer, cited):
    ids = spark.createDataFrame([(1, x) for x in ("pr:7", "pr:71", "012345678")], "question_id INT, evidence_id STRING")
    answers = citations.answer_status(spark.createDataFrame([(1, answer)], "question_id INT, answer STRING"))
    assert {r["evidence_id"] for r in citations.citations(answers, ids).collect()} == cited


def test_expected_requests_are_met_exactly(spark):
    expected = spark.createDataFrame(
        [(1, 0, "pr:7", 10), (2, 0, "pr:1234567", 10), (3, 0, "pr:7", 10), (4, 0, "f00dfeed0123", 10)],
        "query_id INT, nth INT, expected_id STRING, top_k INT",
    )
    hits = spark.createDataFrame(
        [(1, 1, "pr:71"), (2, 1, "pr:1234568"), (3, 1, "pr:71#0"), (3, 2, "pr:7#3"), (4, 5, "f00dfeed0")],
        "query_id INT, rank INT, hit_id STRING",
    )
    got = {r["query_id"]: r["matched_rank"] for r in evalkit.matched_rank(expected, hits).collect()}
    assert got == {3: 2, 4: 5}


def test_an_evaluation_scores_every_kind_of_case(spark):
    cases = [
        {"id": "who-right", "path": "A", "kind": "attribution", "symbol": "s", "expected_sha": "deadbeef0011"},
        {"id": "who-wrong", "path": "A", "kind": "attribution", "symbol": "s", "expected_sha": "deadbeef0011"},
        {"id": "silent", "path": "A", "kind": "abstention", "symbol": "t", "expect_status": "abstained"},
        {"id": "deep", "path": "B", "kind": "retrieval", "query": "q", "top_k": 2, "expected_shas": ["pr:90"]},
        {"id": "gap", "path": "B", "kind": "known_gap", "query": "q", "top_k": 9, "expected_shas": ["pr:90"], "note": "n"},
        {"id": "cites", "path": "S", "kind": "synthesis", "expect": "answer", "expected_citations": ["pr:5"]},
        {"id": "down", "path": "S", "kind": "synthesis", "expect": "answer"},
    ]
    lines = ["# cases", " ", *map(json.dumps, cases)]
    parsed = evalkit.parse_cases(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    answers = spark.createDataFrame(
        [("who-right", "answered", None, "deadbeef0"), ("who-wrong", "answered", None, "deadbeef1"), ("silent", "abstained", "symbol_not_found", None)],
        "id STRING, status STRING, reason STRING, introduced_id STRING",
    )
    hits = spark.createDataFrame([("deep", 3, "pr:90"), ("deep", 1, "pr:9")], "id STRING, rank INT, hit_id STRING")
    checked = spark.createDataFrame([("cites", "answered", None)], "id STRING, status STRING, reason STRING")
    cited = spark.createDataFrame([("cites", "pr:5#1")], "id STRING, evidence_id STRING")
    results = evalkit.run(parsed, answers, hits, checked, cited, parsed.select("id", F.lit(0.25).alias("latency_s")))
    got = {r["id"]: None if r["skipped"] else r["passed"] for r in results.collect()}
    assert got == {"who-right": True, "who-wrong": False, "silent": True, "deep": False, "gap": True, "cites": True, "down": None}
    text = evalkit.report_markdown(results, "Title")
    assert "250ms" in text and all(c["id"] in text for c in cases)


def test_candidates_follow_tiles_and_not_slices(spark):
    """Slices bound the products inside a group; each question keeps k rows for a tile of many slices."""
    chunks = vector_table(spark, np.random.default_rng(5).uniform(-1, 1, (600, 8)).astype(np.float32))
    asked, corpus = (retrieval._with_scope(t, ()) for t in (as_queries(chunks, 600), chunks))
    found = retrieval._best_per_slice(asked, corpus, 5, 10, 10).count()
    assert found <= 600 * 5 * math.ceil(math.sqrt(3 * spark.sparkContext.defaultParallelism))


def test_chunks_meet_questions_in_a_number_of_parts_that_follows_them(spark, monkeypatch):
    texts, chunks = word_corpus(spark)
    queries = ask(spark, texts[0], texts[1])
    want = sorted(map(tuple, retrieval.sparse_topk(queries, chunks, 10).collect()))
    monkeypatch.setattr(retrieval, "TASK_SCORES", 2)
    monkeypatch.setattr(retrieval, "TASK_CHUNKS", 1)
    hits = retrieval.sparse_topk(queries, chunks, 10)
    assert "REPARTITION_BY_NUM" in hits._jdf.queryExecution().executedPlan().toString()
    assert retrieval._placements(queries, chunks) == len(texts)
    assert sorted(map(tuple, hits.collect())) == want


def test_a_part_holds_few_scores_and_few_parts_are_dealt_out(spark):
    def parts(chunks: int, questions: int) -> int:
        return retrieval._placements(spark.range(questions), spark.range(chunks).withColumnRenamed("id", "chunk_id"))

    assert 100_000 * 400 / parts(100_000, 400) <= 500_000
    # so many scores that light parts would be very many: tasks would hold the rows that they deal out
    assert parts(2_000_000, 300) == 200
    assert 2_000_000 * 2_000 / parts(2_000_000, 2_000) <= 4_000_000


def test_pairs_out_of_reach_are_not_scored_with_all_digits():
    """Also for vectors without a number and for ties, which are cut by their place."""
    from changelore.operators.vectors import Nearest, product_error

    rng = np.random.default_rng(21)
    asked, corpus = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(24, 16)), rng.normal(size=(3_000, 16))))
    corpus[1_500:2_500] = corpus[7]
    corpus[40] = np.nan
    seen = []

    def exact(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        seen.append(len(rows))
        return np.einsum("ij,ij->i", asked[rows], corpus[places])

    near = Nearest(24, 5, exact)
    for start in range(0, 3_000, 250):
        raw = asked.astype(np.float32) @ corpus[start : start + 250].astype(np.float32).T
        raw[np.isnan(raw)] = -np.inf
        near.offer(np.arange(24), start, raw, np.full(24, product_error(16)))
    rows, places, values = near.best()
    whole = np.round(asked @ corpus.T, 6)
    whole[np.isnan(whole)] = -np.inf
    want = np.argsort(-whole, axis=1, kind="stable")[:, :5]
    assert (places.reshape(24, 5) == want).all() and (rows == np.repeat(np.arange(24), 5)).all()
    assert (values.reshape(24, 5) == np.take_along_axis(whole, want, 1)).all()
    assert sum(seen) < 24 * 3_000 / 2
