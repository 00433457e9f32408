"""Hybrid retrieval: dense and lexical candidates, fusion, rerank, merge, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.functions import text as X
from changelore.operators import citations, lexical, retrieval, router, vector_index, vectors
from changelore.plans import adapters as A
from changelore.plans.registry import query
from changelore.runtime import checkpointed

STOP = A.sql_list(C.STOP_WORDS)

LEXICAL_SQL = rf"""positions AS (
  SELECT doc_id AS chunk_id, CAST(substr(source, 4) AS INTEGER) AS repo_id, token
  FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS token FROM documents)
  WHERE token NOT IN ({STOP})
), counted AS (SELECT chunk_id, repo_id, token, COUNT(*) AS tf FROM positions GROUP BY ALL
), terms AS (
  SELECT DISTINCT item_id AS query_id, token
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS token FROM benchmark)
  WHERE token NOT IN ({STOP})
), tf_scores AS (
  SELECT query_id, chunk_id, repo_id, CAST(SUM(tf) AS BIGINT) AS score FROM counted JOIN terms USING (token) GROUP BY ALL
), sparse AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM tf_scores QUALIFY rank <= 50
)"""

DENSE_SQL = """vecs AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)
), asked AS (SELECT item_id AS query_id, v AS q FROM benchmark JOIN (
    SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings) ON vec_id = item_id
), sims AS (
  SELECT query_id, vec_id AS chunk_id, label, round(list_cosine_similarity(q, v), 6) AS similarity FROM asked, vecs
), dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims QUALIFY rank <= 50
)"""

FUSED_SQL = """fused AS (
  SELECT query_id, chunk_id, round(SUM(1.0::DOUBLE / (60 + rank)), 9) AS score,
    MAX(rank) FILTER (leg = 'dense') AS dense_rank, MAX(rank) FILTER (leg = 'sparse') AS sparse_rank
  FROM (SELECT query_id, chunk_id, rank, 'dense' AS leg FROM dense
    UNION ALL SELECT query_id, chunk_id, rank, 'sparse' FROM sparse) GROUP BY ALL
), candidates AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, chunk_id) AS fused_rank
  FROM fused QUALIFY fused_rank <= 50
)"""


@query(
    "hybrid_rrf_topk",
    f"""WITH {LEXICAL_SQL}, {DENSE_SQL}, {FUSED_SQL}
    SELECT query_id, CAST(fused_rank AS INTEGER) AS rank, chunk_id, score,
      CAST(coalesce(dense_rank, -1) AS INTEGER) AS dense_rank,
      CAST(coalesce(sparse_rank, -1) AS INTEGER) AS sparse_rank,
      (chunk_id % 10) / 10.0 < 0.34 AS stale
    FROM candidates WHERE fused_rank <= 20""",
)
def hybrid_rrf_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Over the stored index; the texts are read when it is built, not when it is searched."""
    hits = retrieval.hybrid_search(
        A.questions(spark, folder), A.doc_vectors(spark, folder), lexical_index=A.lexical_index(spark, folder)
    )
    missing = F.lit(-1)
    return retrieval.snapshot.with_stale(hits).select(
        "query_id",
        "rank",
        "chunk_id",
        "score",
        F.coalesce("dense_rank", missing).alias("dense_rank"),
        F.coalesce("sparse_rank", missing).alias("sparse_rank"),
        "stale",
    )


@query(
    "sparse_topk_tf",
    f"""WITH {LEXICAL_SQL} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM sparse""",
)
def sparse_topk_tf(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.sparse_topk(A.questions(spark, folder), A.lexical_index(spark, folder))


@query(
    "sparse_topk_bm25",
    f"""WITH {LEXICAL_SQL}, lengths AS (
      SELECT d.doc_id AS chunk_id, coalesce(n, 0) AS len FROM documents d
      LEFT JOIN (SELECT chunk_id, COUNT(*) AS n FROM positions GROUP BY ALL) p ON p.chunk_id = d.doc_id
    ), total AS (SELECT COUNT(*) AS n, AVG(len) AS avg_len FROM lengths),
    df AS (SELECT token, COUNT(*) AS df FROM counted GROUP BY token),
    s AS (
      SELECT t.query_id, c.chunk_id,
        round(SUM(ln(1 + (total.n - df.df + 0.5) / (df.df + 0.5)) * c.tf * 2.2
          / (c.tf + 1.2 * (0.25 + 0.75 * l.len / total.avg_len))), 6) AS score
      FROM counted c JOIN terms t USING (token) JOIN df USING (token) JOIN lengths l USING (chunk_id), total
      GROUP BY ALL)
    SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
    FROM s QUALIFY rank <= 50""",
)
def sparse_topk_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.sparse_topk(A.questions(spark, folder), A.lexical_index(spark, folder), mode="bm25")


# The stemmer's steps on a word w, written out.
PLURAL_SQL = """CASE WHEN w LIKE '%sses' OR w LIKE '%shes' OR w LIKE '%ches' THEN CASE WHEN len(w) >= 5 THEN left(w, len(w) - 2) ELSE w END
  WHEN w LIKE '%ies' THEN CASE WHEN len(w) >= 5 THEN left(w, len(w) - 3) || 'y' ELSE w END
  WHEN w LIKE '%xes' THEN CASE WHEN len(w) >= 5 THEN left(w, len(w) - 2) ELSE w END
  WHEN w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is' THEN w
  WHEN w LIKE '%s' AND len(w) >= 4 THEN left(w, len(w) - 1) ELSE w END"""
TENSE_SQL = """CASE WHEN w LIKE '%eed' THEN CASE WHEN len(w) >= 5 THEN left(w, len(w) - 1) ELSE w END
  WHEN w LIKE '%ied' THEN CASE WHEN len(w) >= 5 THEN left(w, len(w) - 3) || 'y' ELSE w END
  WHEN w LIKE '%ing' THEN CASE WHEN len(w) >= 6 AND regexp_matches(left(w, len(w) - 3), '[aeiouy]') THEN left(w, len(w) - 3) ELSE w END
  WHEN w LIKE '%ed' THEN CASE WHEN len(w) >= 5 AND regexp_matches(left(w, len(w) - 2), '[aeiouy]') THEN left(w, len(w) - 2) ELSE w END
  ELSE w END"""


def stemmed_sql(words: str) -> str:
    """SELECT of every column of `words`, its column w stemmed."""
    return f"""SELECT * REPLACE (CASE WHEN w LIKE '%e' AND len(w) > 3 THEN left(w, len(w) - 1) ELSE w END AS w) FROM (
      SELECT * EXCLUDE (before) REPLACE (CASE WHEN len(w) < len(before)
        AND right(w, 2) IN ('bb', 'dd', 'ff', 'gg', 'mm', 'nn', 'pp', 'rr', 'tt') THEN left(w, len(w) - 1) ELSE w END AS w)
      FROM (SELECT * REPLACE ({TENSE_SQL} AS w), w AS before FROM (SELECT * REPLACE ({PLURAL_SQL} AS w) FROM {words})))"""


@query(
    "stemmed_topk_tf",
    rf"""WITH positions AS (
      SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents
    ), terms AS (
      SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS w FROM benchmark
    ), kept AS (SELECT * FROM positions WHERE w NOT IN ({STOP})), asked AS (SELECT * FROM terms WHERE w NOT IN ({STOP})),
    counted AS (SELECT chunk_id, w, COUNT(*) AS tf FROM ({stemmed_sql("kept")}) GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, CAST(SUM(tf) AS BIGINT) AS score
      FROM counted JOIN (SELECT DISTINCT * FROM ({stemmed_sql("asked")})) USING (w) GROUP BY ALL)
    SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
    FROM s QUALIFY rank <= 50""",
)
def stemmed_topk_tf(spark: SparkSession, folder: str) -> DataFrame:
    """Words of questions and documents meet without their inflection, over a stored index of stems."""
    return retrieval.sparse_topk(A.questions(spark, folder), A.lexical_index(spark, folder, stemmed=True), stemmed=True)


@query(
    "scanned_topk_bm25",
    f"""WITH {LEXICAL_SQL}, lengths AS (
      SELECT d.doc_id AS chunk_id, d.source, coalesce(n, 0) AS len FROM documents d
      LEFT JOIN (SELECT chunk_id, COUNT(*) AS n FROM positions GROUP BY ALL) p ON p.chunk_id = d.doc_id
    ), total AS (SELECT source, COUNT(*) AS n, AVG(len) AS avg_len FROM lengths GROUP BY source),
    placed AS (SELECT c.*, l.source, l.len FROM counted c JOIN lengths l USING (chunk_id)),
    df AS (SELECT source, token, COUNT(*) AS df FROM placed GROUP BY ALL),
    s AS (
      SELECT t.query_id, c.source, c.chunk_id,
        round(SUM(ln(1 + (total.n - df.df + 0.5) / (df.df + 0.5)) * c.tf * 2.2
          / (c.tf + 1.2 * (0.25 + 0.75 * c.len / total.avg_len))), 6) AS score
      FROM placed c JOIN terms t USING (token) JOIN df USING (source, token) JOIN total USING (source) GROUP BY ALL)
    SELECT query_id, CAST(substr(source, 4) AS INTEGER) AS repo_id, chunk_id, score,
      CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
    FROM s QUALIFY rank <= 10""",
)
def scanned_topk_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """Every question in every repository, from the chunks themselves."""
    chunks = A.doc_chunks(spark, folder)
    asked = retrieval.every_repo(A.questions(spark, folder).select("query_id", "question"), chunks)
    hits = retrieval.sparse_topk(
        asked.withColumn("query_id", F.struct("query_id", "repo_id")), chunks, k=10, mode="bm25", scope=["repo_id"]
    )
    return hits.select("query_id.query_id", "query_id.repo_id", "chunk_id", "score", "rank")


def _vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("repo_id"), "embedding"
    )


def _vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("repo_id"), F.col("embedding").alias("vector")
    )


ALL_PAIRS_SQL = """e AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label AS chunk_repo, a.label AS query_repo,
    round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a, e b
)"""


@query(
    "dense_topk_exact",
    f"""WITH {ALL_PAIRS_SQL}
    SELECT query_id, chunk_id, similarity,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
    FROM pairs QUALIFY rank <= 50""",
)
def dense_topk_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector asks for its fifty nearest, in slices and blocks."""
    return retrieval.dense_topk(
        _vector_queries(spark, folder), _vector_chunks(spark, folder), slice_rows=256, query_block=128
    )


@query(
    "dense_topk_scoped",
    f"""WITH {ALL_PAIRS_SQL}
    SELECT query_id, chunk_id, similarity,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
    FROM pairs WHERE chunk_repo = query_repo QUALIFY rank <= 10""",
)
def dense_topk_scoped(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.dense_topk(
        _vector_queries(spark, folder), _vector_chunks(spark, folder), k=10, scope=["repo_id"], slice_rows=64
    )


@query(
    "quantized_topk",
    f"""WITH {ALL_PAIRS_SQL}
    SELECT query_id, chunk_id, similarity,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
    FROM pairs QUALIFY rank <= 10""",
)
def quantized_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Exact search over int8 codes: every question meets every cell, bounds leave a few vectors to score."""
    return vector_index.topk(_vector_queries(spark, folder), A.vector_index(spark, folder, bits=0), k=10)


@query("dense_topk_approx")
def dense_topk_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Probes of the stored sign patterns."""
    return vector_index.topk(_vector_queries(spark, folder), A.vector_index(spark, folder, bits=8), k=10)


@query("approx_recall", "SELECT COUNT(*) AS queries, true AS at_least_0_9, true AS scores_exact FROM embeddings")
def approx_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the stored patterns against brute force has a floor, and what they find is scored exactly."""
    asked, corpus = _vector_queries(spark, folder), _vector_chunks(spark, folder)
    # either is read twice
    exact = checkpointed(retrieval.dense_topk(asked, corpus, k=10))
    found = checkpointed(dense_topk_approx(spark, folder))
    recall = retrieval.recall_against(exact, found)
    same = exact.join(found.select("query_id", "chunk_id", F.col("similarity").alias("_s")), ["query_id", "chunk_id"])
    off = same.agg(F.coalesce(F.max(F.abs(F.col("similarity") - F.col("_s"))), F.lit(0.0)).alias("_off"))
    rolled = recall.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("at_least_0_9"))
    return rolled.withColumn("_one", F.lit(1)).join(off.withColumn("_one", F.lit(1)), "_one").select(
        "queries", "at_least_0_9", (F.col("_off") < 1.5e-6).alias("scores_exact")
    )


@query(
    "multi_repo_merge",
    f"""WITH {ALL_PAIRS_SQL}, per_repo AS (
      SELECT query_id, chunk_repo AS repo_id, chunk_id, similarity,
        row_number() OVER (PARTITION BY query_id, chunk_repo ORDER BY similarity DESC, chunk_id) AS rank
      FROM pairs WHERE query_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 10)
    SELECT query_id, repo_id, chunk_id, CAST(rank AS INTEGER) AS rank,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, repo_id, chunk_id) AS INTEGER) AS merged_rank
    FROM per_repo QUALIFY merged_rank <= 10""",
)
def multi_repo_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Every question is put to every repository; the lists are merged by rank."""
    corpus = _vector_chunks(spark, folder)
    questions = A.questions(spark, folder).select("query_id", "vector")
    asked = retrieval.every_repo(questions, corpus).withColumn(
        "query_id", F.struct("query_id", "repo_id")
    )
    lists = retrieval.dense_topk(asked, corpus, k=10, scope=["repo_id"])
    per_repo = lists.select("query_id.query_id", "query_id.repo_id", "chunk_id", "rank")
    return retrieval.multi_repo_search(per_repo)


@query(
    "multi_repo_rerank",
    f"""WITH {ALL_PAIRS_SQL}, per_repo AS (
      SELECT query_id, chunk_repo AS repo_id, chunk_id, similarity,
        row_number() OVER (PARTITION BY query_id, chunk_repo ORDER BY similarity DESC, chunk_id) AS rank
      FROM pairs WHERE query_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 10),
    merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, repo_id, chunk_id) AS merged_rank
      FROM per_repo QUALIFY merged_rank <= 10),
    words AS (
      SELECT query_id, chunk_id, repo_id, merged_rank, d.text AS body,
        list_distinct([w for w in regexp_split_to_array(lower(b.text), '\\s+') if w != '']) AS qw,
        list_distinct([w for w in regexp_split_to_array(lower(d.text), '\\s+') if w != '']) AS dw
      FROM merged JOIN benchmark b ON b.item_id = query_id LEFT JOIN documents d ON d.doc_id = chunk_id
    ), scored AS (
      SELECT *, CASE WHEN body IS NOT NULL THEN round(len(list_intersect(qw, dw)) / len(qw), 6) END AS rerank_score FROM words)
    SELECT query_id, repo_id, chunk_id, rerank_score,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, merged_rank) AS INTEGER) AS rank
    FROM scored""",
)
def multi_repo_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The merged list of all repositories against the whole texts of its chunks."""
    bodies = A.documents(spark, folder).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    ranked = retrieval.rerank_merged(multi_repo_merge(spark, folder), A.questions(spark, folder), bodies)
    return ranked.select("query_id", "repo_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(
    "search_outcomes",
    f"""WITH {LEXICAL_SQL}, {DENSE_SQL}, {FUSED_SQL}, n AS (
      SELECT query_id, COUNT(*) AS hits, COUNT(*) FILTER ((chunk_id % 10) / 10.0 < 0.34) AS stale_hits
      FROM candidates WHERE fused_rank <= 3 GROUP BY ALL)
    SELECT b.item_id AS query_id, coalesce(hits, 0) AS hits, coalesce(stale_hits, 0) AS stale_hits,
      CASE WHEN hits IS NULL THEN 'no_hits' WHEN hits = stale_hits THEN 'all_stale' END AS abstained_reason
    FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id""",
)
def search_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    asked = A.questions(spark, folder)
    hits = retrieval.hybrid_search(asked, A.doc_chunks(spark, folder), top_n=3)
    return retrieval.search_outcome(asked, hits)


@query(
    "rerank_batch",
    f"""WITH {LEXICAL_SQL}, {DENSE_SQL}, {FUSED_SQL}, words AS (
      SELECT query_id, chunk_id, fused_rank,
        list_distinct([w for w in regexp_split_to_array(lower(b.text), '\\s+') if w != '']) AS qw,
        list_distinct([w for w in regexp_split_to_array(lower(d.text), '\\s+') if w != '']) AS dw
      FROM candidates JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id
    ), scored AS (
      SELECT *, round(len(list_intersect(qw, dw)) / len(qw), 6) AS rerank_score FROM words)
    SELECT query_id, chunk_id, rerank_score,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS INTEGER) AS rank
    FROM scored QUALIFY rank <= 20""",
)
def rerank_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cascade with the default pair scorer on the candidates' whole texts."""
    chunks = A.doc_chunks(spark, folder)
    bodies = A.documents(spark, folder).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("body")
    )
    hits = retrieval.hybrid_search(
        A.questions(spark, folder),
        chunks.join(bodies, "chunk_id"),
        scorer=retrieval.OverlapScorer,
    )
    return hits.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(
    "hit_view",
    f"""WITH {A.REPOS_SQL}, {LEXICAL_SQL}, h AS (SELECT * FROM sparse WHERE rank <= 10)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id,
      CASE chunk_id % 3 WHEN 0 THEN left(md5(CAST(chunk_id AS VARCHAR)), 9) WHEN 1 THEN 'pr:' || CAST(chunk_id AS VARCHAR) || '#2'
        ELSE 'docs/d' || CAST(chunk_id AS VARCHAR) || '.md#1' END AS display_id,
      left(split_part(d.text, chr(10), 1), 120) AS title,
      r.name AS repo, split_part(r.name, '/', 2) AS repo_short,
      'https://github.com/' || coalesce(r.name, '') || CASE chunk_id % 3
        WHEN 0 THEN '/commit/' || left(md5(CAST(chunk_id AS VARCHAR)), 9)
        WHEN 1 THEN '/pull/' || CAST(chunk_id AS VARCHAR)
        ELSE '/blob/HEAD/docs/d' || CAST(chunk_id AS VARCHAR) || '.md' END AS url
    FROM h JOIN documents d ON d.doc_id = chunk_id LEFT JOIN repos r ON r.id = h.repo_id""",
)
def hit_view(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 3
    described = A.documents(spark, folder).select(
        F.col("doc_id").alias("chunk_id"),
        F.expr("CAST(substring(source, 4) AS INT)").alias("repo_id"),
        F.when(kind == 0, C.SOURCE_COMMIT).when(kind == 1, C.SOURCE_PR_DISCUSSION).otherwise(C.SOURCE_DOC).alias("source_type"),
        F.when(kind == 0, F.md5(number))
        .when(kind == 1, F.concat(F.lit("pr:"), number, F.lit("#2")))
        .otherwise(F.concat(F.lit("docs/d"), number, F.lit(".md#1")))
        .alias("source_id"),
        X.first_line("text").alias("title"),
        F.lit(None).cast("timestamp").alias("authored_at"),
        F.lit(None).cast("double").alias("liveness_score"),
    )
    hits = retrieval.sparse_topk(A.questions(spark, folder), A.doc_chunks(spark, folder), k=10)
    ranked = hits.withColumn("dense_rank", F.lit(None).cast("int")).withColumn("sparse_rank", F.col("rank"))
    view = retrieval.hit_view(ranked.join(described, "chunk_id"), A.repos(spark, folder))
    return view.select("query_id", "rank", "chunk_id", "display_id", "title", "repo", "repo_short", "url")


@query(
    "lexical_fill",
    rf"""WITH t AS (
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['kept']
        ELSE [w for w in regexp_extract_all(lower(lang || ' ' || text), '[\p{{L}}\p{{N}}_]+') if w NOT IN ({STOP})] END AS tokens
      FROM documents)
    SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM t""",
)
def lexical_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens are filled from title and body where they are missing."""
    chunks = A.documents(spark, folder).select(
        "doc_id",
        F.col("lang").alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("kept"))).alias("tokens"),
    )
    filled = lexical.with_tokens(chunks)
    return filled.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query(
    "query_tokens",
    f"""SELECT item_id AS query_id, array_to_string(list_sort(list_distinct(
        [w for w in regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') if w NOT IN ({STOP})])), ' ') AS tokens
    FROM benchmark""",
)
def query_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.array_join(F.array_sort(lexical.query_tokens("text")), " ").alias("tokens"),
    )


@query(
    "cosine_distance",
    """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings)
    SELECT a.vec_id, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance
    FROM e a JOIN e b ON b.vec_id = a.vec_id // 2""",
)
def cosine_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against the one with half its id."""
    e = A.table(spark, folder, "embeddings")
    half = e.select(F.col("vec_id").alias("half"), F.col("embedding").alias("other"))
    pairs = e.withColumn("half", F.floor(F.col("vec_id") / 2)).join(half, "half")
    return pairs.select("vec_id", F.round(1 - vectors.cosine("embedding", "other"), 6).alias("distance"))


@query(
    "quantized_vectors",
    """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
    s AS (SELECT vec_id, v, list_max([abs(x) for x in v]) / 127.0::DOUBLE AS scale FROM e)
    SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum([CAST(round(x / scale) AS BIGINT) for x in v]) AS BIGINT) AS code_sum
    FROM s""",
)
def quantized_vectors(spark: SparkSession, folder: str) -> DataFrame:
    q = A.table(spark, folder, "embeddings").select("vec_id", vectors.quantize("embedding").alias("q"))
    total = F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, c: s + c.cast("long"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), total.alias("code_sum"))


@query(
    "embed_batch",
    """SELECT doc_id, 384 AS dim, CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END AS norm, 'hashing-384' AS embedding_model FROM documents""",
)
def embed_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all whole documents with the default encoder."""
    docs = A.documents(spark, folder).select("doc_id", "text")
    encoded = vectors.embed(docs)
    norm = F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")))
    return encoded.select(
        "doc_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"), "embedding_model"
    )


@query(
    "rrf_fusion",
    f"""WITH {LEXICAL_SQL}, {DENSE_SQL}, {FUSED_SQL}
    SELECT query_id, chunk_id, score FROM fused""",
)
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    asked, chunks = A.questions(spark, folder), A.doc_chunks(spark, folder)
    fused = retrieval.rrf_fuse(
        {"dense": retrieval.dense_topk(asked, chunks), "sparse": retrieval.sparse_topk(asked, chunks)}
    )
    return fused.select("query_id", "chunk_id", "score")


ROUTED_SQL = """routed AS (
  SELECT 'q' || CAST(item_id AS VARCHAR) AS question_id, text AS question FROM benchmark
  UNION ALL
  SELECT 'p' || CAST(p_partkey AS VARCHAR),
    CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_name
      WHEN 2 THEN replace(p_name, ' ', '.') ELSE 'x' END FROM part
)"""


@query(
    "router_split",
    f"""WITH {ROUTED_SQL}
    SELECT question_id, CASE WHEN regexp_matches(question, '^[A-Za-z0-9_$]+([.][A-Za-z0-9_]+)?$') AND length(question) > 1
      THEN 'A' ELSE 'B' END AS path FROM routed""",
)
def router_split(spark: SparkSession, folder: str) -> DataFrame:
    return router.route(routed_questions(spark, folder)).select("question_id", "path")


def routed_questions(spark: SparkSession, folder: str) -> DataFrame:
    items = A.table(spark, folder, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"), F.col("text").alias("question")
    )
    kind = F.col("p_partkey") % 4
    names = A.table(spark, folder, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("question_id"),
        F.when(kind == 0, F.replace("p_name", F.lit(" "), F.lit("_")))
        .when(kind == 1, F.col("p_name"))
        .when(kind == 2, F.replace("p_name", F.lit(" "), F.lit(".")))
        .otherwise("x")
        .alias("question"),
    )
    return items.unionByName(names)


# ------------------------------------------------------------------ citations

# Conversation turns as answers; the role decides what stands in front.
ANSWERS_SQL = """answers AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id, conv_id, turn,
    CASE WHEN turn % 5 = 4 THEN '  ' WHEN role = 'system' THEN 'INSUFFICIENT_EVIDENCE: no text'
      WHEN turn % 3 = 0 THEN text || ' [pr:' || CAST(conv_id AS VARCHAR) || ']'
      WHEN turn % 3 = 1 THEN text || ' see #' || CAST(conv_id AS VARCHAR) || ' and #' || CAST(conv_id + 1 AS VARCHAR)
      ELSE 'a ```mermaid' || chr(10) || 'flowchart TD' || chr(10) || '``` ' || text END AS answer
  FROM conversations
), ids AS (
  SELECT question_id, 'pr:' || CAST(conv_id AS VARCHAR) AS evidence_id FROM answers
  UNION ALL SELECT question_id, 'pr:' || CAST(conv_id + 2 AS VARCHAR) FROM answers
  UNION ALL SELECT question_id, 'pr:' || CAST(conv_id // 10 AS VARCHAR) FROM answers WHERE conv_id >= 10
), checked AS (
  SELECT *, CASE WHEN starts_with(answer, 'INSUFFICIENT_EVIDENCE') OR trim(answer) = '' THEN 'abstained' ELSE 'answered' END AS status
  FROM answers
)"""


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    turn = F.col("turn")
    answer = (
        F.when(turn % 5 == 4, F.lit("  "))
        .when(F.col("role") == "system", F.lit("INSUFFICIENT_EVIDENCE: no text"))
        .when(turn % 3 == 0, F.concat("text", F.lit(" [pr:"), conv, F.lit("]")))
        .when(
            turn % 3 == 1,
            F.concat("text", F.lit(" see #"), conv, F.lit(" and #"), (F.col("conv_id") + 1).cast("string")),
        )
        .otherwise(F.concat(F.lit("a ```mermaid\nflowchart TD\n``` "), "text"))
    )
    return A.table(spark, folder, "conversations").select(
        F.concat(conv, F.lit("-"), turn.cast("string")).alias("question_id"), "conv_id", answer.alias("answer")
    )


def _answer_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select(
        "question_id",
        # the number without its last digit must not count as cited by the whole one
        F.explode(F.array(F.col("conv_id"), F.col("conv_id") + 2, F.when(F.col("conv_id") >= 10, F.floor(F.col("conv_id") / 10)))).alias("n"),
    ).where("n IS NOT NULL").select("question_id", F.concat(F.lit("pr:"), F.col("n").cast("string")).alias("evidence_id"))


@query(
    "answer_status",
    f"""WITH {ANSWERS_SQL}
    SELECT question_id, status,
      CASE WHEN starts_with(answer, 'INSUFFICIENT_EVIDENCE') THEN answer
        WHEN trim(answer) = '' THEN 'empty_generation: model returned no content' END AS reason,
      CASE WHEN status = 'answered' THEN md5(CASE WHEN starts_with(answer, 'a ```mermaid')
        THEN 'a  ' || substr(answer, 31) ELSE answer END) END AS answer_digest,
      CASE WHEN status = 'answered' AND starts_with(answer, 'a ```mermaid') THEN 'flowchart TD' END AS diagram
    FROM checked""",
)
def answer_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = citations.answer_status(_answers(spark, folder))
    return rows.select("question_id", "status", "reason", F.md5("answer_text").alias("answer_digest"), "diagram")


CITED_SQL = f"""{ANSWERS_SQL}, direct AS (
  SELECT c.question_id, i.evidence_id FROM checked c JOIN ids i USING (question_id)
  WHERE status = 'answered' AND (contains(answer, '[' || i.evidence_id || ']') OR contains(answer, '[' || i.evidence_id || '#'))
), fallback AS (
  SELECT DISTINCT question_id, 'pr:' || CAST(CAST(m AS BIGINT) AS VARCHAR) AS evidence_id
  FROM (SELECT question_id, unnest(regexp_extract_all(answer, '#([0-9]{{2,6}})', 1)) AS m FROM checked
    WHERE status = 'answered' AND question_id NOT IN (SELECT question_id FROM direct))
  WHERE (question_id, 'pr:' || CAST(CAST(m AS BIGINT) AS VARCHAR)) IN (SELECT (question_id, evidence_id) FROM ids)
)"""


@query(
    "citation_check",
    f"""WITH {CITED_SQL}
    SELECT question_id, evidence_id, true AS direct FROM direct
    UNION ALL SELECT question_id, evidence_id, false FROM fallback""",
)
def citation_check(spark: SparkSession, folder: str) -> DataFrame:
    checked = citations.answer_status(_answers(spark, folder))
    return citations.citations(checked, _answer_ids(spark, folder))
