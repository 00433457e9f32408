from __future__ import annotations

import json

from pyspark.sql import functions as F

from changelore import schemas
from changelore.operators import chunks, lexical, vectors
from changelore.sources import history, sinks
from changelore.streaming import ingest
from tests.test_chunks import request


def page(talk: list[tuple[str, str]], number: int = 7) -> dict:
    """A landed page with one merged request."""
    info = {"hasNextPage": False, "endCursor": None}
    requests = {"pageInfo": info, "nodes": [request(number, "why", talk, f"{number:040d}")]}
    return {"data": {"repository": {"pullRequests": requests}, "rateLimit": {"remaining": 1, "resetAt": None}}}


def log_line(i: int) -> str:
    return json.dumps(
        {
            "repo_id": 1, "sha": f"s{i}", "author_name": "a", "committer_name": "a", "author_time": 1_700_000_000,
            "commit_time": 0 if i == 0 else 1_700_000_000 + i, "message": f"subject {i}\n\nbody",
            "parents": [f"s{i - 1}"] if i else [],
            "files": [{"status": "added", "path": f"f{i}.js", "additions": 2, "deletions": 0}],
        }
    )


def run(spark, base):
    ingest.ingest_commits(spark, f"{base}/landed", f"{base}/tables", f"{base}/progress").awaitTermination()
    return sinks.read_table(spark, f"{base}/tables/commits", schemas.COMMITS)


def test_commit_ingest_is_incremental_and_idempotent(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "a.json").write_text("\n".join(log_line(i) for i in range(5)))
    assert run(spark, tmp_path).count() == 5
    assert run(spark, tmp_path).count() == 5
    (landed / "b.json").write_text("\n".join(log_line(i) for i in range(3, 6)))
    stored = run(spark, tmp_path)
    assert stored.count() == 6
    assert stored.where("sha = 's0'").first()["committed_at"] is None
    assert stored.where("sha = 's4'").first()["subject"] == "subject 4"
    parents = sinks.read_table(spark, f"{tmp_path}/tables/commit_parents", schemas.COMMIT_PARENTS)
    assert parents.count() == 5
    batch = history.commits(history.read_commit_log(spark, str(landed)))
    want = {r["sha"] for r in batch.collect()}
    assert {r["sha"] for r in stored.collect()} == want


def test_pr_backfill_resumes(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()

    def land(name, *pages):
        (landed / name).write_text("\n".join(json.dumps(p) for p in pages))

    def backfill():
        ingest.backfill_prs(spark, str(landed), f"{tmp_path}/t", 1, f"{tmp_path}/p", max_pages=1).awaitTermination()
        return {r["number"]: r["discussion"] for r in ingest.stored_prs(spark, f"{tmp_path}/t").collect()}

    land("1.json", page([]), page([("a", "hello")], number=8))
    land("2.json", page([("b", "late")]))
    assert backfill() == {7: "b: late", 8: "a: hello"}
    assert backfill() == {7: "b: late", 8: "a: hello"}
    land("3.json", page([("c", "ignored")], number=8), page([("d", "new")], number=9))
    assert backfill() == {7: "b: late", 8: "a: hello", 9: "d: new"}
    links = sinks.read_table(spark, f"{tmp_path}/t/commit_pr_links", schemas.COMMIT_PR_LINKS)
    assert links.count() == 3
    counts = ingest.backfill_counts(spark, f"{tmp_path}/t").groupBy("repo_id").agg(F.sum("pages"), F.sum("fetched"), F.sum("stored_new"))
    assert [tuple(r) for r in counts.collect()] == [(1, 5, 5, 3)]
    # a request is one stored row, no read folds batches
    assert sinks.read_keyed(spark, f"{tmp_path}/t/pull_requests", ingest.STORED_PRS).count() == 3


def test_backfill_with_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    for n, pages in enumerate(([page([])], [page([("a", "late")]), page([("b", "x")], number=8)])):
        (landed / f"{n}.json").write_text("\n".join(json.dumps(p) for p in pages))
        ingest.backfill_prs(spark, str(landed), f"{tmp_path}/t", 1, f"{tmp_path}/p{n}").awaitTermination()
    got = {r["number"]: r["discussion"] for r in ingest.stored_prs(spark, f"{tmp_path}/t").collect()}
    assert got == {7: "a: late", 8: "b: x"}


def test_pr_backfills_of_two_repositories_stay_apart(spark, tmp_path):
    for repo, number in ((1, 7), (2, 8)):
        landed = tmp_path / f"landed{repo}"
        landed.mkdir()
        (landed / "1.json").write_text(json.dumps(page([("a", f"in {repo}")], number=number)))
        ingest.backfill_prs(spark, str(landed), f"{tmp_path}/t", repo, f"{tmp_path}/p{repo}").awaitTermination()
    got = {(r["repo_id"], r["number"], r["discussion"]) for r in ingest.stored_prs(spark, f"{tmp_path}/t").collect()}
    assert got == {(1, 7, "a: in 1"), (2, 8, "a: in 2")}
    assert ingest.stored_prs(spark, f"{tmp_path}/t", repo_id=2).count() == 1


def test_sinks_and_readers(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "sub" / "A.MD").write_text("# Title\ntext\n")
    (tmp_path / "docs" / "b.txt").write_text("no")
    assert [r["content"] for r in history.read_docs(spark, f"{tmp_path}/docs").collect()] == ["# Title\ntext\n"]

    (tmp_path / "log.txt").write_text("h1\x1f2024-01-02T03:04:05Z\x1fone\x1e\nh2\x1fbad\x1e\nh3\x1f\x1fthree\x1e")
    got = history.read_git_log(spark, f"{tmp_path}/log.txt").collect()
    assert [(r["sha"], r["subject"], r["authored_at"] is None) for r in got] == [("h1", "one", False), ("h3", "three", True)]

    traces = spark.createDataFrame(
        [("synthesis", "m", "p", "r", 5, 1, 2, None, 1, '{"a":1}', None)], schemas.TRACES
    )
    for _ in range(2):
        sinks.append_traces(traces, f"{tmp_path}/traces")
    stored = sinks.read_table(spark, f"{tmp_path}/traces", schemas.TRACES, partitions=())
    assert stored.count() == 2 and stored.where(F.col("created_at").isNull()).isEmpty()


def commit_rows(spark, keys, repo: int = 1):
    rows = [(repo, f"s{k}", f"subject {k}") for k in keys]
    made = spark.createDataFrame(rows, "repo_id INT, sha STRING, subject STRING")
    missing = [c for c in schemas.fields(schemas.COMMITS) if c not in made.columns]
    types = {c.split()[0]: c.split()[1] for c in schemas.COMMITS.split(", ")}
    return made.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in missing])


def test_a_batch_reads_only_the_partitions_of_its_repositories(spark, tmp_path, monkeypatch):
    path, key = f"{tmp_path}/commits", ["repo_id", "sha"]
    for repo in range(4):
        sinks.append_new(spark, commit_rows(spark, range(5), repo), path, schemas.COMMITS, key)
    batch = commit_rows(spark, range(3, 8), 2)
    plan = sinks.touched(sinks.read_table(spark, path, schemas.COMMITS), batch)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan and "= 2)]" in plan
    sinks.append_new(spark, batch, path, schemas.COMMITS, key)
    stored = sinks.read_table(spark, path, schemas.COMMITS)
    assert {r["repo_id"]: r["count"] for r in stored.groupBy("repo_id").count().collect()} == {0: 5, 1: 5, 2: 8, 3: 5}
    # a batch over very many repositories falls back to a join and stores the same
    monkeypatch.setattr(sinks, "LITERAL_PARTITIONS", 1)
    both = commit_rows(spark, range(9), 0).unionByName(commit_rows(spark, range(2), 9))
    for _ in range(2):
        sinks.append_new(spark, both, path, schemas.COMMITS, key)
    stored = sinks.read_table(spark, path, schemas.COMMITS)
    assert {r["repo_id"]: r["count"] for r in stored.groupBy("repo_id").count().collect()} == {0: 9, 1: 5, 2: 8, 3: 5, 9: 2}


def test_a_repeated_batch_replaces_itself_and_compaction_keeps_rows(spark, tmp_path):
    path = f"{tmp_path}/commits"
    for n in range(6):
        sinks.replace_batch(commit_rows(spark, range(4 * n, 4 * n + 4), n % 2), path, schemas.COMMITS, job=7, number=n)
    # cut short and run again with other rows
    sinks.replace_batch(commit_rows(spark, [100], 1), path, schemas.COMMITS, job=7, number=5)
    stored = sinks.read_table(spark, path, schemas.COMMITS)
    want = {f"s{k}" for k in range(20)} | {"s100"}
    assert {r["sha"] for r in stored.collect()} == want
    sinks.compact(spark, path, f"{tmp_path}/compacted", schemas.COMMITS)
    merged = sinks.read_table(spark, f"{tmp_path}/compacted", schemas.COMMITS)
    assert {r["sha"] for r in merged.collect()} == want
    assert len(merged.inputFiles()) == 2 < len(stored.inputFiles())


def test_embedded_chunks_are_whole(spark, tmp_path):
    """Vector, tokens and liveness are stored together, titles uncut; a chunk without files is never stale."""
    rows = [(1, "doc_file", f"d{k}", None, f"Updates {k} " + "t" * 600, f"The body of {k}", [], 0, None) for k in range(6)]
    columns = "repo_id INT, source_type STRING, source_id STRING, authored_at TIMESTAMP, title STRING, body STRING, files_head ARRAY<STRING>, n_files INT, linked_sha STRING"
    spark.createDataFrame(rows, columns).write.json(f"{tmp_path}/landed")
    files = spark.createDataFrame([(1, "doc_file", f"d{k}", f"p{n}") for k in range(5) for n in range(k + 1)], "repo_id INT, source_type STRING, source_id STRING, path STRING")
    alive = spark.createDataFrame([(1, "p0"), (2, "p1"), (1, "p3")], "repo_id INT, path STRING")
    for run in "ab":
        stream = ingest.read_landed(spark, f"{tmp_path}/landed", columns)
        ingest.embed_new(spark, stream.select(*chunks.CHUNK_COLUMNS), f"{tmp_path}/t", f"{tmp_path}/p{run}", files=files, alive=alive).awaitTermination()
    stored = sinks.read_table(spark, f"{tmp_path}/t", schemas.CHUNKS, sinks.CHUNK_PARTITIONS)
    got = {r["source_id"]: r for r in stored.collect()}
    assert len(got) == stored.count() == 6 and all(len(r["title"]) > 600 for r in got.values())
    assert [got[f"d{k}"]["liveness_score"] for k in range(6)] == [1.0, 0.5, 1 / 3, 0.5, 0.4, None]
    assert got["d2"]["tokens"] == ["updates", "2", "t" * 600, "body", "2"]
    again = vectors.HashingEncoder()([got["d2"]["body"]])[0]
    assert abs(sum(a * b for a, b in zip(again, got["d2"]["embedding"], strict=True)) - 1) < 1e-5


def test_inflected_words_meet(spark):
    words = "update updates updated updating stop stops stopped stopping box boxes try tries tried need red sing bus class classes 日本語 über".split()
    got = spark.createDataFrame([(words,)], "w ARRAY<STRING>").select(lexical.stems(F.col("w")).alias("s")).first()["s"]
    assert got[:4] == ["updat"] * 4 and got[4:8] == ["stop"] * 4 and got[8:10] == ["box"] * 2 and got[10:13] == ["try"] * 3
    assert got[13:] == ["need", "red", "sing", "bus", "class", "class", "日本語", "über"]


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    schema, path = "repo_id INT, number BIGINT, v STRING", f"{tmp_path}/keyed"

    def merge(stored, rows):
        both = stored.withColumn("_n", F.lit(0)).unionByName(rows.withColumn("_n", F.lit(1)))
        return both.groupBy("repo_id", "number").agg(F.min_by("v", "_n").alias("v"))

    first = spark.createDataFrame([(r, n, "old") for r in (1, 2) for n in range(60)], schema)
    sinks.upsert(spark, first, path, schema, ["repo_id", "number"], merge, buckets=8)
    files = set(sinks.read_keyed(spark, path, schema).inputFiles())
    sinks.upsert(spark, spark.createDataFrame([(2, 7, "new"), (2, 100, "new"), (3, 1, "new")], schema), path, schema, ["repo_id", "number"], merge, buckets=8)
    table = sinks.read_keyed(spark, path, schema)
    assert {(r["repo_id"], r["number"]): r["v"] for r in table.collect()} == {
        **{(r, n): "old" for r in (1, 2) for n in range(60)}, (2, 100): "new", (3, 1): "new"
    }
    kept = files & set(table.inputFiles())
    assert len(files) - 2 <= len(kept) < len(files)
