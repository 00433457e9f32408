"""Chunks, merge requests, liveness and text helpers: properties of the rules on generated inputs."""

from __future__ import annotations

import json
import random
import string

from pyspark.sql import functions as F

from changelore import constants as C
from changelore import schemas
from changelore.functions import text as X
from changelore.operators import chunks, snapshot, threads
from changelore.sources import merge_requests

SEP = C.COMMENT_SEPARATOR


def split_all(spark, texts: list[str]) -> list[list[str]]:
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    return [r["b"] for r in df.select("i", chunks.split_discussion("t").alias("b")).orderBy("i").collect()]


def letters(parts: list[str]) -> str:
    return "".join(c for part in parts for c in part.replace("---", "") if not c.isspace())


def generated_discussions(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        comments = []
        for _ in range(rng.randint(0, 7)):
            paragraphs = ["".join(rng.choice(string.ascii_letters + "éß ") for _ in range(rng.choice([3, 90, 700, 2300]))) for _ in range(rng.randint(1, 4))]
            comments.append("\n\n".join(paragraphs))
        out.append(comments)
    return out


def test_packed_discussions_lose_nothing_and_are_full(spark):
    made = generated_discussions(21, 90)
    for comments, bins in zip(made, split_all(spark, [SEP.join(c) for c in made]), strict=True):
        # nothing lost, nothing added, order kept
        assert letters(bins) == letters(comments)
        assert all(b == b.strip() and b for b in bins)
        # a bin counts a separator for each comment before its last one
        assert all(len(b) <= C.MAX_SUBCHUNK + len(SEP) for b in bins)
        # whole comments stay whole: a separator stands only between comments that were given
        whole = {c.strip() for c in comments}
        for b in bins:
            pieces = b.split(SEP)
            assert all(p in whole for p in pieces[1:])


def test_neighbouring_bins_of_short_comments_cannot_be_merged(spark):
    rng = random.Random(5)
    comments = ["c" * rng.randint(200, 1500) for _ in range(60)]
    bins = split_all(spark, [SEP.join(comments)])[0]
    assert [c for b in bins for c in b.split(SEP)] == comments
    for left, right in zip(bins, bins[1:], strict=False):
        first = right.split(SEP)[0]
        assert len(left) + len(SEP) + len(first) > C.MAX_SUBCHUNK


def test_blank_discussions_have_no_bins(spark):
    assert split_all(spark, ["", "\n\t ", SEP * 3, " x "]) == [[], [], [], ["x"]]


def test_markdown_sections_begin_at_headings(spark):
    rng = random.Random(8)
    sections = [f"## Part {k}\n" + "\n\n".join("t" * rng.choice([50, 600, 1900]) for _ in range(rng.randint(1, 5))) for k in range(12)]
    df = spark.createDataFrame([("lead in\n" + "\n".join(sections),), (None,)], "t STRING")
    bins, nothing = [r["b"] for r in df.select(chunks.split_markdown("t").alias("b")).collect()]
    assert not nothing
    assert bins[0] == "lead in"
    assert [b.split("\n")[0] for b in bins if b.startswith("## ")] == [f"## Part {k}" for k in range(12)]
    assert letters(bins) == letters(["lead in", *sections])


def commit_row(n: int, subject: str, body: str | None) -> tuple:
    return (3, f"{n:040x}", None, None, None, None, None, None, subject, body)


def test_commits_with_too_little_text_are_no_chunks(spark):
    rows = [
        commit_row(1, "Merge branch 'x' into y", "a long explanation that would be enough for any other commit"),
        commit_row(2, "oops", "oops"),
        commit_row(3, "Lower the timeout of the probe", "Slow disks answered late, and the probe marked them as lost."),
        commit_row(4, "Drop it (#904)", None),
    ]
    touched = [(3, f"{3:040x}", i, "modified", f"lib/part{i}.rs", None, 1, 0) for i in range(11)]
    made = chunks.with_text(
        chunks.commit_chunks(spark.createDataFrame(rows, schemas.COMMITS), spark.createDataFrame(touched, schemas.FILE_CHANGES))
    ).collect()
    by_title = {r["title"]: r for r in made}
    assert set(by_title) == {"Lower the timeout of the probe", "Drop it (#904)"}
    head, rest = by_title["Lower the timeout of the probe"]["text"].split("\n", 1)
    assert head.count("lib/part") == C.HEADER_PATHS and head.endswith("(+6 more)")
    assert rest.startswith("Lower the timeout of the probe\n---\nSlow disks")


def test_rendered_chunks_show_what_is_known(spark):
    df = spark.sql("SELECT timestamp'2031-12-05 23:59:59' AS t, array('m/n.go') AS f, 1 AS n")
    shown = df.select(chunks.render(F.col("t"), F.col("f"), F.col("n"), F.lit("Title"), F.lit("Text")).alias("x"))
    assert shown.first()["x"].split("\n") == ["[2031-12-05] m/n.go", "Title", "---", "Text"]


def request(number: int, body: str, talk: list[tuple[str | None, str]], sha: str | None) -> dict:
    said = [{"author": None if who is None else {"login": who}, "body": what, "createdAt": None} for who, what in talk]
    return {
        "number": number, "title": f"Change {number}", "body": body, "state": "CLOSED", "createdAt": "2033-05-06T07:08:09Z",
        "mergedAt": None, "author": None, "mergeCommit": None if sha is None else {"oid": sha},
        "comments": {"totalCount": len(said), "nodes": said},
    }


def landed(spark, *batches: list[dict]):
    lines = [
        json.dumps({"data": {"repository": {"pullRequests": {"pageInfo": {"hasNextPage": False, "endCursor": None}, "nodes": nodes}},
                             "rateLimit": {"remaining": 1, "resetAt": "later"}}})
        for nodes in batches
    ]
    parsed = spark.createDataFrame([(x,) for x in lines], "value STRING").select(F.from_json("value", schemas.PR_PAGE).alias("p"))
    return merge_requests.parse_pr_pages(parsed.select("p.*")).withColumn("repo_id", F.lit(5))


def test_requests_become_body_and_discussion_chunks(spark):
    sha = "9" * 40
    prs = landed(
        spark,
        [request(31, "Reads go through one queue.", [("zoe", "first"), ("yan", " \n "), (None, "second")], sha)],
        [request(32, " ", [], None), request(33, "", [("zoe", "only talk, with enough words to be kept")], None)],
    )
    rows = {r["number"]: r for r in prs.collect()}
    assert sorted(rows) == [31, 32, 33]
    assert rows[31]["discussion"].split(SEP) == ["zoe: first", "unknown: second"]
    assert [rows[n]["discussion"] is None for n in (31, 32, 33)] == [False, True, False]
    assert rows[31]["merge_sha"] == sha and rows[33]["merge_sha"] is None
    changes = spark.createDataFrame([(5, sha, 0, "deleted", "queue.c", None, 0, 4)], schemas.FILE_CHANGES)
    made = chunks.pr_chunks(prs, merge_requests.pr_links(prs), changes).collect()
    assert {r["source_id"] for r in made if r["source_type"] == "pr_body"} == {"pr:31"}
    assert all(r["files_head"] == ["queue.c"] for r in made if r["source_id"].startswith("pr:31"))


def test_parts_of_a_long_discussion_have_their_own_ids(spark):
    talk = [(f"member{k % 3}", " ".join(["reason"] * 150)) for k in range(25)]
    prs = landed(spark, [request(640, "", talk, None)])
    made = chunks.pr_chunks(prs, merge_requests.pr_links(prs), spark.createDataFrame([], schemas.FILE_CHANGES))
    ids = [r["source_id"] for r in made.where("source_type = 'pr_discussion'").collect()]
    assert len(ids) > 10 and len(set(ids)) == len(ids) and {i.split("#")[0] for i in ids} == {"pr:640"}


def test_a_later_batch_adds_requests_and_missing_discussions_only(spark):
    columns = schemas.fields(schemas.PULL_REQUESTS)
    old = landed(spark, [request(1, "b", [], None), request(2, "b", [("u", "kept")], None)]).select(*columns)
    new = landed(spark, [request(n, "b", [("v", f"new {n}")], None) for n in (1, 2, 3)]).select(*columns)
    found = {r["number"]: r["discussion"] for r in merge_requests.upsert_prs(old, new).collect()}
    assert found == {1: "v: new 1", 2: "u: kept", 3: "v: new 3"}


def test_liveness_is_the_share_of_living_files(spark):
    rng = random.Random(4)
    alive = {f"p{i}" for i in range(30) if rng.random() < 0.4}
    held = [(f"k{k}", 2, f"p{i}") for k in range(8) for i in rng.sample(range(30), k + 1)] + [("empty", 2, None)]
    got = snapshot.liveness(
        spark.createDataFrame(held, "key STRING, repo_id INT, path STRING"),
        spark.createDataFrame([(2, p) for p in sorted(alive)], "repo_id INT, path STRING"),
        ["key"],
    ).collect()
    for r in got:
        paths = [p for key, _, p in held if key == r["key"] and p]
        assert abs(r["liveness_score"] - (sum(p in alive for p in paths) / len(paths) if paths else 0.0)) < 1e-9


def test_slugs_from_every_form_of_address(spark):
    names = ["core", "x.y", "9to5", "a-b_c", "n" * 81]
    forms = ["{}", "github.com/{}", "www.github.com/{}/", "http://github.com/{}.git", "https://www.github.com/{}/issues/4", "https://github.com/{}#top", "github.com/{}?q=1/2", "  {} "]
    good = {form.format(f"org/{name}"): f"org/{name}" for form in forms for name in names}
    bad = ["org", "org/", "/core", "org/core/x", "-org/core", "org/.core", "github.com/org", "GitHub.com/org", "https://example.org/org/core", "https://github.com//core", "org/a b", "org/" + "n" * 82, ""]
    df = spark.createDataFrame([(k,) for k in [*good, *bad]], "raw STRING").select("raw", X.normalize_slug("raw").alias("s"))
    assert {r["raw"]: r["s"] for r in df.collect()} == good | dict.fromkeys(bad)


def test_questions_that_are_names(spark):
    asked = {"parseTree": True, "Parser.next": True, "$scope": True, "größe": True, "two words": False, "a.b.c": False, "q": False, "": False}
    df = spark.createDataFrame([(k,) for k in asked], "q STRING").select("q", X.looks_like_symbol("q").alias("s"))
    assert {r["q"]: r["s"] for r in df.collect()} == asked


def test_white_space_and_line_breaks_are_those_of_unicode(spark):
    blanks = " \t  　"
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\u0085", " ", " "]
    text = "".join(f"line{i}{b}" for i, b in enumerate(breaks)) + "last"
    df = spark.createDataFrame([(f"{blanks}a{blanks}b{blanks}", text)], "t STRING, l STRING")
    row = df.select(X.strip("t").alias("s"), X.collapse_whitespace("t").alias("c"), X.lines("l").alias("l")).first()
    assert row["s"] == f"a{blanks}b" and row["c"] == "a b" and row["l"] == text.splitlines()


def test_nothing_is_cut_unless_asked(spark):
    talk = [("zoe", f"{k} " + "word " * 700) for k in range(12)]
    lines = [json.dumps({"data": {"repository": {"pullRequests": {"nodes": [request(3, "b" * 70_000, talk, None)]}}}})]
    pages = spark.createDataFrame([(x,) for x in lines], "value STRING").select(F.from_json("value", schemas.PR_PAGE).alias("p")).select("p.*")
    whole = merge_requests.parse_pr_pages(pages).first()
    assert len(whole["body"]) == 70_000
    assert whole["discussion"].split(SEP) == [f"{who}: {what}" for who, what in talk]
    cut = merge_requests.parse_pr_pages(pages, comment_chars=50, discussion_chars=400, body_chars=10).first()
    assert cut["body"] == "b" * 10 and len(cut["discussion"]) == 400
    assert cut["discussion"] == SEP.join(f"{who}: {what[:50]}" for who, what in talk)[:400]
    rows = spark.createDataFrame([(1, n, who, what) for n, (who, what) in enumerate(talk)], "conv INT, n INT, author STRING, body STRING")
    assert threads.discussions(rows, ["conv"], "n").first()["discussion"] == whole["discussion"]
    assert threads.discussions(rows, ["conv"], "n", comment_chars=50, discussion_chars=400).first()["discussion"] == cut["discussion"]
