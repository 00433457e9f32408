"""Symbols, range walks, gates and graphs, on sources and histories that are put together by rule."""

from __future__ import annotations

import difflib
import random

import pytest

import pytest
from pyspark.sql import functions as F

from changelore import constants as C
from changelore import schemas
from changelore.operators import evidence, graph, lineage, symbols

SPAN = "repo_id INT, path STRING, symbol STRING, start_line INT, end_line INT"

# (kind, name, lines of the declaration); members lie inside the lines of their class
PARTS = [
    ("function_declaration", "load", ["async function load(url) {", "  if (!url) {", "    return null;", "  }", "  return get(url);", "}"]),
    ("variable_declarator", "pick", ["export const pick = (row) => {", "  return row[0];", "};"]),
    ("function_declaration", "braces", ["function braces() {", "  const s = \"{\"; // {", "  /* { {", "  */", "  return s + '}' + `{`;", "}"]),
    ("generator_function_declaration", "walk", ["function* walk(tree) {", "  yield tree;", "}"]),
    ("class_declaration", "Store", ["class Store {", "  size() { return 0; }", "  put(key, value) {", "    this.map[key] = value;", "  }", "}"]),
    ("function_signature", "outside", ["declare function outside(id: string): void;"]),
    ("function_declaration", "short", ["function short() { return 1; }"]),
]


def test_spans_are_those_of_the_parts_put_together(spark):
    rng = random.Random(2)
    files, want = [], {}
    for k, suffix in enumerate(["js", "ts", "jsx", "tsx"]):
        order = rng.sample(PARTS, len(PARTS))
        lines: list[str] = []
        for kind, name, body in order:
            lines += ["// it's a remark {"] * rng.randint(0, 3)
            want[f"m{k}.{suffix}", name] = (kind, len(lines) + 1, len(lines) + len(body))
            if name == "Store":
                want[f"m{k}.{suffix}", "size"] = ("method_definition", len(lines) + 2, len(lines) + 2)
                want[f"m{k}.{suffix}", "put"] = ("method_definition", len(lines) + 3, len(lines) + 5)
            lines += body
        files.append((6, f"m{k}.{suffix}", "\n".join(lines) + "\n"))
    files.append((6, "script.rb", "\n".join(PARTS[0][2])))
    index = symbols.symbol_index(spark.createDataFrame(files, "repo_id INT, path STRING, content STRING"))
    assert {(r["path"], r["name"]): (r["kind"], r["start_line"], r["end_line"]) for r in index.collect()} == want


def test_interface_members_are_signatures(spark):
    text = "interface Port {\n  open(speed: number): boolean;\n  close?(): void,\n  speed: number;\n}\nuse(port);\n"
    index = symbols.symbol_index(spark.createDataFrame([(6, "port.ts", text)], "repo_id INT, path STRING, content STRING"))
    assert {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in index.collect()} == {
        ("open", "method_signature", 2, 2),
        ("close", "method_signature", 3, 3),
    }


def test_a_name_is_found_in_its_file_or_the_first_path(spark):
    files = [(6, f"dir{k}/part.js", "function shared() {\n}\n" if k else "let a;\n") for k in range(4)]
    index = symbols.symbol_index(spark.createDataFrame(files, "repo_id INT, path STRING, content STRING"))
    asked = [(1, 6, "shared", None), (2, 6, "shared", "dir3/part.js"), (3, 6, "shared", "dir0/part.js"), (4, 9, "shared", None)]
    found = symbols.locate(spark.createDataFrame(asked, "question_id INT, repo_id INT, symbol STRING, file STRING"), index)
    assert {r["question_id"]: r["path"] for r in found.collect()} == {1: "dir1/part.js", 2: "dir3/part.js"}


# ------------------------------------------------------------------ range walk


class History:
    """A file whose lines know the edits that made them; edits are kept as context-free hunks."""

    def __init__(self, seed: int) -> None:
        self.rng, self.lines, self.steps = random.Random(seed), [], []

    def edit(self, times: int) -> None:
        new = list(self.lines)
        for _ in range(times):
            at = self.rng.randint(0, len(new))
            if new and self.rng.random() < 0.35:
                del new[min(at, len(new) - 1)]
            else:
                new[at:at] = [f"{len(self.steps)}/{self.rng.random()}" for _ in range(self.rng.randint(1, 4))]
        blocks = []
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, self.lines, new, autojunk=False).get_opcodes():
            if tag != "equal":  # an empty side is numbered by the line before it
                blocks.append((i1 + (i2 > i1), i2 - i1, j1 + (j2 > j1), j2 - j1))
        self.lines = new
        self.steps.append(blocks)

    def walked(self, start: int, end: int) -> set[int]:
        """Steps that touch the range, by moving both ends back through every step."""
        out = set()
        for step in reversed(range(len(self.steps))):
            if start > end:
                return out
            ends = []
            for line in (start, end):
                moved = line
                for old, n_old, new, n_new in self.steps[step]:
                    low = new + (n_new == 0)
                    if low <= line < low + n_new:
                        moved = old + (n_old == 0) if line == start and not ends else old + (n_old == 0) + n_old - 1
                        break
                    if low + n_new - 1 < line:
                        moved -= n_new - n_old
                ends.append(moved)
            for _, _, new, n_new in self.steps[step]:
                low = new + (n_new == 0)
                if (n_new and low <= end and low + n_new > start) or (not n_new and start < low <= end):
                    out.add(step)
            start, end = ends
        return out

    def table(self, spark, path: str):
        rows = [(6, f"s{k}", path, None, k, *h) for k, hunks in enumerate(self.steps) for h in hunks]
        return spark.createDataFrame(rows, schemas.HUNKS)


@pytest.mark.parametrize("block", [1_000, 15])
def test_walked_ranges_equal_the_plain_walk(spark, block):
    history = History(31)
    for _ in range(45):
        history.edit(history.rng.randint(1, 3))
    spans, want = [], set()
    for k in range(30):
        start = history.rng.randint(1, len(history.lines))
        end = min(len(history.lines), start + history.rng.randint(1, 9))
        spans.append((6, "made.ts", f"r{k}", start, end))
        want |= {(f"r{k}", step) for step in history.walked(start, end)}
    got = lineage.walk_ranges(spark.createDataFrame(spans, SPAN), history.table(spark, "made.ts"), block_hunks=block)
    assert {(r["symbol"], r["ord"]) for r in got.collect()} == want


def test_stored_lineage_is_taken_as_it_is(spark):
    history = History(3)
    history.edit(2)
    spans = [(6, "f.js", name, 1, 1, "head") for name in ("old", "fresh")]
    stored = spark.createDataFrame([(6, "f.js", "old", "head", "stored-sha", 77)], "repo_id INT, path STRING, symbol STRING, head_sha STRING, sha STRING, ord BIGINT")
    got = lineage.materialize(spark.createDataFrame(spans, SPAN + ", head_sha STRING"), history.table(spark, "f.js"), stored)
    assert {(r["symbol"], r["sha"], r["cache_hit"]) for r in got.collect()} == {("old", "stored-sha", True), ("fresh", "s0", False)}


def test_names_are_followed_through_any_chain_of_renames(spark):
    rng = random.Random(12)
    where, events, seen = {f"file{k}": f"file{k}" for k in range(5)}, [], []
    for step in range(10, 400, 10):
        # note where every file is now, then rename one to a name nobody has
        for first, now in where.items():
            seen.append((first, now, step - 5))
        first = rng.choice(sorted(where))
        free = [f"n{k}" for k in range(8) if f"n{k}" not in where.values()]
        new = rng.choice(free)
        events.append(("renamed", where[first], new, step))
        where[first] = new
    changes = spark.createDataFrame(events, "status STRING, old_path STRING, path STRING, ord BIGINT").withColumn("repo_id", F.lit(6))
    rows = spark.createDataFrame([(now, at) for _, now, at in seen], "path STRING, ord BIGINT").withColumn("repo_id", F.lit(6))
    got = lineage.with_final_path(rows, lineage.rename_events(changes), width=16).collect()
    assert {(r["path"], r["ord"], r["final_path"]) for r in got} == {(now, at, where[first]) for first, now, at in seen}


# ------------------------------------------------------------------ timelines and gates


def timeline_of(spark, steps: list[tuple[str, str, str, str]]):
    """Steps are (sha, subject, body, label) in order."""
    walked = [(4, 6, sha, k) for k, (sha, *_) in enumerate(steps)]
    commits = [(6, sha, "someone", None, None, None, None, None, subject, body) for sha, subject, body, _ in steps]
    return lineage.timeline(
        spark.createDataFrame(walked, "question_id INT, repo_id INT, sha STRING, ord BIGINT"),
        spark.createDataFrame(commits, schemas.COMMITS),
        spark.createDataFrame([(6, sha, label) for sha, _, _, label in steps], "repo_id INT, sha STRING, label STRING"),
    )


LONG = "subject\n\nwith a reason that is given in the body"
OK, NOISE = "significant", "insignificant_whitespace"


@pytest.mark.parametrize(
    ("steps", "status", "introduced", "dropped"),
    [
        ([("s1", "start", LONG, OK), ("s2", "tidy", LONG, NOISE), ("s3", "more", LONG, OK), ("s4", "tidy", LONG, NOISE)], C.ANSWERED, "s1", 2),
        ([("s1", "tidy", LONG, NOISE), ("s2", "start", LONG, OK)], C.ANSWERED, None, 1),
        ([("s1", "tidy", LONG, NOISE)], C.ABSTAINED, None, 1),
        ([("s1", "start", "start", OK)], "low_confidence", "s1", 0),
        ([("s1", "start (#12)", "start (#12)", OK)], C.ANSWERED, "s1", 0),
        ([("s1", "start", LONG, OK)], C.ANSWERED, "s1", 0),
    ],
)
def test_the_gate_judges_the_significant_commits(spark, steps, status, introduced, dropped):
    got = lineage.gate(spark.createDataFrame([(4,)], "question_id INT"), timeline_of(spark, steps)).first()
    assert got["status"] == status
    if status != C.ABSTAINED:
        assert (got["introduced_id"], got["noise_dropped"]) == (introduced, dropped)


def test_only_significant_commits_are_shown_and_the_first_introduces(spark):
    steps = [(f"s{k}", f"subject {k}", LONG, NOISE if k % 3 == 1 else OK) for k in range(9)]
    shown = lineage.evidence(timeline_of(spark, steps)).orderBy("ord").collect()
    assert [r["subject"] for r in shown] == [f"subject {k}" for k in range(9) if k % 3 != 1]
    assert [r["role"] for r in shown] == [C.INTRODUCED] + [C.ROLE_MODIFIED] * (len(shown) - 1)


def test_bundles_stay_within_their_limits(spark):
    steps = [(f"{k:040x}", f"headline {k}", "z" * 2_000, OK) for k in range(40)]
    anchors = spark.createDataFrame([(4, "thing", None, None, None)], "question_id INT, symbol STRING, path STRING, start_line INT, end_line INT")
    text = evidence.bundle(anchors, lineage.evidence(timeline_of(spark, steps))).first()["bundle"]
    assert len(text) <= C.MAX_BUNDLE
    assert text.count("headline") == C.MAX_EVIDENCE_COMMITS
    assert "z" * C.MAX_EVIDENCE_BODY in text and "z" * (C.MAX_EVIDENCE_BODY + 1) not in text


def test_links_join_on_the_whole_hash(spark):
    twins = ["abcdef012" + "1" * 31, "abcdef012" + "2" * 31]  # alike in the nine digits shown
    shown = lineage.evidence(timeline_of(spark, [(twins[0], "one", LONG, OK)]))
    links = spark.createDataFrame([(6, twins[0], 10), (6, twins[1], 20)], "repo_id INT, sha STRING, pr_number BIGINT")
    assert [r["pr_number"] for r in evidence.link_prefix_join(shown, links).collect()] == [10]


# ------------------------------------------------------------------ graphs


def random_graph(seed: int, n: int) -> list[tuple[int, int, int]]:
    """(child, parent, position): every commit has one parent or two among the earlier ones."""
    rng = random.Random(seed)
    edges = []
    for child in range(1, n):
        near = [child - 1] if rng.random() < 0.8 else [rng.randrange(child)]
        if child > 3 and rng.random() < 0.2:
            near.append(rng.choice([p for p in range(child) if p not in near]))
        edges += [(child, p, k) for k, p in enumerate(near)]
    return edges


def edges_of(spark, edges):
    return spark.createDataFrame([(6, f"c{c}", f"c{p}", k) for c, p, k in edges], schemas.COMMIT_PARENTS)


def test_ancestors_of_any_head(spark):
    edges = random_graph(7, 220)
    parents: dict[int, list[int]] = {}
    for c, p, _ in edges:
        parents.setdefault(c, []).append(p)

    def reach(head: int) -> set[int]:
        out, todo = set(), [head]
        while todo:
            at = todo.pop()
            if at not in out:
                out.add(at)
                todo += parents.get(at, [])
        return out

    heads = [219, 140, 60, 0]
    got = graph.ancestors(spark.createDataFrame([(6, f"c{h}") for h in heads], "repo_id INT, head_sha STRING"), edges_of(spark, edges)).collect()
    for h in heads:
        assert {r["sha"] for r in got if r["head_sha"] == f"c{h}"} == {f"c{x}" for x in reach(h)}


def test_order_time_is_the_latest_time_an_ancestor_forces(spark):
    edges = random_graph(9, 70)
    rng = random.Random(9)
    own = {k: 1_600_000_000 + 40 * k + rng.randint(-400, 400) if rng.random() < 0.9 else None for k in range(70)}
    want: dict[int, int] = {}
    for k in range(70):
        forced = [want[p] + 1 for c, p, _ in edges if c == k]
        want[k] = max([own[k] or 0, *forced])
    commits = spark.createDataFrame([(6, f"c{k}", t) for k, t in own.items()], "repo_id INT, sha STRING, t BIGINT")
    commits = commits.select("repo_id", "sha", F.timestamp_seconds("t").alias("committed_at"))
    got = graph.topological_order(commits, edges_of(spark, edges)).collect()
    assert {r["sha"]: r["order_time"] for r in got} == {f"c{k}": t for k, t in want.items()}


def test_ordinary_histories_are_settled_by_single_hops(spark, monkeypatch):
    """Skewed dates on a shallow graph need no spans; with few rounds allowed the spans give the same times."""
    import datetime
    import random

    rng = random.Random(5)
    day = {k: rng.randint(0, 400) for k in range(600)}
    stamp = lambda k: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=day[k])
    commits = spark.createDataFrame(
        [(6, f"c{k}", stamp(k)) for k in day] + [(6, "c0", stamp(0)), (6, None, stamp(0)), (None, "c1", stamp(1))],
        "repo_id INT, sha STRING, committed_at TIMESTAMP",
    )
    edges = [(k, k // n, n - 2) for k in range(1, 600) for n in (2, 3)]
    base, times = int(commits.where("sha = 'c0'").selectExpr("unix_seconds(committed_at)").first()[0]) - day[0], {}
    for k in day:
        times[k] = max([day[k], *[times[k // n] + 1 for n in (2, 3) if k]])
    want = sorted([(6, f"c{k}", base + t) for k, t in times.items()] + [(6, None, base + day[0]), (None, "c1", base + day[1])], key=str)

    spans = []
    real = graph._doubled
    monkeypatch.setattr(graph, "_doubled", lambda *a: spans.append(1) or real(*a))
    for rounds, doubled in ((graph.NEAR_ROUNDS, 0), (2, 1)):
        monkeypatch.setattr(graph, "NEAR_ROUNDS", rounds)
        got = graph.topological_order(commits, edges_of(spark, edges)).collect()
        assert sorted(((r["repo_id"], r["sha"], r["order_time"]) for r in got), key=str) == want
        assert len(spans) == doubled


def test_ancestors_place_the_jumps_once(spark, monkeypatch):
    """The search numbers commits and writes no table of distinct jumps; heads that no edge names reach themselves."""
    monkeypatch.setattr(graph, "shortcuts", None)
    edges = [(k, k // n, n - 2) for k in range(1, 200) for n in (2, 3)]
    heads = spark.createDataFrame([(6, "c150"), (6, "c7"), (6, "c7"), (6, "x"), (9, "c5")], "repo_id INT, head_sha STRING")
    got = [(r["repo_id"], r["head_sha"], r["sha"]) for r in graph.ancestors(heads, edges_of(spark, edges)).collect()]
    want = {(6, "x", "x"), (9, "c5", "c5")}
    for head in (150, 7):
        seen, todo = set(), [head]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += [k // 2, k // 3] if k else []
        want |= {(6, f"c{head}", f"c{k}") for k in seen}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_line_without_times_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = graph.checkpointed_count

    def counted(*args):
        rounds.append(1)
        return real(*args)

    monkeypatch.setattr(graph, "checkpointed_count", counted)
    n = 20_000
    number = F.col("id").cast("string")
    commits = spark.range(n).select(F.lit(6).alias("repo_id"), number.alias("sha"), F.lit(None).cast("timestamp").alias("committed_at"))
    parents = spark.range(1, n).select(
        F.lit(6).alias("repo_id"), number.alias("child_sha"), (F.col("id") - 1).cast("string").alias("parent_sha"), F.lit(0).alias("position")
    )
    got = graph.topological_order(commits, parents)
    assert got.where(F.col("order_time") == F.col("sha").cast("long")).count() == n
    assert len(rounds) <= 24


def test_order_of_lines_that_cross_often(spark):
    """Two lines that hand a raise over to each other, and random graphs without times."""
    n = 30
    crossing = [(c, p, k) for c in range(2, n) for k, p in enumerate((c - 2, c - 1) if c % 3 else (c - 1, c - 2))] + [(1, 0, 0)]
    for edges, size in ((crossing, n), (random_graph(21, 60), 60)):
        want: dict[int, int] = {}
        for k in range(size):
            want[k] = max([0, *(want[p] + 1 for c, p, _ in edges if c == k)])
        commits = spark.createDataFrame([(6, f"c{k}", None) for k in range(size)], "repo_id INT, sha STRING, committed_at TIMESTAMP")
        got = graph.topological_order(commits, edges_of(spark, edges)).collect()
        assert {r["sha"]: r["order_time"] for r in got} == {f"c{k}": t for k, t in want.items()}


def test_a_cycle_of_parents_is_an_error(spark):
    commits = spark.createDataFrame([(6, f"c{k}", None) for k in range(5)], "repo_id INT, sha STRING, committed_at TIMESTAMP")
    with pytest.raises(RuntimeError, match="cycle"):
        graph.topological_order(commits, edges_of(spark, [(1, 0, 0), (2, 1, 0), (3, 2, 0), (1, 3, 1)])).count()
    with pytest.raises(RuntimeError, match="cycle"):
        graph.topological_order(commits, edges_of(spark, [(k, (k + 1) % 5, 0) for k in range(5)])).count()


def renaming_history(seed: int, commits: int):
    """(changes, hunks, names at HEAD): files added, copied, renamed, deleted and born again under free names."""
    rng = random.Random(seed)
    alive, changes, hunks = ["n0", "n1"], [], []
    for o in range(1, commits):
        free = [f"n{i}" for i in range(9) if f"n{i}" not in alive]
        moved = set()
        for _ in range(rng.randint(1, 2)):
            kind = rng.random()
            at = rng.choice(alive)
            if kind < 0.35 and free and at not in moved:
                new = free.pop(rng.randrange(len(free)))
                changes.append((1, f"s{o}", "renamed", new, at, o))
                alive[alive.index(at)] = new
                moved |= {at, new}
            elif kind < 0.45 and free and at not in moved:
                new = free.pop()
                changes.append((1, f"s{o}", "copied", new, at, o))
                alive.append(new)
                moved |= {at, new}
            elif kind < 0.55 and free:
                new = free.pop()
                changes.append((1, f"s{o}", "added", new, None, o))
                alive.append(new)
                moved.add(new)
            elif kind < 0.65 and len(alive) > 2 and at not in moved:
                changes.append((1, f"s{o}", "deleted", at, None, o))
                alive.remove(at)
                moved.add(at)
        hunks += [(1, p, f"s{o}", o) for p in alive if rng.random() < 0.6]
    return changes, hunks, alive


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_histories_are_followed_through_names(spark, seed):
    changes, hunks, alive = renaming_history(seed, 120)

    def history(head: str) -> set:
        """Backwards: at a birth under the present name go on with where it came from."""
        name, out = head, set()
        for o in range(119, 0, -1):
            out |= {(head, o) for _, p, _, at in hunks if at == o and p == name}
            born = [old for _, _, status, new, old, at in changes if at == o and new == name and status in ("added", "renamed", "copied")]
            if born and born[0] is None:
                return out
            if born:
                name = born[0]
        return out

    table = spark.createDataFrame(changes, "repo_id INT, sha STRING, status STRING, path STRING, old_path STRING, ord BIGINT")
    rows = spark.createDataFrame(hunks, "repo_id INT, path STRING, sha STRING, ord BIGINT")
    heads = spark.createDataFrame([(1, p) for p in alive], "repo_id INT, path STRING")
    got = lineage.follow_renames(rows, heads, table, width=16).collect()
    assert len(got) == len(set(got))
    assert {(r["path"], r["ord"]) for r in got} == set().union(*(history(p) for p in alive))


def test_a_file_renamed_very_often_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = lineage.checkpointed_count
    monkeypatch.setattr(lineage, "checkpointed_count", lambda *a: rounds.append(1) or real(*a))
    n = 600
    changes = [(1, f"s{k}", "renamed", f"n{k % 3}", f"n{(k - 1) % 3}", k) for k in range(1, n)]
    table = spark.createDataFrame(changes, "repo_id INT, sha STRING, status STRING, path STRING, old_path STRING, ord BIGINT")
    rows = spark.createDataFrame([(1, f"n{k % 3}", f"s{k}", k) for k in range(n)], "repo_id INT, path STRING, sha STRING, ord BIGINT")
    heads = spark.createDataFrame([(1, f"n{(n - 1) % 3}")], "repo_id INT, path STRING")
    got = lineage.follow_renames(rows, heads, table).collect()
    assert sorted(r["ord"] for r in got) == list(range(n)) and {r["path"] for r in got} == {f"n{(n - 1) % 3}"}
    assert len(rounds) <= 12


def _join_rows(df):
    """The most rows that any join of a finished query made."""
    made = []

    def visit(node):
        rows = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and rows.isDefined():
            made.append(rows.get().value())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return max(made)


def test_a_shared_name_does_not_multiply_files_by_questions(spark):
    index = spark.range(300).select(
        F.lit(1).alias("repo_id"), F.format_string("f%03d.js", "id").alias("path"), F.lit("run").alias("name"),
        F.lit("method_definition").alias("kind"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
    )
    file = F.when(F.col("id") % 2 == 0, F.format_string("f%03d.js", "id"))
    asked = spark.range(300).select(F.col("id").alias("question_id"), F.lit(1).alias("repo_id"), F.lit("run").alias("symbol"), file.alias("file"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        located = symbols.locate(asked, index)
        assert _join_rows(located) <= 300
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = {r["question_id"]: r["path"] for r in located.collect()}
    assert got == {i: f"f{i:03d}.js" if i % 2 == 0 else "f000.js" for i in range(300)}


def _counted_spans(spark, names):
    """Spans that count how often a row of them is computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(1, "a.js", n, 1, 9, "h") for n in names], "repo_id INT, path STRING, symbol STRING, start_line INT, end_line INT, head_sha STRING")
    return rows.mapInPandas(count, rows.schema), seen


HUNK = "repo_id INT, path STRING, sha STRING, ord BIGINT, old_start INT, old_len INT, new_start INT, new_len INT"


def test_spans_of_a_walk_are_computed_once(spark):
    spans, seen = _counted_spans(spark, ["f", "g"])
    hunks = spark.createDataFrame([(1, "a.js", "s1", 1, 2, 1, 2, 1)], HUNK)
    got = lineage.walk_ranges(spans.drop("head_sha"), hunks).collect()
    assert sorted((r["symbol"], r["sha"]) for r in got) == [("f", "s1"), ("g", "s1")]
    assert seen.value == 2


def test_spans_of_stored_lineage_are_computed_once(spark):
    spans, seen = _counted_spans(spark, ["f", "g"])
    hunks = spark.createDataFrame([(1, "a.js", "s1", 1, 2, 1, 2, 1)], HUNK)
    stored = spark.createDataFrame([(1, "a.js", "f", "h", "kept", 7)], "repo_id INT, path STRING, symbol STRING, head_sha STRING, sha STRING, ord BIGINT")
    got = lineage.materialize(spans, hunks, stored).collect()
    assert sorted((r["symbol"], r["sha"], r["cache_hit"]) for r in got) == [("f", "kept", True), ("g", "s1", False)]
    assert seen.value == 2


def test_more_symbols_in_a_file_than_a_task_takes(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SYMBOLS_PER_TASK", 3)
    spans, _ = _counted_spans(spark, [f"s{i}" for i in range(10)])
    hunks = spark.createDataFrame([(1, "a.js", "s1", 1, 2, 1, 2, 1), (1, "a.js", "s2", 2, 2, 1, 2, 1)], HUNK)
    assert lineage.walk_ranges(spans.drop("head_sha"), hunks).count() == 20


def test_files_are_dealt_out_before_they_grow(spark, tmp_path):
    from changelore.plans import lineage_queries

    parts = "p_partkey BIGINT, p_name STRING, p_size INT"
    spark.createDataFrame([(i, "a b", 3) for i in range(50)], parts).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    grown = lineage_queries.files(spark, str(tmp_path))
    assert grown.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
