"""Commit graph: topological order, first-parent jumps, ancestors."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore.runtime import checkpointed, checkpointed_count, small

COMPACT_ROUNDS = 8
#: Rounds of single hops before parent lines are doubled; they settle ordinary histories.
NEAR_ROUNDS = 32
#: Times that such rounds may raise a commit, on the average, before lines are doubled.
NEAR_RAISES = 6
KEY = ["repo_id", "sha"]


def topological_order(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """Corrected commit time per commit: sorting by it puts parents before children.

    The corrected time is the largest, over all ancestors and the commit itself, of "its own time plus the
    hops to it".  Commits are numbered, so rounds move numbers and no names, and the edges lie where their
    targets do: a round of single hops moves only what the last one raised.  Most histories are settled by
    such rounds.  What is still open after some of them, or once they have raised `NEAR_RAISES` times the
    commits, is settled along lines (parents of one position): an edge carries the largest
    "time plus hops" of the ancestors it spans, and composing edges doubles their span, so a run of n skewed
    commits takes log n rounds.  A raise that crosses from one line to another goes on along the edges of
    all spans, from the raised commits only; rounds follow the nesting of merges, not the length of runs.
    Commits without a time count as time 0; parents that are not in `commits` say nothing.
    """
    own = checkpointed(
        commits.select(*KEY, F.coalesce(F.unix_seconds("committed_at"), F.lit(0)).alias("order_time"))
    )
    named = F.col("repo_id").isNotNull() & F.col("sha").isNotNull()
    nodes, n = checkpointed_count(
        own.where(named).groupBy(*KEY).agg(F.max("order_time").alias("own_time")).withColumn("node", F.monotonically_increasing_id()),
        F.lit(True),
    )
    steps = parents.select("repo_id", "position", F.col("child_sha").alias("sha"), F.col("parent_sha").alias("target_sha"))
    targets = nodes.select("repo_id", F.col("sha").alias("target_sha"), F.col("node").alias("target"), F.col("own_time").alias("_t"))
    first, skewed = checkpointed_count(
        steps.join(nodes, KEY)
        .select("repo_id", "position", "node", "own_time", "target_sha")
        .join(targets, ["repo_id", "target_sha"])
        .select("position", "node", "target", F.lit(1).cast("long").alias("hops"), "own_time", (F.col("_t") + 1).alias("gain")),
        F.col("gain") > F.col("own_time"),
    )
    if skewed == 0:
        return own
    times, size = _near(first, nodes, n)
    if size:
        steps = first.drop("gain")
        reached, edges = _doubled(_from_targets(steps, times), n)
        times = checkpointed(_highest(times, reached))
        # what the doubled lines left open shows at single hops
        again = _from_targets(steps, times).where(F.col("gain") > F.col("own_time"))
        frontier, size = checkpointed_count(_above(again.groupBy("node").agg(F.max("gain").alias("order_time")), times), F.lit(True))
        raised, _, size = _settled(edges, frontier, size, times.unionByName(frontier), n)
        if size:
            raise RuntimeError("the parent edges contain a cycle")
        times = _highest(raised)
    unnamed = own.where(~named).groupBy(*KEY).agg(F.max("order_time").alias("order_time"))
    return nodes.join(times, "node").select(*KEY, "order_time").unionByName(unnamed)


def _near(first: DataFrame, nodes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(node, order_time) after rounds of single hops, and how many commits the last round raised.

    Edges are placed by their target and times by their commit once, so only raised times cross to the
    commits above them.
    """
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = first.select("node", "target", "own_time").repartition(parts, "target").persist()
    times = nodes.select("node", F.col("own_time").alias("order_time")).repartition(parts, "node")
    needed = first.where(F.col("gain") > F.col("own_time")).groupBy("node").agg(F.max("gain").alias("_t"))
    raises = 0
    for turn in range(1, NEAR_ROUNDS + 1):
        rose = F.col("_t") > F.col("order_time")
        times = times.join(needed, "node", "left").select(
            "node", F.greatest("order_time", "_t").alias("order_time"), F.coalesce(rose, F.lit(False)).alias("_new")
        )
        # cuts the plan and keeps the placement, which a written table would lose; held twice, so that an executor may go
        times = times.localCheckpoint(storageLevel=StorageLevel.MEMORY_AND_DISK_2)
        size = times.where("_new").count()
        raises += size
        if size == 0 or raises > NEAR_RAISES * n or turn == NEAR_ROUNDS:
            break
        at = times.where("_new").select(F.col("node").alias("target"), (F.col("order_time") + 1).alias("_t"))
        needed = (
            edges.join(at, "target").where(F.col("_t") > F.col("own_time")).groupBy("node").agg(F.max("_t").alias("_t"))
        )
        times = times.drop("_new")
    last = checkpointed(times.select("node", "order_time"))
    edges.unpersist()
    return last, size


def _highest(*times: DataFrame) -> DataFrame:
    """The largest order_time of each commit."""
    both = times[0]
    for more in times[1:]:
        both = both.unionByName(more)
    return both.groupBy("node").agg(F.max("order_time").alias("order_time"))


def _from_targets(steps: DataFrame, times: DataFrame) -> DataFrame:
    """Edges with `gain`, the time of their target plus their hops."""
    target = times.select(F.col("node").alias("target"), F.col("order_time").alias("_t"))
    return steps.join(target, "target").withColumn("gain", F.col("_t") + F.col("hops")).drop("_t")


def _above(needed: DataFrame, raised: DataFrame) -> DataFrame:
    """The rows of `needed` that are above what their commit was raised to."""
    before = raised.groupBy("node").agg(F.max("order_time").alias("_raised"))
    return (
        needed.join(before, "node", "left")
        .where(F.col("_raised").isNull() | (F.col("order_time") > F.col("_raised")))
        .select("node", "order_time")
    )


def _settled(
    edges: DataFrame, frontier: DataFrame, size: int, raised: DataFrame, rounds: int
) -> tuple[DataFrame, DataFrame, int]:
    """Follow edges (node, target, hops, own_time) from raised targets until nothing rises, or for some rounds.

    `raised` holds the frontier.  Edges know the own time of their commit, so a round meets only commits
    that rise above it, and only the raised ones are compared with what they were raised to before.
    """
    for turn in range(rounds):
        if size == 0:
            break
        at = small(frontier.select(F.col("node").alias("target"), F.col("order_time").alias("_t")), size)
        needed = (
            edges.join(at, "target")
            .withColumn("order_time", F.col("_t") + F.col("hops"))
            .where(F.col("order_time") > F.col("own_time"))
            .groupBy("node")
            .agg(F.max("order_time").alias("order_time"))
        )
        frontier, size = checkpointed_count(_above(needed, raised), F.lit(True))
        raised = raised.unionByName(frontier)
        if turn % COMPACT_ROUNDS == COMPACT_ROUNDS - 1:
            raised = checkpointed(raised.groupBy("node").agg(F.max("order_time").alias("order_time")))
    return raised, frontier, size


def _doubled(first: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Times above their own that lines give, and the edges of all spans.

    `first` has the single steps with `gain`.  A step of a line joins the step that begins where it ends:
    spans add up, the larger gain stays.  A line that has reached its root is closed and only looked up.
    """
    state, open_ = checkpointed_count(first.withColumn("_open", F.lit(True)), F.lit(True))
    edges, span = state.drop("_open", "gain"), 1
    while open_:
        if span > 2 * n:
            raise RuntimeError("the parent edges contain a cycle")
        span *= 2
        further = state.select(
            "position", F.col("node").alias("target"), F.col("target").alias("_target"), F.col("hops").alias("_hops"), F.col("gain").alias("_gain")
        )
        moved = state.where("_open").join(further, ["position", "target"], "left")
        found = F.col("_target").isNotNull()
        moved = moved.select(
            "position",
            "node",
            F.coalesce("_target", "target").alias("target"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            "own_time",
            F.greatest("gain", F.col("_gain") + F.col("hops")).alias("gain"),
            found.alias("_open"),
        )
        moved, open_ = checkpointed_count(moved, F.col("_open"))
        if open_:
            edges = edges.unionByName(moved.where("_open").drop("_open", "gain"))
        state = state.where("NOT _open").unionByName(moved)
    rose = state.where(F.col("gain") > F.col("own_time")).groupBy("node").agg(F.max("gain").alias("order_time"))
    return rose, edges


def shortcuts(parents: DataFrame) -> DataFrame:
    """Jumps of 1, 2, 4, ... steps along parents of the same position.

    Columns repo_id, sha, target_sha.  A commit has one parent per position, so
    the first-parent line and the lines of merged parents are each doubled by a
    self join: a linear history of a million commits takes twenty rounds and
    twenty edges per commit.
    """
    return checkpointed(_jumps(parents).distinct())


def _jumps(parents: DataFrame) -> DataFrame:
    """`shortcuts` that may repeat, in one written table for each length."""
    key = ["repo_id", "position"]
    step, size = checkpointed_count(
        parents.select(
            *key, F.col("child_sha").alias("sha"), F.col("parent_sha").alias("target_sha")
        ),
        F.lit(True),
    )
    edges, length, commits = step, 1, size
    while size:
        if length > commits:
            raise RuntimeError("the parent edges contain a cycle")
        length *= 2
        second = step.select(
            *key, F.col("sha").alias("target_sha"), F.col("target_sha").alias("_next")
        )
        step, size = checkpointed_count(
            step.join(second, [*key, "target_sha"]).select(
                *key, "sha", F.col("_next").alias("target_sha")
            ),
            F.lit(True),
        )
        edges = edges.unionByName(step)
    return edges.select("repo_id", "sha", "target_sha")


def ancestors(heads: DataFrame, parents: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Every commit reachable from each head, the head included.

    A breadth-first search over the shortcut edges: a commit d steps along one
    line of parents is found after at most log2(d) rounds, so the rounds follow
    the nesting of merges, not the length of the history.  A commit is expanded
    once.  Only the repositories of the heads are doubled, with numbers for names,
    and their jumps are placed by the commit they start from once, so a round moves
    the newly reached commits alone; `edges` takes shortcuts that are stored already
    (`shortcuts(parents)`).
    """
    asked, size = checkpointed_count(
        heads.select("repo_id", "head_sha", F.col("head_sha").alias("sha")).distinct(), F.lit(True)
    )
    if edges is not None:
        return _searched(edges, asked, size)
    parents = parents.join(small(asked.select("repo_id").distinct(), size), "repo_id", "left_semi")
    pairs = parents.select("repo_id", "position", F.col("child_sha").alias("sha"), F.col("parent_sha").alias("target_sha"))
    nodes = checkpointed(
        pairs.select("repo_id", F.explode(F.array("sha", "target_sha")).alias("sha")).where(F.col("sha").isNotNull())
        .distinct()
        .withColumn("node", F.monotonically_increasing_id())
    )
    targets = nodes.select("repo_id", F.col("sha").alias("target_sha"), F.col("node").alias("parent_sha"))
    numbered = (
        pairs.join(nodes, ["repo_id", "sha"])
        .select("repo_id", "position", F.col("node").alias("child_sha"), "target_sha")
        .join(targets, ["repo_id", "target_sha"])
        .select("repo_id", "position", "child_sha", "parent_sha")
    )
    parts = int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jumps = _jumps(numbered).repartition(parts, "repo_id", "sha").persist()
    begin, n = checkpointed_count(small(asked, size).join(nodes, ["repo_id", "sha"]), F.lit(True))
    found = _searched(jumps, begin.select("repo_id", F.col("node").alias("head_sha"), F.col("node").alias("sha")), n)
    jumps.unpersist()
    names = small(begin.select("repo_id", "head_sha", F.col("node").alias("_head")), n)
    told = (
        found.select("repo_id", F.col("head_sha").alias("_head"), F.col("sha").alias("node"))
        .join(nodes, ["repo_id", "node"])
        .join(names, ["repo_id", "_head"])
        .select("repo_id", "head_sha", "sha")
    )
    lone = asked.join(small(begin, n), ["repo_id", "sha"], "left_anti").select("repo_id", "head_sha", "sha")
    return told.unionByName(lone)


def _searched(edges: DataFrame, frontier: DataFrame, size: int) -> DataFrame:
    """Everything that edges (repo_id, sha, target_sha) reach from the frontier (repo_id, head_sha, sha)."""
    reached, turn = frontier, 0
    while size:  # every round reaches new commits or is the last one
        found = edges.join(small(frontier, size), ["repo_id", "sha"]).select(
            "repo_id", "head_sha", F.col("target_sha").alias("sha")
        )
        frontier, size = checkpointed_count(
            found.distinct().join(reached, ["repo_id", "head_sha", "sha"], "left_anti"), F.lit(True)
        )
        if size:
            reached = reached.unionByName(frontier)
        turn += 1
        if turn % COMPACT_ROUNDS == 0:
            reached = checkpointed(reached)
    return reached


def resolve_chain(links: DataFrame, keys: list[str], node: str, target: str) -> DataFrame:
    """Follow single-successor links to their end by pointer doubling.

    Returns keys, node, `last` (the end of the chain) and `hops`.  Finished
    pointers leave the join, so a star of nodes around one end stays cheap.
    """
    nodes = links.select(*keys, node).distinct().withColumn("_inner", F.lit(True))
    target_key = nodes.select(*keys, F.col(node).alias("last"), "_inner")
    state, pending = checkpointed_count(
        links.select(*keys, node, F.col(target).alias("last"), F.lit(1).cast("long").alias("hops"))
        .join(target_key, [*keys, "last"], "left")
        .select(*keys, node, "last", "hops", F.col("_inner").isNotNull().alias("_open")),
        F.col("_open"),
    )
    for _ in range(64):
        if pending == 0:
            return state.drop("_open")
        step = state.select(
            *keys,
            F.col(node).alias("last"),
            F.col("last").alias("_next"),
            F.col("hops").alias("_more"),
            F.col("_open").alias("_still"),
        )
        moved = (
            state.where("_open")
            .join(step, [*keys, "last"])
            .select(
                *keys,
                node,
                F.col("_next").alias("last"),
                (F.col("hops") + F.col("_more")).alias("hops"),
                F.col("_still").alias("_open"),
            )
        )
        state, pending = checkpointed_count(
            state.where("NOT _open").unionByName(moved), F.col("_open")
        )
    raise RuntimeError("the links contain a cycle")
