"""Line-range lineage of symbols, and the noise-filtered timeline built on it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelore import constants as C
from changelore.functions import text as X
from changelore.operators import catalog, graph, skew, symbols
from changelore.runtime import broadcast_if_small, checkpointed, checkpointed_count, small

FILE = ["repo_id", "path"]
BLOCK_HUNKS = 50_000
TASK_HUNKS = 25_000
SYMBOLS_PER_TASK = 1_024
_FINE = 512


# ------------------------------------------------------------------- renames


def rename_events(changes: DataFrame) -> DataFrame:
    """(repo_id, old_path, path, ord) of renames and copies; `ord` is the commit's position."""
    return changes.where(F.col("status").isin(C.RENAMED, C.COPIED)).select(
        "repo_id", "old_path", "path", "ord"
    )


def with_final_path(rows: DataFrame, renames: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Add `final_path`: the name that the file of (path, ord) carries in the end.

    A row's next rename is the first one away from its path after `ord`; renames
    are linked the same way and their chains closed by pointer doubling.
    """
    events = renames.select(
        "repo_id", "old_path", "path", "ord", F.xxhash64("repo_id", "old_path", "path", "ord").alias("event")
    ).dropDuplicates(["repo_id", "event"])
    leaving = events.select("repo_id", F.col("old_path").alias("path"), "ord", "event")
    linked = _next_event(events.select("repo_id", "path", "ord", F.col("event").alias("id")), leaving, width)
    links = linked.where(F.col("next_event").isNotNull()).select(
        "repo_id", F.col("id").alias("event"), "next_event"
    )
    ends = graph.resolve_chain(links, ["repo_id"], "event", "next_event").select(
        "repo_id", F.col("event").alias("next_event"), F.col("last").alias("_last")
    )
    names = events.select("repo_id", F.col("event").alias("_last"), F.col("path").alias("_named"))
    tagged = rows.withColumn("id", F.lit(None).cast("long"))
    placed = _next_event(tagged, leaving, width).drop("id")
    return (
        placed.join(ends, ["repo_id", "next_event"], "left")
        .withColumn("_last", F.coalesce("_last", "next_event"))
        .join(names, ["repo_id", "_last"], "left")
        .withColumn("final_path", F.coalesce("_named", "path"))
        .drop("_last", "_named", "next_event")
    )


def _next_event(rows: DataFrame, leaving: DataFrame, width: int) -> DataFrame:
    marker = leaving.withColumn("_row", F.lit(False))
    both = rows.withColumn("_row", F.lit(True)).unionByName(marker, allowMissingColumns=True)
    return (
        skew.carry_backward(both, FILE, "ord", "event", width, "next_event")
        .where("_row")
        .drop("_row", "event")
    )


def rename_chain(changes: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Every rename with the final name of its file."""
    events = rename_events(changes)
    return with_final_path(events, events, width)


# ------------------------------------------------------------------- lives of files

#: A position behind every commit.
NEVER = 1 << 60


def births(changes: DataFrame) -> DataFrame:
    """(repo_id, path, ord, old_path, event): commits at which a path starts a new life.

    `old_path` is where a renamed or copied file comes from; an added file comes from nowhere.
    """
    came = F.when(F.col("status").isin(C.RENAMED, C.COPIED), F.col("old_path"))
    return (
        changes.where(F.col("status").isin(C.ADDED, C.RENAMED, C.COPIED))
        .groupBy("repo_id", "path", "ord")
        .agg(F.max(came).alias("old_path"))
        .withColumn("event", F.xxhash64("repo_id", "path", "ord"))
    )


def _with_life(rows: DataFrame, born: DataFrame, width: int, before: bool) -> DataFrame:
    """Add `life`: the event at which the path of (path, ord) was born, or one that stands for the path's root.

    With `before` a birth at `ord` itself does not count.  Positions are doubled and turned around, so that
    "the latest birth up to here" is the nearest value behind a row.
    """
    at = (-2 * F.col("ord") - (0 if before else 1)).alias("_at")
    marks = born.select(*FILE, (-2 * F.col("ord")).alias("_at"), F.col("event").alias("_event"), F.lit(False).alias("_row"))
    both = rows.select("*", at, F.lit(True).alias("_row")).unionByName(marks, allowMissingColumns=True)
    carried = skew.carry_backward(both, FILE, "_at", "_event", 2 * width, "_life").where("_row")
    root = F.xxhash64(F.lit("root"), *FILE)
    return carried.withColumn("life", F.coalesce("_life", root)).drop("_at", "_row", "_event", "_life")


def lives(heads: DataFrame, changes: DataFrame, width: int = 1 << 20) -> DataFrame:
    """The lives of files at HEAD: repo_id, path, was, life, until.

    `heads`: repo_id, path.  A file's life under a name `was` begins at the event `life` and ends in front of
    position `until`, where it was renamed (or copied) to its next name.  Events point to the life their file
    came from; chains are listed by doubling these pointers, so rounds follow the logarithm of the renames.
    """
    heads = heads.select(*FILE).distinct()
    born = checkpointed(births(changes.join(heads.select("repo_id").distinct(), "repo_id", "left_semi")))
    came = born.where(F.col("old_path").isNotNull()).select(
        "repo_id", F.col("old_path").alias("path"), "ord", "event"
    )
    jumps, open_ = checkpointed_count(
        _with_life(came, born, width, before=True).select(
            "repo_id", F.col("event").alias("life"), F.col("life").alias("_to"), F.col("path").alias("_was"), F.col("ord").alias("_until")
        ),
        F.lit(True),
    )
    last = _with_life(heads.withColumn("ord", F.lit(NEVER)), born, width, before=False)
    found = checkpointed(last.select(*FILE, F.col("path").alias("was"), "life", F.lit(NEVER).alias("until")))
    while open_:  # positions fall along a chain, so it ends
        further = found.join(jumps, ["repo_id", "life"]).select(
            *FILE, F.col("_was").alias("was"), F.col("_to").alias("life"), F.col("_until").alias("until")
        )
        found = checkpointed(found.unionByName(further))
        step = jumps.select("repo_id", F.col("life").alias("_to"), F.col("_to").alias("_to2"), F.col("_was").alias("_was2"), F.col("_until").alias("_until2"))
        jumps, open_ = checkpointed_count(
            jumps.join(step, ["repo_id", "_to"]).select(
                "repo_id", "life", F.col("_to2").alias("_to"), F.col("_was2").alias("_was"), F.col("_until2").alias("_until")
            ),
            F.lit(True),
        )
    return found


def follow_renames(rows: DataFrame, heads: DataFrame, changes: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Rows (repo_id, path, ord, ...) under the path that their file has at HEAD, for the files of `heads`.

    A row belongs to the life of its path at its position, and to every file at HEAD that this life led to
    before it went on under another name; a copied file keeps its history and shares it.  A rename commit
    speaks about the new name.  Rows of other files are left out, before anything is placed.
    """
    led = lives(heads, changes, width)
    names = led.select("repo_id", F.col("was").alias("path")).distinct()
    placed = _with_life(rows.join(names, FILE, "left_semi"), births(changes).join(names, FILE, "left_semi"), width, before=False)
    to = led.select("repo_id", F.col("path").alias("_head"), "life", "until")
    return (
        placed.join(to, ["repo_id", "life"])
        .where(F.col("ord") < F.col("until"))
        .withColumn("path", F.col("_head"))
        .select(*rows.columns)
    )


# ------------------------------------------------------------------- range walk


def _walk(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(spans: pa.Table, hunks: pa.Table) -> pa.Table:
        """Carry the open ranges of some files back through one block of their hunks.

        Step k takes the k-th newest hunk of every file at once.  Hunks of one
        commit speak about the same new text, so shifts add up until the
        commit's last hunk and are applied together.
        """
        starts = spans.column("start_line").to_numpy().copy()
        ends = spans.column("end_line").to_numpy().copy()
        of_span, of_hunk = _file_codes(spans, hunks)
        ords = hunks.column("ord").to_numpy()
        order = np.lexsort((hunks.column("new_start").to_numpy(), -ords, of_hunk))
        of_hunk, ords = of_hunk[order], ords[order]
        new_start, new_len, old_start, old_len = (
            hunks.column(c).to_numpy()[order].astype(np.int64)
            for c in ("new_start", "new_len", "old_start", "old_len")
        )
        # An empty side lies after its line.
        first = np.where(new_len > 0, new_start, new_start + 1)
        last = first + new_len - 1
        old_first = np.where(old_len > 0, old_start, old_start + 1)
        old_last = old_first + old_len - 1
        ends_commit = np.ones(len(ords), dtype=bool)
        ends_commit[:-1] = (of_hunk[1:] != of_hunk[:-1]) | (ords[1:] != ords[:-1])
        begin = np.searchsorted(of_hunk, of_span, "left")
        count = np.searchsorted(of_hunk, of_span, "right") - begin

        size = len(starts)
        hit = np.zeros(size, dtype=bool)
        shift = np.zeros((2, size), dtype=np.int64)
        target = np.full((2, size), -1, dtype=np.int64)
        open_ = np.ones(size, dtype=bool)
        active = np.flatnonzero(count > 0)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(active):
            h = begin[active] + step
            s, e = starts[active], ends[active]
            lo, hi = first[h], last[h]
            # A pure deletion sits between two lines and touches ranges that hold both.
            hit[active] |= np.where(new_len[h] > 0, (lo <= e) & (hi >= s), (lo > s) & (lo <= e))
            for side, line, old in ((0, s, old_first[h]), (1, e, old_last[h])):
                shift[side, active] += np.where(hi < line, new_len[h] - old_len[h], 0)
                inside = (lo <= line) & (hi >= line)
                target[side, active[inside]] = old[inside]
            done = ends_commit[h]
            closing = active[done]
            touched = hit[closing]
            hits.append((closing[touched], h[done][touched]))
            # A target of -1 means "in no hunk"; old lines are never negative.
            for side, lines in ((0, starts), (1, ends)):
                lines[closing] = np.where(
                    target[side, closing] >= 0, target[side, closing], lines[closing] - shift[side, closing]
                )
            shift[:, closing] = 0
            target[:, closing] = -1
            hit[closing] = False
            open_[closing] = starts[closing] <= ends[closing]
            step += 1
            active = active[open_[active] & (count[active] > step)]

        span_of = np.concatenate([a for a, _ in hits]) if hits else np.zeros(0, dtype=np.int64)
        hunk_of = np.concatenate([b for _, b in hits]) if hits else np.zeros(0, dtype=np.int64)
        left = np.flatnonzero(open_)
        rows = spans.take(pa.array(np.r_[span_of, left]))
        shas = hunks.column("sha").take(pa.array(order[hunk_of])).combine_chunks()
        none = pa.nulls(len(left), shas.type)
        zeros = np.zeros(len(span_of), dtype=np.int64)
        return pa.table(
            [
                rows.column("repo_id"),
                rows.column("path"),
                rows.column("symbol"),
                pa.concat_arrays([shas, none]),
                pa.array(np.r_[ords[hunk_of], np.zeros(len(left), dtype=np.int64)]),
                pa.array(np.r_[zeros, starts[left]]),
                pa.array(np.r_[zeros, ends[left]]),
                pa.array(np.r_[np.zeros(len(span_of), dtype=bool), np.ones(len(left), dtype=bool)]),
            ],
            names=names,
        )

    return run


def _file_codes(spans: pa.Table, hunks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The same number for the same (repository, path) on both sides."""
    both = pd.concat(
        [t.select(FILE).to_pandas() for t in (spans, hunks)], ignore_index=True
    )
    codes = both.groupby(FILE, sort=False).ngroup().to_numpy()
    return codes[: spans.num_rows], codes[spans.num_rows :]


def _with_blocks(hunks: DataFrame, block_hunks: int) -> DataFrame:
    """Number the hunks of a huge file in blocks of bounded size, newest block 0.

    Files below the limit, normally all of them, are block 0 without a join.
    For a huge file the hunks are counted in narrow position buckets, and the
    running count says at which buckets its blocks begin; only that short list
    is joined back.  `hunks` is read several times, so it is a written table.
    """
    huge, files = checkpointed_count(
        hunks.groupBy(*FILE)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("ord").alias("_hi"), F.min("ord").alias("_lo"))
        .where(F.col("_n") > block_hunks),
        F.lit(True),
    )
    if files == 0:
        return hunks.withColumn("block", F.lit(0))
    buckets = F.ceil(F.col("_n") / block_hunks) * _FINE
    span = F.col("_hi") - F.col("_lo") + 1
    fine = F.floor((F.col("_hi") - F.col("ord")) * buckets / span).cast("long")
    before = W.partitionBy(*FILE).orderBy("_fine").rowsBetween(W.unboundedPreceding, -1)
    begins = (
        hunks.join(small(huge, files), FILE)
        .groupBy(*FILE, fine.alias("_fine"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_block", F.floor(F.coalesce(F.sum("_c").over(before), F.lit(0)) / block_hunks))
        .groupBy(*FILE, "_block")
        .agg(F.min("_fine").alias("_begin"))
        .groupBy(*FILE)
        .agg(F.sort_array(F.collect_list("_begin")).alias("_begins"))
    )
    cuts, files = checkpointed_count(huge.join(begins, FILE), F.lit(True))
    passed = F.size(F.filter("_begins", lambda b: b <= fine)) - 1
    return (
        hunks.join(small(cuts, files), FILE, "left")
        .withColumn("block", F.when(F.col("_n").isNull(), 0).otherwise(passed))
        .drop("_n", "_hi", "_lo", "_begins")
    )


def walk_ranges(
    spans: DataFrame, hunks: DataFrame, block_hunks: int = BLOCK_HUNKS
) -> DataFrame:
    """Commits whose diffs touch a symbol's line range: repo_id, path, symbol, sha, ord.

    `spans`: repo_id, path, symbol, start_line, end_line at HEAD.
    `hunks`: repo_id, path (the file's name at HEAD), sha, ord (commit position,
    one per commit), old_start, old_len, new_start, new_len.

    A range moves through the hunks one commit after the other, so a file's
    hunks stay together, up to a block.  Files and groups of symbols are dealt
    out to tasks of bounded size.  Almost every file is one block and done in
    the first round; only the open ranges of larger files go on to their next
    block.  Hunks of files without a span are left out before they are placed.
    Spans and hunks are read by several steps and computed once.
    """
    spans = checkpointed(spans)
    asked = broadcast_if_small(spans.select(*FILE).distinct())
    asked_hunks = checkpointed(hunks.join(asked, FILE, "left_semi"))
    blocked = _with_blocks(asked_hunks, block_hunks)
    per_block = {r["block"]: r["n"] for r in blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Only files with very many symbols have more than one group; normally there are none.
    wide, files = checkpointed_count(
        spans.groupBy(*FILE)
        .agg(F.ceil(F.count(F.lit(1)) / SYMBOLS_PER_TASK).cast("int").alias("_groups"))
        .where(F.col("_groups") > 1),
        F.lit(True),
    )

    def grouped(rows: DataFrame) -> DataFrame:
        if files == 0:
            return rows.withColumn("_groups", F.lit(1))
        return rows.join(small(wide, files), FILE, "left").withColumn("_groups", F.coalesce("_groups", F.lit(1)))

    names = ["repo_id", "path", "symbol", "sha", "ord", "start_line", "end_line", "is_state"]
    types = [spans.schema["repo_id"].dataType, T.StringType(), spans.schema["symbol"].dataType]
    types += [T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    state = spans
    touched = spans.sparkSession.createDataFrame([], schema).select(*FILE, "symbol", "sha", "ord")
    for block in sorted(per_block):
        tasks = max(1, math.ceil(per_block[block] / TASK_HUNKS))
        task = F.pmod(F.xxhash64(*FILE, "_group"), F.lit(tasks)).alias("_task")
        ranges = grouped(state).select(
            *FILE,
            F.pmod(F.xxhash64("symbol"), F.col("_groups")).cast("int").alias("_group"),
            "symbol",
            F.col("start_line").cast("long").alias("start_line"),
            F.col("end_line").cast("long").alias("end_line"),
        )
        part = grouped(blocked.where(F.col("block") == block)).withColumn(
            "_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))
        )
        walked = checkpointed(
            ranges.select(task, *FILE, "symbol", "start_line", "end_line")
            .groupBy("_task")
            .cogroup(
                part.select(
                    task, *FILE, "sha", "ord", "new_start", "new_len", "old_start", "old_len"
                ).groupBy("_task")
            )
            .applyInArrow(_walk(names), schema)
        )
        touched = touched.unionByName(
            walked.where("NOT is_state").select(*FILE, "symbol", "sha", "ord")
        )
        further = blocked.where(F.col("block") == block + 1).select(*FILE).distinct()
        state = walked.where("is_state").join(further, FILE, "left_semi")
    return touched


def materialize(
    spans: DataFrame, hunks: DataFrame, stored: DataFrame, head: str = "head_sha"
) -> DataFrame:
    """Lineage rows of all spans: stored ones reused, only missing ones walked.

    `stored`: repo_id, path, symbol, head_sha, sha, ord.  Empty walks are not
    stored, so they are walked again.
    """
    key = [*FILE, "symbol", head]
    spans = checkpointed(spans)
    reused = checkpointed(stored.join(spans.select(*key), key, "left_semi")).withColumn("cache_hit", F.lit(True))
    missing = spans.join(reused.select(*key).distinct(), key, "left_anti")
    walked = (
        walk_ranges(missing, hunks)
        .join(missing.select(*key), [*FILE, "symbol"])
        .withColumn("cache_hit", F.lit(False))
    )
    columns = [*key, "sha", "ord", "cache_hit"]
    return reused.select(*columns).unionByName(walked.select(*columns))


# ------------------------------------------------------------------- timeline


def timeline(lineage: DataFrame, commits: DataFrame, labels: DataFrame) -> DataFrame:
    """Every lineage row with its commit, label and role.

    `lineage`: question_id, repo_id, sha, ord.  A missing label counts as
    significant; only the very first commit is the introducing one, noise or not.
    """
    key = ["repo_id", "sha"]
    first = lineage.groupBy("question_id").agg(F.min(F.struct("ord", "sha")).alias("_first"))
    described = (
        lineage.join(commits.select(*key, "author_name", "committed_at", "subject", "body"), key, "left")
        .join(labels.select(*key, "label"), key, "left")
        .join(first, "question_id")
    )
    subject = F.coalesce("subject", F.lit(""))
    is_first = F.struct("ord", "sha") == F.col("_first")
    return described.select(
        "question_id",
        "repo_id",
        "ord",
        F.col("sha").alias("full_sha"),
        X.cut("sha", C.SHA_SHOWN).alias("evidence_id"),
        F.when(is_first, C.INTRODUCED).otherwise(C.ROLE_MODIFIED).alias("role"),
        subject.alias("subject"),
        F.col("author_name").alias("author"),
        "committed_at",
        X.iso_date("committed_at").alias("committed_on"),
        "body",
        X.pr_ref(subject).alias("pr_ref"),
        F.coalesce("label", F.lit(C.SIGNIFICANT)).alias("label"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    """The timeline without noise."""
    return rows.where(F.col("label") == C.SIGNIFICANT)


def _subject_only() -> Column:
    body = X.strip(F.coalesce("body", F.lit("")))
    return (body == "") | (body == X.strip("subject"))


def gate(questions: DataFrame, rows: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """Status and reason per question from its full timeline.

    `located` (question_id) marks the questions whose symbol was found;
    `questions.known_repo`, when present, marks known repositories.
    """
    significant = F.col("label") == C.SIGNIFICANT
    introduced = significant & (F.col("role") == C.INTRODUCED)
    weak = introduced & F.col("pr_ref").isNull() & _subject_only()
    rolled = rows.groupBy("question_id").agg(
        F.count_if(significant).alias("evidence"),
        F.count_if(~significant).alias("noise_dropped"),
        F.max(F.when(introduced, F.col("evidence_id"))).alias("introduced_id"),
        F.bool_or(weak).alias("_weak"),
    )
    asked = questions.join(rolled, "question_id", "left")
    if located is not None:
        found = located.select("question_id").distinct().withColumn("_found", F.lit(True))
        asked = asked.join(found, "question_id", "left")
    else:
        asked = asked.withColumn("_found", F.lit(True))
    known = F.col("known_repo") if "known_repo" in questions.columns else F.lit(True)
    n = F.coalesce("evidence", F.lit(0))
    weak_single = (n == 1) & F.coalesce("_weak", F.lit(False))
    reason = (
        F.when(~F.coalesce(known, F.lit(False)), C.UNKNOWN_REPO)
        .when(F.col("_found").isNull(), C.SYMBOL_NOT_FOUND)
        .when(n == 0, C.NO_SIGNIFICANT_HISTORY)
        .when(weak_single, C.SINGLE_UNCITED_COMMIT)
    )
    status = (
        F.when(reason.isNull(), C.ANSWERED)
        .when(reason == C.SINGLE_UNCITED_COMMIT, C.LOW_CONFIDENCE)
        .otherwise(C.ABSTAINED)
    )
    return asked.select(
        "question_id",
        status.alias("status"),
        reason.alias("reason"),
        n.alias("evidence"),
        F.coalesce("noise_dropped", F.lit(0)).alias("noise_dropped"),
        "introduced_id",
    )


def why(
    questions: DataFrame,
    located: DataFrame,
    hunks: DataFrame,
    commits: DataFrame,
    labels: DataFrame,
    changes: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, timeline) of a table of symbol questions.

    Questions about the same span share one walk.  Three steps read the located
    spans, so they are written once.  With `changes` (file changes with `ord`)
    ranges go on under the names a file had before; with `stored` lineage rows
    (see `materialize`, the head in `located.head_sha`) only missing spans are walked.
    """
    located = checkpointed(located)
    key = [*FILE, "symbol"]
    spans = located.select(*key, "start_line", "end_line", *(["head_sha"] if stored is not None else [])).distinct()
    if changes is not None:
        hunks = follow_renames(hunks, spans.select(*FILE), changes)
    if stored is not None:
        walked = materialize(spans, hunks, stored).select(*key, "sha", "ord")
    else:
        walked = walk_ranges(spans, hunks)
    per_question = located.select("question_id", *key).join(walked, key)
    rows = timeline(per_question.select("question_id", "repo_id", "sha", "ord"), commits, labels)
    return gate(questions, rows, located), rows


def why_job(
    questions: DataFrame,
    repos: DataFrame,
    files: DataFrame,
    hunks: DataFrame,
    commits: DataFrame,
    labels: DataFrame,
    changes: DataFrame,
    stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, timeline) from questions (question_id, repo, symbol, file) that name a repository.

    An unknown repository is an answer of its own.  Only files that mention an asked name are looked
    through for declarations; ranges follow renames; stored lineage of a repository's head is reused.
    """
    named = checkpointed(catalog.resolve_repos(questions, repos))
    known = named.where("known_repo")
    mentioned = symbols.files_with_symbols(files, known)
    located = symbols.locate(known, symbols.symbol_index(mentioned))
    heads = repos.select(F.col("id").alias("repo_id"), "head_sha")
    located = located.join(broadcast_if_small(heads), "repo_id")
    return why(named, located, hunks, commits, labels, changes, stored)
