"""Symbol index over the code files at HEAD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelore.functions import code
from changelore.functions import text as X
from changelore.runtime import broadcast_if_small, checkpointed

FILE = ["repo_id", "path"]


def code_files(files: DataFrame) -> DataFrame:
    return files.where(X.has_code_suffix("path"))


def marks(files: DataFrame) -> DataFrame:
    """Declarations and braces of every code file, in text order.

    Strings and comments are blanked first, so braces and words inside them count for nothing, and lines
    that are blank then are passed over.  The patterns are tried by a generator, once for each line.  Only
    lines with a mark leave the scan; file contents are not shuffled.
    """
    lines = (
        code_files(files)
        .select(*FILE, F.posexplode(X.lines(code.blanked("content"))).alias("at", "line"))
        .where(F.trim("line") != "")
        .select("*", F.explode(F.array(code.declaration("line"))).alias("opened"))
    )
    opened = F.col("opened")
    one_line = F.col("line").rlike(r"^[^{]*;\s*$") | opened["kind"].isin(*code.SIGNATURES)
    declared = F.when(
        opened.isNotNull(),
        F.array(
            F.struct(
                F.lit(0).alias("ord"),
                F.lit(0).alias("delta"),
                opened["kind"].alias("kind"),
                opened["name"].alias("name"),
                one_line.alias("one_line"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<ord:int,delta:int,kind:string,name:string,one_line:boolean>>"))
    brackets = F.transform(
        code.braces("line"),
        lambda b, i: F.struct(
            (i + 1).alias("ord"),
            F.when(b == "{", 1).otherwise(-1).alias("delta"),
            F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("boolean").alias("one_line"),
        ),
    )
    return lines.select(
        *FILE, (F.col("at") + 1).alias("line_no"), F.explode(F.concat(declared, brackets)).alias("m")
    ).select(*FILE, "line_no", "m.*")


def brace_spans(marked: DataFrame) -> DataFrame:
    """End line of every declaration: where the depth first returns to its level.

    Two running windows over one file each; the second reuses the placement of
    the first.  A file is one row of bounded size, so no group is unbounded.
    """
    order = ["line_no", "ord"]
    depth = F.sum("delta").over(W.partitionBy(*FILE).orderBy(*order))
    level = marked.withColumn("level", depth).where(
        F.col("kind").isNotNull() | (F.col("delta") == -1)
    )
    closer = F.when(F.col("delta") == -1, F.col("line_no"))
    backwards = (
        W.partitionBy(*FILE, "level")
        .orderBy(F.col("line_no").desc(), F.col("ord").desc())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    spans = level.withColumn("_close", F.last(closer, ignorenulls=True).over(backwards)).where(
        F.col("kind").isNotNull()
    )
    end = F.when(F.col("one_line"), F.col("line_no")).otherwise(
        F.coalesce("_close", F.col("line_no"))
    )
    return spans.select(
        *FILE, "name", "kind", F.col("line_no").alias("start_line"), end.alias("end_line")
    )


def symbol_index(files: DataFrame) -> DataFrame:
    """The earliest declaration of every (repository, path, name)."""
    spans = brace_spans(marks(files))
    return (
        spans.groupBy(*FILE, "name")
        .agg(F.min_by(F.struct("kind", "start_line", "end_line"), "start_line").alias("s"))
        .select(*FILE, "name", "s.kind", "s.start_line", "s.end_line")
    )


def files_with_symbols(files: DataFrame, questions: DataFrame) -> DataFrame:
    """Code files that mention an asked name: the guard in front of the index.

    One semi join on identifiers instead of a text search per name.
    """
    asked = broadcast_if_small(questions.select(F.col("symbol").alias("word")).distinct())
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}_$]+"), F.lit(0)))
    mentioned = (
        code_files(files)
        .select(*FILE, F.explode_outer(words).alias("word"))
        .join(asked, "word", "left_semi")
        .select(*FILE)
        .distinct()
    )
    return files.join(mentioned, FILE, "left_semi")


def locate(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Span per question (question_id, repo_id, symbol, file): in the given file, else in
    the first path that declares the symbol.

    A name that many files declare is reduced to its first path before it meets questions, and a
    question with a file meets that file only, so a shared name never multiplies its files by its questions.
    """
    asked = broadcast_if_small(
        questions.select("question_id", "repo_id", F.col("symbol").alias("name"), "file")
    )
    key = ["repo_id", "name"]
    span = F.struct("repo_id", "path", "name", "kind", "start_line", "end_line").alias("s")
    # Two steps read the asked names' declarations, so they are written once.
    index = checkpointed(index.join(asked.select(*key).distinct(), key, "left_semi"))
    first = index.groupBy(*key).agg(F.min_by(span, "path").alias("s"))
    anywhere = asked.where(F.col("file").isNull()).join(first, key).select("question_id", "s")
    there = asked.where(F.col("file").isNotNull()).withColumnRenamed("file", "path")
    here = there.join(index, [*key, "path"]).select("question_id", span)
    return (
        anywhere.unionByName(here)
        .groupBy("question_id")
        .agg(F.min_by("s", "s.path").alias("s"))
        .select("question_id", "s.*")
        .withColumnRenamed("name", "symbol")
    )
