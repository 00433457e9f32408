"""Comment threads to discussion text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.operators import skew
from changelore.sources.merge_requests import comment_text, join_comments

# `: `, one body character and the separator: the least a kept comment adds.
_LEAST_CHARS = 3 + len(C.COMMENT_SEPARATOR)


def discussions(
    comments: DataFrame,
    keys: list[str],
    turn: str,
    author: str = "author",
    body: str = "body",
    comment_chars: int | None = None,
    discussion_chars: int | None = None,
) -> DataFrame:
    """One discussion text per thread, its comments whole and in turn order.

    The text is one cell, so a thread is gathered where its text is built.  With `discussion_chars` the text
    is cut, and as every kept comment adds a least number of characters, no comment beyond a fixed rank can
    reach it: the window keeps that many per partition and thread.  Comments of one turn are ordered by text.
    """
    shown = comments.withColumn("_text", comment_text(F.col(author), F.col(body), comment_chars)).where(
        F.col("_text").isNotNull()
    )
    rows = shown.select(*keys, F.col(turn).alias("_turn"), "_text")
    if discussion_chars is not None:
        most = discussion_chars // _LEAST_CHARS + 1
        rows = skew.top_per_key(rows, keys, [F.col("_turn"), F.col("_text")], most, "_rank")
    ordered = F.sort_array(F.collect_list(F.struct("_turn", "_text")))
    return rows.groupBy(*keys).agg(
        join_comments(F.transform(ordered, lambda c: c["_text"]), discussion_chars).alias("discussion")
    )
