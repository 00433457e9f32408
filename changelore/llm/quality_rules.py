"""Line-first cleaning: rules judge every line, failing lines go, then the document is judged by its loss.

All expressions are built-in columns that work inside one row, so the job is a single scan without a
shuffle and a long document or a hot source costs no more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelore.llm.common import settled, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: Largest share of a document's letters and signs that its failing lines may hold.
MAX_LOSS = 0.4

# Openings and phrases of lines that pages add around their text.
BOILERPLATE = [
    "accept all cookies",
    "all trademarks are the property",
    "back to top",
    "by using this site",
    "click here to",
    "cookie policy",
    "enable javascript",
    "follow us on",
    "lorem ipsum",
    "privacy policy",
    "share this article",
    "share this page",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
]


def _count(text: Column, pattern: str) -> Column:
    """Code points of a text that a character class matches."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def signs_of(line: Column) -> Column:
    """What is neither letter, mark, digit nor white space, in order."""
    return F.regexp_replace(line, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")


def punctuation_fails(line: Column, signs: Column) -> Column:
    """Signs instead of prose: more than one in six code points, on a line of 20 or more."""
    n_chars = F.char_length(line)
    return (n_chars >= 20) & (F.char_length(signs) * 6 > n_chars)


def navigation_fails(line: Column, signs: Column) -> Column:
    """A menu or a row of labels: three separators or more, one for every 40 code points at least."""
    bars = F.char_length(F.regexp_replace(signs, "[^|»›•·]+", ""))
    return (bars >= 3) & (bars * 40 >= F.char_length(line))


def boilerplate_fails(line: Column) -> Column:
    """A line of up to 200 code points that opens with one of the fixed phrases, in any case."""
    opening = r"(?i)^[^\p{L}]{0,9}(?:" + "|".join(BOILERPLATE) + ")"
    return (F.char_length(line) <= 200) & line.rlike(opening)


def repeat_words(words: Column, windows: Column) -> Column:
    """Words inside windows found twice or more; `windows` holds (window, position) sorted, NULL if none recurs."""
    last = F.size(windows) - 1
    recurring = F.filter(
        windows,
        lambda x, k: ((k > 0) & (F.get(windows, k - 1)["w"] == x["w"]))
        | ((k < last) & (F.get(windows, k + 1)["w"] == x["w"])),
    )
    starts = F.array_sort(F.transform(recurring, lambda x: x["p"]))
    width = F.lit(REPEAT_WINDOW)
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(width, p + width - 1 - acc["upto"])).alias("n"),
            (p + width - 1).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    return F.when(windows.isNull(), F.lit(0)).otherwise(covered)


#: Columns that `clean` adds.
ADDED = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "n_lines",
    "n_failed_lines",
    "clean_text",
    "lost_chars",
    "kept",
)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with _text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    NULL and empty texts have no words and fail.  Windows are compared as hashes first, built from pairs
    of words, pairs of pairs and so on; only documents in which a hash recurs build and sort the windows
    themselves.
    """
    n = F.size("_words")
    span = F.sequence(F.lit(1), n - (REPEAT_WINDOW - 1))
    has_windows = n > REPEAT_WINDOW
    pair = lambda name, step: F.zip_with(
        name, F.slice(F.col(name), step + 1, n), lambda a, b: F.xxhash64(a, b)
    )
    windows = F.array_sort(
        F.transform(
            span,
            lambda i: F.struct(
                F.array_join(F.slice(F.col("_words"), i, REPEAT_WINDOW), " ").alias("w"), i.alias("p")
            ),
        )
    )
    recurs = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    with_word = F.filter(F.col("_lines"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_lines", F.split("_text", "\n", -1))
        .withColumn("_h1", F.when(has_windows, F.transform("_words", lambda w: F.xxhash64(w))))
        .withColumn("_h2", pair("_h1", 1))
        .withColumn("_h4", pair("_h2", 2))
        .withColumn("_hashes", F.slice(pair("_h4", 4), F.lit(1), n - (REPEAT_WINDOW - 1)))
        .withColumn("_windows", F.when(F.coalesce(recurs, F.lit(False)), windows))
        .withColumn("_worded", with_word)
        .withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", _word_chars(F.col("_text")).cast("long"))
        .withColumn("n_symbols", _count(F.col("_text"), r"[#*$%&|<>]").cast("long"))
        .withColumn("n_dup_lines", (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col("_words"), F.col("_windows")).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
        .drop("_words", "_h1", "_h2", "_h4", "_hashes", "_windows", "_worded")
    )


def clean(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """Judge every line and every document.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_failed_lines, lost_chars, clean_text (the lines that pass) and kept.  A document is kept unless
    its base counts fail or its failing lines hold more than `max_loss` of its word characters.  All
    input columns and repeated rows stay; columns of those names are replaced.  NULL and empty texts are
    not kept and have an empty clean_text; texts of any length are judged whole.  Filters on the added
    columns are safe: they do not repeat the work.
    """
    x = F.col
    failing = (
        lambda j: punctuation_fails(j["line"], j["signs"])
        | navigation_fails(j["line"], j["signs"])
        | boilerplate_fails(j["line"])
    )
    passing = F.filter("_judged", lambda j: ~j["bad"])
    lost = F.aggregate(
        F.filter("_judged", lambda j: j["bad"]),
        F.lit(0),
        lambda n, j: n + _word_chars(j["line"]),
    )
    judged = (
        base_counts(docs, text)
        .withColumn(
            "_signed",
            F.transform("_lines", lambda line: F.struct(line.alias("line"), signs_of(line).alias("signs"))),
        )
        .withColumn(
            "_judged",
            F.transform("_signed", lambda j: F.struct(j["line"].alias("line"), failing(j).alias("bad"))),
        )
        .withColumn("_passing", F.transform(passing, lambda j: j["line"]))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_failed_lines", (F.size("_lines") - F.size("_passing")).cast("long"))
        .withColumn("clean_text", F.array_join("_passing", "\n"))
        .withColumn("lost_chars", lost.cast("long"))
        .withColumn("kept", ~x("base_failed") & (x("lost_chars") <= F.lit(max_loss) * x("word_chars")))
        .drop("_text", "_lines", "_signed", "_judged", "_passing")
    )
    return settled(judged, *ADDED)
