"""Token columns and postings of the lexical index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelore import constants as C
from changelore.functions import text as X

_WORD = r"[\p{L}\p{N}_]+"
_QUERY_WORD = r"[a-z0-9_]{2,}"


def _without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*C.STOP_WORDS))


# Inflections, longest first within a step: (suffix, what replaces it, letters that must stand before it).
_PLURALS = (("sses", "ss", 1), ("shes", "sh", 1), ("ches", "ch", 1), ("ies", "y", 2), ("xes", "x", 2), ("ss", "ss", 1), ("us", "us", 1), ("is", "is", 1), ("s", "", 3))
_TENSES = (("eed", "ee", 2), ("ied", "y", 2), ("ing", "", 3), ("ed", "", 3))
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _first_rule(word: Column, rules: tuple[tuple[str, str, int], ...], vowel: bool = False) -> Column:
    """The word by the first rule whose suffix it ends with; a rule that does not fit leaves it as it is."""
    out = word
    for suffix, put, least in reversed(rules):
        stem = F.left(word, F.char_length(word) - len(suffix))
        fits = F.char_length(word) >= least + len(suffix)
        if vowel and not put:
            fits = fits & stem.rlike("[aeiouy]")
        out = F.when(F.endswith(word, F.lit(suffix)), F.when(fits, F.concat(stem, F.lit(put))).otherwise(word)).otherwise(out)
    return out


def stems(words: Column) -> Column:
    """Words without English inflection: plural, then -ed and -ing, a doubled consonant, a last e.

    `updates`, `updated`, `updating` and `update` become one; so do `stopped` and `stops`.  Every step looks
    at the end of a word only, so words of other scripts stay as they are.  A step is an array of its own:
    its expression stands once, however often the next one needs a word.
    """
    size = F.char_length
    plural = F.transform(words, lambda w: _first_rule(w, _PLURALS))
    past = F.transform(plural, lambda w: F.struct(w.alias("before"), _first_rule(w, _TENSES, vowel=True).alias("w")))
    single = F.transform(
        past,
        lambda s: F.when(
            (size(s["w"]) < size(s["before"])) & F.right(s["w"], F.lit(2)).isin(*_DOUBLES), F.left(s["w"], size(s["w"]) - 1)
        ).otherwise(s["w"]),
    )
    return F.transform(single, lambda w: F.when(F.endswith(w, F.lit("e")) & (size(w) > 3), F.left(w, size(w) - 1)).otherwise(w))


def tokens(value: Column | str, stemmed: bool = False) -> Column:
    """Lower-case words in text order, English stop words removed, on request without inflection."""
    words = _without_stop_words(F.regexp_extract_all(F.lower(X.col(value)), F.lit(_WORD), F.lit(0)))
    return stems(words) if stemmed else words


def query_tokens(question: Column | str, stemmed: bool = False) -> Column:
    """Distinct question words of two or more plain characters; any word when there are none."""
    lowered = F.lower(X.col(question))
    plain = F.regexp_extract_all(lowered, F.lit(_QUERY_WORD), F.lit(0))
    found = F.when(F.size(plain) > 0, plain).otherwise(
        F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))
    )
    words = _without_stop_words(found)
    return F.array_distinct(stems(words) if stemmed else words)


def with_tokens(chunks: DataFrame, stemmed: bool = False) -> DataFrame:
    """Fill `tokens` from title and body where it is NULL, keep it otherwise."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "body")
    return chunks.withColumn("tokens", F.coalesce("tokens", tokens(text, stemmed)))
