"""How far the sources of a language stand apart in their use of terms, and by which terms each stands out.

1. Tokens: one `bytes.translate` lowers the letters and blanks every separator, `bytes.split` cuts, and a
   `Counter` per document gives its terms.  A task adds the documents of each (lang, source) up and hands
   out one row per term, so a source that holds a third of all rows is a few rows per task.
2. The terms of a language that enough of its documents hold are kept.  A group's share of a term is
   smoothed by one occurrence and scaled to `SCALE`: p = 1 + floor(SCALE (count + 1) / (N + V)).
3. The divergence of p from q sums floor((p - q)^2 / q) over all kept terms.  Most counts are zero, so only
   the others are touched: terms that one of two groups holds come from the histogram of its counts, terms
   that both hold from a join on the term, all others are one constant.

All numbers are integers; products that may pass 64 bits are decimals.  Tables whose size follows the
number of groups are broadcast only when counted small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelore.runtime import checkpointed, checkpointed_count, small

SCALE = 1_000_000_000
#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 3
#: Distinguishing terms reported of each group.
TOP_TERMS = 200
#: Terms a task holds before it hands its sums out.
HELD_TERMS = 400_000

_SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Letters A-Z to a-z, separators to blanks; the bytes of all other characters stay.
TABLE = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters of a UTF-8 text, A-Z lowered."""
    return text.translate(TABLE).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial sums of occurrences and documents, some rows per task and term.

    Each group also has rows with a NULL term that count its documents.  NULL lang, source and text are ''.
    """
    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))],
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
    )
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter, list[int]]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, held, n_docs) in found.items():
                n = len(counts) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), n),
                        pa.repeat(pa.scalar(source, pa.string()), n),
                        pa.array([None, *counts], pa.binary()).cast(pa.string()),
                        pa.array([0, *counts.values()], pa.int64()),
                        pa.array([n_docs[0], *[held[t] for t in counts]], pa.int64()),
                    ],
                    names=names,
                )
            found.clear()

        size = 0
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for group, value in zip(groups, batch.column(2), strict=True):
                counts, held, n_docs = found.setdefault(group, (Counter(), Counter(), [0]))
                size -= len(counts)
                mine = Counter(terms_of(value.as_py()))
                counts.update(mine)
                held.update(mine.keys())
                n_docs[0] += 1
                size += len(counts)
                if size > HELD_TERMS:
                    yield from handed()
                    size = 0
        yield from handed()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: Column | str, occurrences: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE (count + 1) / (occurrences + terms)), exact; NULL without occurrences and terms."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    wide = lambda c: c.cast("decimal(20,0)")
    whole = wide(as_column(occurrences)) + wide(as_column(terms))
    product = F.lit(SCALE).cast("decimal(10,0)") * wide(as_column(count) + 1)
    return F.when(whole > 0, F.call_function("div", product, whole) + 1)


def excess(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits 64 bits."""
    p, q = [(F.col(c) if isinstance(c, str) else c).cast("long") for c in (p, q)]
    return F.call_function("div", (p - q) * (p - q), q)


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, n_lang, lead): counts of kept terms, and a NULL term for every group.

    `n_lang` is the count in the whole language, `lead` marks one row of each term of a language.  One
    exchange by (lang, term) serves the sums and the windows; a term has a row per source there.
    """
    of_term = W.partitionBy("lang", "term")
    return (
        term_counts(docs)
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("n_lang", F.sum("n").over(of_term))
        .withColumn("_docs", F.sum("docs").over(of_term))
        .withColumn("lead", F.min("source").over(of_term) == F.col("source"))
        .where(F.col("term").isNull() | (F.col("_docs") >= least))
        .select("lang", "source", "term", "n", "n_lang", "lead")
    )


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every occurring (lang, source) group.

    Part `pair`: item is each other source of the language, value the divergence of the group's shares from
    that source's over all kept terms, every rank.  Part `term`: item is a kept term of the group whose share
    is above that of the whole language, value its part of the divergence from it, the first `top` ranks.
    Ranks start at 1, value descending, then item in the order of UTF-8.  NULL lang, source and text are '';
    repeated rows are documents of their own; groups without terms, or languages without kept terms, have
    pairs of value 0 or from the smoothing alone.  Other columns are not looked at.  An empty table gives no
    rows.
    """
    kept = checkpointed(kept_counts(docs, least))
    is_term = F.col("term").isNotNull()
    per_group = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("occurrences"),
        F.count("term").alias("held"),
        F.count_if(is_term & F.col("lead")).alias("_lead"),
    )
    of_lang = W.partitionBy("lang")
    groups, n_groups = checkpointed_count(
        per_group.withColumn("terms", F.sum("_lead").over(of_lang))
        .withColumn("all_occurrences", F.sum("occurrences").over(of_lang))
        .withColumn("p0", share(F.lit(0), "occurrences", "terms"))
        .drop("_lead"),
        F.lit(True),
    )
    groups = small(groups, n_groups)
    mine = kept.where(is_term).join(groups, ["lang", "source"])
    shares = mine.select(
        "lang", "source", "term", share("n", "occurrences", "terms").alias("p"), "p0", "n_lang", "terms", "all_occurrences"
    )

    ranked = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = lambda rows, part: rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(ranked).alias("rank")
    )
    whole = share("n_lang", "all_occurrences", "terms")
    standing_out = (
        shares.withColumn("q", whole)
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), excess("p", "q").alias("value"))
    )
    terms = out(standing_out, "term").where(F.col("rank") <= top)
    pairs = out(_pair_values(kept.where(is_term), shares, groups), "pair")
    return pairs.unionByName(terms)


def _pair_values(counts: DataFrame, shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    other = groups.select(
        "lang", F.col("source").alias("item"), F.col("held").alias("held_2"), F.col("p0").alias("q0")
    )
    both = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    neither = F.col("terms") - F.col("held") - F.col("held_2")
    constant = both.select("lang", "source", "item", F.coalesce(neither * excess("p0", "q0"), F.lit(0)).alias("value"))

    # terms of one side against the smoothing of the other, once for each count that occurs
    histogram = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    faced = (
        histogram.join(groups.select("lang", "source", "occurrences", "terms"), ["lang", "source"])
        .select("lang", "source", "m", share("n", "occurrences", "terms").alias("p"))
        .join(other, "lang")
        .where(F.col("source") != F.col("item"))
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.col("m") * excess("p", "q0")).alias("there"), F.sum(F.col("m") * excess("q0", "p")).alias("back"))
    )

    # terms of both sides: their own part in place of the two above
    left = shares.select("lang", "term", "source", "p", "p0")
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = left.join(right, ["lang", "term"]).where(F.col("source") < F.col("item"))
    part = lambda p, p0, q, q0: excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)
    met = shared.groupBy("lang", "source", "item").agg(
        F.sum(part("p", "p0", "q", "q0")).alias("there"), F.sum(part("q", "q0", "p", "p0")).alias("back")
    )
    sums = constant
    for rows in (faced, met):
        sums = sums.unionByName(rows.select("lang", "source", "item", F.col("there").alias("value"))).unionByName(
            rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
        )
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
