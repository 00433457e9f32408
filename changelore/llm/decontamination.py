"""Benchmark passages in documents: a set join on necessary prefix tokens, verified over item-sized windows.

A window of a benchmark item is `WINDOW` neighbouring words, or the whole item when it is shorter.  Its set
is that of its shingles of `SHINGLE` words, with their offsets.

1. The document frequency of every item shingle is counted over all documents; a window orders its shingles
   by rarity.  Exact containment needs all of them, so the necessary prefix is the rarest one.
2. Documents report the positions of prefix tokens, with the words around them that a window can reach.  A
   bit table of the tokens' hashes keeps all other positions in the scan; it has a fixed largest size, and
   what it lets through in excess is dropped by the join.
3. Positions meet windows on the token.  A window must begin inside the document (positional bound) and end
   there (length bound), and its words must stand there, one by one.

Texts of documents are never shuffled.  Equal windows of items are one row; hits are joined back by two
hashes of the text, so copies are found once however many documents share a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore.llm.shingles import runs
from changelore.runtime import checkpointed, checkpointed_count, small

WINDOW = 10
SHINGLE = 3
#: Bits of the table for each token, and the least and largest table (2 MB and 128 MB).
BITS_PER_TOKEN, LEAST_BITS, MOST_BITS = 64, 1 << 24, 1 << 30
#: Words with known hashes that a task keeps, shingle counts it holds, and rows of one batch it hands out.
WORDS_KEPT, COUNTS_HELD, BATCH_ROWS = 300_000, 500_000, 10_000
_BUCKET = 8 * 4096  # bits of one bitmap

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Letters A-Z to a-z, separators to blanks; digits and the bytes of non-ASCII characters stay.
TABLE = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters of a UTF-8 text, A-Z lowered."""
    return text.translate(TABLE).split()


class _Hashes:
    """64-bit hashes of words; a bounded table spares recurring words the hashing."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            for k, h in enumerate(out):
                if h is None:
                    word = words[k]
                    out[k] = h = xxhash.xxh3_64_intdigest(word)
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    if len(word) < 100:
                        known[word] = h
        return np.array(out, dtype=np.uint64)


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    return runs(hashes, width, 40 + width).view(np.int64)


def _binary(df: DataFrame, text: str):
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def item_windows(items: DataFrame, key: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item, words, tokens): every window of every item, its words and its shingle hashes by offset."""
    rows = items.select(F.col(key).cast("string").alias("item"), _binary(items, text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(value.as_py())
                if not words:
                    continue
                n = min(window, len(words))
                tokens = _shingles(known(words), min(shingle, n))
                for at in range(len(words) - n + 1):
                    out[0].append(item)
                    out[1].append(b" ".join(words[at : at + n]))
                    out[2].append(tokens[at : at + n - min(shingle, n) + 1])
                    if len(out[0]) >= BATCH_ROWS:
                        yield _batch(out)
                        out = ([], [], [])
            if out[0]:
                yield _batch(out)

    def _batch(out: tuple[list, list, list]) -> pa.RecordBatch:
        columns = [
            pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()).cast(pa.string()), pa.array(out[2], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["item", "words", "tokens"])

    return rows.mapInArrow(cut, "item string, words string, tokens array<long>")


def bit_table(tokens: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of the hashes in column `h`, and their number, a power of two between fixed bounds.

    Tasks build the bitmaps; at most `MOST_BITS` bits reach the driver, whatever the number of tokens.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n * BITS_PER_TOKEN - 1).bit_length()))
    place = F.pmod(F.col("h"), F.lit(bits)).alias("place")
    made = tokens.select(place).groupBy(F.floor(F.col("place") / _BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("place") % _BUCKET).cast("long")).alias("bits")
    )
    table = np.zeros(bits // 8, np.uint8)
    for row in made.toLocalIterator():
        table[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def _member(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    place = h & np.int64(bits - 1)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _widths(windows: DataFrame, shingle: int) -> list[int]:
    """Shingle widths in use: below `shingle` only for items of fewer words."""
    width = F.least(F.size(F.split("words", " ")), F.lit(shingle)).alias("w")
    return sorted(r["w"] for r in windows.select(width).distinct().collect())


def _counted(docs: DataFrame, widths: list[int], table: np.ndarray, bits: int) -> DataFrame:
    """(h, c): partial numbers of documents that hold a shingle of the table."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Hashes(), Counter()
        for batch in batches:
            for value in batch.column(0):
                hashes = known(words_of(value.as_py()))
                for width in widths:
                    h = _shingles(hashes, width)
                    seen.update(np.unique(h[_member(h, sent.value, bits)]).tolist())
            if len(seen) > COUNTS_HELD:
                yield _counts(seen)
                seen.clear()
        yield _counts(seen)

    def _counts(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["h", "c"]
        )

    return docs.select("text").mapInArrow(count, "h long, c long")


def _positions(docs: DataFrame, key_type: str, widths: list[int], reach: int, table: np.ndarray, bits: int) -> DataFrame:
    """A row per document (id, k1, k2, n_words, many) and one per position of a token of the table.

    The latter have the token `h`, its word position, the number of words shown on its left, and the words
    from `reach` words before it to `reach` behind its start.  `many` is the number of these rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)
    schema = f"id {key_type}, k1 long, k2 long, n_words long, many long, h long, at long, before int, around string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)]
        columns[-1] = pa.array(columns[-1], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)],
            schema=arrow,
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = _Hashes(), []
        for batch in batches:
            for key, k1, k2, value in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                words = words_of(value)
                hashes, many = known(words), 0
                for width in widths:
                    h = _shingles(hashes, width)
                    at = np.flatnonzero(_member(h, sent.value, bits))
                    many += len(at)
                    for p, token in zip(at.tolist(), h[at].tolist(), strict=True):
                        low = max(0, p - reach)
                        out.append((None, k1, k2, None, None, token, p, p - low, b" ".join(words[low : p + reach])))
                        if len(out) >= BATCH_ROWS:
                            yield batch_of(out)
                            out = []
                out.append((key, k1, k2, len(words), many, None, None, None, None))
            if out:
                yield batch_of(out)
                out = []

    return docs.select("id", "k1", "k2", "text").mapInArrow(find, schema)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items and items.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.  A word is hit when an
    occurrence of an item's window covers it; `items` are the ids of the items with occurring windows, as
    sorted strings, each once.  NULL, empty and blank texts have no words and no hits; such items have no
    windows.  An item without an id hits words, but is neither counted nor listed; rows of equal ids are one
    item with the windows of all.  Documents may repeat, have any key and be of any length; other columns
    are not looked at.  Empty tables on either side give no hits.
    """
    windows = checkpointed(item_windows(items, item_key, item_text, window, shingle))
    units = windows.groupBy("words").agg(F.min("tokens").alias("tokens"))
    units, n_units = checkpointed_count(units.withColumn("unit", F.monotonically_increasing_id()), F.lit(True))
    widths = _widths(units, shingle)
    rows = docs.select(F.col(key).alias("id"), _binary(docs, text).alias("text"))

    # rarity over all documents, then the rarest shingle of each window
    every = units.select("unit", F.posexplode("tokens").alias("offset", "h"))
    distinct = every.select("h").distinct()
    table, bits = bit_table(distinct, n_units * window)
    often = _counted(rows, widths, table, bits).groupBy("h").agg(F.sum("c").alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("rarest")
    prefix = every.join(often, "h", "left").groupBy("unit").agg(rarest)
    joined = units.drop("tokens").join(prefix, "unit")
    wanted = checkpointed(joined.select("unit", "words", F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset")))
    wanted = small(wanted.withColumn("n", F.size(F.split("words", " "))), n_units)

    # positions of prefix tokens meet the windows they may belong to
    table, bits = bit_table(wanted.select("h"), n_units)
    keyed = rows.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    key_type = docs.schema[key].dataType.simpleString()
    found = checkpointed(_positions(keyed, key_type, widths, window, table, bits))
    told = found.where(F.col("n_words").isNotNull()).select("id", "k1", "k2", "n_words", "many")
    begin = F.col("at") - F.col("offset")
    there = F.slice(F.split("around", " "), F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, F.col("n"))
    met = (
        found.where(F.col("h").isNotNull())
        .select("k1", "k2", "h", "at", "before", "around")
        .join(wanted, "h")
        .where((begin >= 0) & (F.col("before") >= F.col("offset")))
        .where(F.array_join(there, " ") == F.col("words"))
        .select("k1", "k2", begin.cast("int").alias("begin"), (begin + F.col("n")).cast("int").alias("end"), "unit")
        .distinct()
    )
    met, n_met = checkpointed_count(met, F.lit(True))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("begin", "end"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["begin"], acc["upto"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], acc["upto"]).alias("upto"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    hit = met.groupBy("k1", "k2").agg(covered.alias("n_hit"))
    owners = windows.where(F.col("item").isNotNull()).select("words", "item").join(units.select("words", "unit"), "words")
    listed = (
        met.select("k1", "k2", "unit")
        .distinct()
        .join(owners.select("unit", "item").distinct(), "unit")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    hits = small(hit.join(listed, ["k1", "k2"], "left"), n_met)
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<string>")
    clean = told.where("many = 0").select("id", "n_words", zero.alias("n_hit"), zero.alias("n_items"), none.alias("items"))
    items_ = F.coalesce("items", none)
    judged = told.where("many > 0").join(hits, ["k1", "k2"], "left").select(
        "id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items")
    )
    return clean.unionByName(judged).withColumnRenamed("id", key)
