"""Passages that recur across documents: confirmed by hash, located by sharded Aho-Corasick automata, removed.

A window is `WINDOW` neighbouring words.  Documents are dealt into blocks of a few MB by a hash of their
key.  Three steps over the blocks:

1. Every window has an anchor, the smallest hash of its five-word runs.  Blocks report their distinct
   anchors (about one in five words); anchors seen in two documents are kept.
2. Blocks report hashes of the windows whose anchor is kept; windows seen in two documents are confirmed
   phrases, with the smallest document that holds them.
3. Each block compiles the confirmed phrases it may lose into automata over words, a bounded number of
   phrases each, and streams all its documents through them; every occurrence in a later document marks
   its words.

Documents whose whole text is that of an earlier one take no part: all their windows are that document's,
so all their words go.  Blocks report a phrase once, however many of their documents hold it, so a passage that a third of all
documents share is one row per block, and no task gathers its documents.  All steps share one exchange of
the texts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelore.llm.shingles import ByteHashes, byte_words, member, runs, window_min
from changelore.runtime import checkpointed

WINDOW = 13
RUN = 5
BLOCK_CHARS = 2_000_000
#: Phrases of one automaton; blocks with more compile several.
SHARD_PHRASES = 20_000


def _anchors_of(hashes: np.ndarray, window: int) -> np.ndarray:
    return window_min(runs(hashes, RUN, 3), window - RUN + 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _second(x: np.ndarray) -> np.ndarray:
    """32 further bits; with the first hash a window has 96."""
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _bounds(keys: list[tuple[np.ndarray, ...]], ids: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys (columns of equal length) with the smallest and largest id each occurs under.

    Rows come in the order of their smallest id: neighbours are alike and compress in a shuffle.
    """
    sizes = [len(k[0]) for k in keys]
    columns = [np.concatenate([k[c] for k in keys]) for c in range(len(keys[0]))]
    owner = np.repeat(np.array(ids, dtype=np.int64), sizes)
    order = np.lexsort((owner, *columns))
    columns, owner = [c[order] for c in columns], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1
    back = np.argsort(owner[at], kind="stable")
    return [c[at][back] for c in columns], owner[at][back], owner[last][back]


def _copies(told: pd.DataFrame) -> set[tuple[int, int]]:
    """(id, text hash) of the block's copies of earlier documents."""
    rows = told[told["copy"].notna()]
    return set(zip(rows["copy"].astype(np.int64).tolist(), rows["h"].astype(np.int64).tolist(), strict=True))


class Shard:
    """One automaton over word numbers; phrases that start in it carry their first document."""

    def __init__(self, phrases: dict[tuple[int, ...], int]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words, first in phrases.items():
            self.automaton.add_word(words, first)
        self.automaton.make_automaton()

    def occurrences(self, words: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        return self.automaton.iter(words)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept_sha256 and, with `keep_text`, kept_text.

    A word is removed when a window that covers it also starts in a document of a smaller key.  Windows
    are judged on the input.  kept_text holds the other words joined by one blank.  NULL and short texts
    lose nothing; rows of equal key count as one document and do not erase each other; a NULL key is
    never smaller and loses nothing.  Keys are integers.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = int(chars // BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.lit(-1))), F.lit(n_blocks)).cast("int")
    text_ = F.coalesce("text", F.lit(""))
    blocked = rows.withColumn("block", block).withColumn("k", F.xxhash64(text_))
    slim = checkpointed(
        blocked.where(F.col("id").isNotNull()).select("id", "block", "k", F.xxhash64(F.lit(1), text_).alias("k2"))
    )
    first_of = slim.groupBy("k", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    copies = slim.join(first_of, ["k", "k2"]).where(F.col("id") > F.col("lo"))
    copies = checkpointed(copies.select("block", F.col("k").alias("h"), F.col("id").alias("copy")))
    by_block = blocked.groupBy("block")

    def anchors(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        known, keys, ids, copied = ByteHashes(), [], [], _copies(told)
        for i, k, t in zip(frame["id"], frame["k"], frame["text"], strict=True):
            if pd.isna(i) or (int(i), int(k)) in copied:
                continue
            found = np.unique(_anchors_of(known(byte_words(t)), window))
            if len(found):
                keys.append((found,))
                ids.append(int(i))
        if not keys:
            return pd.DataFrame({"h": [], "block": [], "lo": [], "more": []})
        (h,), lo, hi = _bounds(keys, ids)
        return pd.DataFrame({"h": _signed(h), "block": frame["block"].iloc[0], "lo": lo, "more": hi - lo})

    reported = by_block.cogroup(copies.groupBy("block")).applyInPandas(anchors, "h long, block int, lo long, more long")
    every = W.partitionBy("h")  # a row per block at most
    flagged = (
        reported.withColumn("first", F.min("lo").over(every))
        .withColumn("last", F.max(F.col("lo") + F.col("more")).over(every))
        .where(F.col("first") < F.col("last"))
        .select("block", "h", F.lit(None).cast("long").alias("copy"))
        .unionByName(copies)
    )

    def windows(frame: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "block": [], "lo": [], "more": []})
        if not len(frame) or not len(kept):
            return empty
        wanted = np.unique(kept.loc[kept["copy"].isna(), "h"].to_numpy(np.int64))
        known, keys, ids, copied = ByteHashes(), [], [], _copies(kept)
        for i, k, t in zip(frame["id"], frame["k"], frame["text"], strict=True):
            if pd.isna(i) or (int(i), int(k)) in copied:
                continue
            hashes = known(byte_words(t))
            at = np.flatnonzero(member(_signed(_anchors_of(hashes, window)), wanted))
            if len(at):
                keys.append((_signed(runs(hashes, window, 5))[at], _second(runs(hashes, window, 7))[at]))
                ids.append(int(i))
        if not keys:
            return empty
        (a, b), lo, hi = _bounds(keys, ids)
        return pd.DataFrame({"a": a, "b": b, "block": frame["block"].iloc[0], "lo": lo, "more": hi - lo})

    seen = by_block.cogroup(flagged.groupBy("block")).applyInPandas(
        windows, "a long, b int, block int, lo long, more long"
    )
    same = W.partitionBy("a", "b")
    confirmed = (
        seen.withColumn("first", F.min("lo").over(same))
        .where(F.col("first") < F.col("lo") + F.col("more"))
        .select("block", F.col("a").alias("h"), "b", "first", F.lit(None).cast("long").alias("copy"))
    )
    unset = F.lit(None)
    confirmed = confirmed.unionByName(copies.select("block", "h", unset.cast("int").alias("b"), unset.cast("long").alias("first"), "copy"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def locate(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        known, numbers, copied = ByteHashes(), {}, _copies(told)
        phrases = told[told["copy"].isna()]
        a = phrases["h"].to_numpy(np.int64)
        order = np.argsort(a, kind="stable")
        a, b = a[order], phrases["b"].to_numpy(np.int64).astype(np.int32)[order]
        first = phrases["first"].to_numpy(np.int64)[order]
        texts, shards, batch, taken = [], [], {}, np.zeros(len(a), bool)
        whole = [not pd.isna(i) and (int(i), int(k)) in copied for i, k in zip(frame["id"], frame["k"], strict=True)]
        for t, copy in zip(frame["text"], whole, strict=True):
            words = byte_words(t)
            spans: list[tuple[int, tuple[int, ...]]] = []
            if len(a) and len(words) >= window and not copy:
                hashes = known(words)
                wa, wb = _signed(runs(hashes, window, 5)), _second(runs(hashes, window, 7))
                low = np.minimum(np.searchsorted(a, wa), len(a) - 1)
                at = np.flatnonzero(a[low] == wa)
                # a word outside all windows with a phrase hash is in no phrase: only runs of such windows are streamed
                cut = np.flatnonzero(np.diff(at) >= window)
                begins, lasts = np.concatenate([at[:1], at[cut + 1]]), np.concatenate([at[cut], at[-1:]])
                for start, last in zip(begins.tolist(), lasts.tolist(), strict=True):
                    spans.append((start, tuple([numbers.setdefault(w, len(numbers)) for w in words[start : last + window]])))
                at = at[~taken[low[at]] | (b[low[at]] != wb[at])]
                for place, span in zip(at.tolist(), (np.searchsorted(begins, at, "right") - 1).tolist(), strict=True):
                    start, ids = spans[span]
                    k = int(low[place])
                    while k < len(a) and a[k] == wa[place] and b[k] != wb[place]:
                        k += 1
                    if k < len(a) and a[k] == wa[place] and not taken[k]:
                        taken[k] = True
                        batch[ids[place - start : place - start + window]] = int(first[k])
                        if len(batch) >= SHARD_PHRASES:
                            shards.append(batch)
                            batch = {}
            texts.append((words, spans))
        covers = [np.zeros(len(words) + 1, np.int32) for words, _ in texts]
        keys = [None if pd.isna(i) else int(i) for i in frame["id"]]
        for phrases_ in [*shards, batch]:
            if not phrases_:
                continue
            shard = Shard(phrases_)
            for (_, spans), cover, i in zip(texts, covers, keys, strict=True):
                if i is None:
                    continue
                for start, ids in spans:
                    ends = [end for end, smallest in shard.occurrences(ids) if smallest < i]
                    if ends:
                        at = np.array(ends) + start
                        cover[at - window + 1] += 1
                        cover[at + 1] -= 1
        out = []
        for (words, _), cover, i, copy in zip(texts, covers, keys, whole, strict=True):
            gone = np.cumsum(cover[:-1]) > 0 if not copy else np.full(len(words), len(words) >= window)
            kept = b" ".join(itertools.compress(words, (~gone).tolist()) if gone.any() else words)
            digest = hashlib.sha256(kept).hexdigest()
            out.append((i, len(words), int(gone.sum()), digest, *([kept.decode("utf-8", "surrogatepass")] if keep_text else [])))
        names = ["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])]
        found = pd.DataFrame(out, columns=names)
        return found.assign(id=found["id"].astype("Int64"))

    located = by_block.cogroup(confirmed.groupBy("block")).applyInPandas(locate, schema)
    return located.withColumnRenamed("id", key)
