"""Jaccard join of documents on word shingles with adaptive multi-match prefixes, and its groups.

Two sets with Jaccard at least t share at least l tokens among the first `n - ceil(t n) + l` of either, in
any common order of tokens: the l-prefix.  A longer prefix costs more lookups and demands more matches.

1. Equal texts become one row, their smallest document.
2. A first l-prefix in hash order drops documents that cannot have a partner: fewer than l of its tokens
   occur in another set.  Documents are dealt into blocks; a block reports a token once, so a frequent
   shingle is one row per block.
3. The others order their tokens by true document frequency, rarest first, and each chooses its l by the
   estimated cost of its lists.  A pair must share min(l, l') tokens of these prefixes to be verified.
   Sketches of whole sets bound what they differ by, so a pair that only shares frequent tokens ends inside
   the join that finds it.
4. In a few rounds, documents that share a minimum hash, then those that share a token of their prefixes,
   are compared with one leader only, one document of each component; what that links is contracted, and
   lists held by one component make no pairs.  All other candidates are verified, so no link between
   components is lost and groups of near copies never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelore.llm.components import components, filled
from changelore.llm.shingles import ByteHashes, member, runs
from changelore.runtime import BROADCAST_ROWS, checkpointed, checkpointed_count, small

SHINGLE = 5
#: Similarity in percent.
SIMILAR = 80
BLOCK_CHARS = 2_000_000
#: Further tokens and matches of the first filter, in percent of the set.
FIRST_EXTRA = 10
#: Choices of l, in percent of the set (1 match at least).
EXTRA_CHOICES = (0, 2, 5, 10, 15)
#: Cost of verifying one pair, in list entries read; sketches turn most of them down inside the join.
VERIFY_COST = 1
#: Minimum hashes of a set that each round of comparing components with leaders uses, more as fewer components
#: are left; no further rounds when one links nothing.
TURN_KEYS = (1, 2, 5)
#: Further rounds that compare components which share a token of a chosen prefix.
PREFIX_TURNS = 4
#: Tokens that are multiplied at once for the minimum hashes.
MIN_TOKENS = 16_384
#: Rows that a document is dealt out to where others are compared with it.
SALTS = 8
#: Columns of a set's sketch, 64 bits each.
SKETCH = [f"b{k}" for k in range(8)]
_BITS = ", ".join(f"{c} long" for c in SKETCH)
#: An odd factor for each minimum hash: the products of well mixed tokens are orders of their own.
_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, sum(TURN_KEYS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, known: ByteHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, one without words none.

    In UTF-8 `lower` changes A-Z and nothing else, `split` cuts at ASCII white space and nothing else.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = known(words)
    if len(words) < width:
        return runs(hashes, len(words), 100 + len(words))
    return np.unique(runs(hashes, width, 9))


def _needed(n: int, percent: int = SIMILAR) -> int:
    return -(-percent * n // 100)


def sketch(tokens: np.ndarray) -> list[int]:
    """Per value of a token's last bits, whether an odd number of the set's tokens has it."""
    odd = np.bincount((tokens & 511).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def min_hashes(tokens: np.ndarray) -> list[int]:
    """The minimum hashes of a set, one for each factor."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for start in range(0, len(tokens), MIN_TOKENS):
        part = tokens[start : start + MIN_TOKENS].view(np.uint64)
        np.minimum(least, (_FACTORS[:, None] * part[None, :]).min(axis=1), out=least)
    return least.view(np.int64).tolist()


def _may_link(a: str, b: str, percent: int) -> Column:
    """False only for sets that are not similar: every bit that differs is a token that one of the two lacks."""
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    return differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def linked(a: Column, b: Column, n_a: Column, n_b: Column, percent: int = SIMILAR) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= percent * (n_a + n_b - shared)


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    Few pairs go to the sets, so only the sets of pairs are moved, once each.  A document that very many
    others are compared with is dealt out as `SALTS` rows.
    """
    pairs = pairs.select("a", "b")
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    right = sets.join(small(pairs.withColumnRenamed("b", "id"), n_pairs), "id").select(
        "a", F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb")
    )
    asked = small(pairs.select(F.col("a").alias("id")).distinct(), n_pairs)
    left = sets.join(asked, "id", "left_semi").select(
        F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"),
    )
    joined = right.select("*", salt).join(left, ["a", "salt"])
    return joined.where(linked(F.col("ta"), F.col("tb"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _first_prefix(n: int, percent: int) -> tuple[int, int]:
    """Length of the first filter's prefix and the matches it demands."""
    extra = max(1, FIRST_EXTRA * n // 100)
    return n - _needed(n, percent) + extra, extra


def _picked(blocked: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, k1, n, tokens, keys, sketch) of each class's first document; tokens only where it may have a partner."""

    def report(frame: pd.DataFrame) -> pd.DataFrame:
        known, tokens, owner = ByteHashes(), [], []
        for t, k in zip(frame["text"], frame["k1"], strict=True):
            s = shingle_set(t, known)
            if len(s):
                part = s[: _first_prefix(len(s), percent)[0]]
                tokens.append(part)
                owner.append(np.full(len(part), k))
        if not tokens:
            return pd.DataFrame({"h": [], "block": [], "sig": [], "several": []})
        h, o = np.concatenate(tokens), np.concatenate(owner)
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        new = np.append(True, h[1:] != h[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(h)) - 1
        # in the order of the sets again: neighbours compress
        back = np.argsort(order[at], kind="stable")
        return pd.DataFrame(
            {
                "h": h[at][back].view(np.int64),
                "block": frame["block"].iloc[0],
                "sig": o[at][back],
                "several": (o[at] != o[last])[back],
            }
        )

    reported = blocked.groupBy("block").applyInPandas(report, "h long, block int, sig long, several boolean")
    every = W.partitionBy("h")  # a row per block at most
    recurring = (
        reported.withColumn("lo", F.min("sig").over(every))
        .withColumn("hi", F.max("sig").over(every))
        .withColumn("any", F.max("several").over(every))
        .where(F.col("any") | (F.col("lo") < F.col("hi")))
        .select("block", F.col("h").alias("v"), F.lit(None).cast("long").alias("first"))
    )
    # the first document of a class is told to its block
    firsts = classes.select("block", F.col("k1").alias("v"), F.col("rep").alias("first"))

    def pick(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(told) and len(frame):
            values, first = told["v"].to_numpy(np.int64), told["first"].astype("Int64")
            is_token = first.isna().to_numpy()
            hot = np.unique(values[is_token])
            wanted = set(zip(first[~is_token].astype(np.int64).tolist(), values[~is_token].tolist(), strict=True))
            known = ByteHashes()
            for i, k, t in zip(frame["id"], frame["k1"], frame["text"], strict=True):
                if pd.isna(i) or (int(i), int(k)) not in wanted:
                    continue
                wanted.discard((int(i), int(k)))
                s = shingle_set(t, known)
                upto, extra = _first_prefix(len(s), percent)
                s = s.view(np.int64)
                enough = len(s) and member(s[:upto], hot).sum() >= extra
                found = (s, min_hashes(s), *sketch(s)) if enough else (None, None, *[0] * len(SKETCH))
                out.append((int(i), int(k), len(s), *found))
        return pd.DataFrame(out, columns=["id", "k1", "n", "tokens", "keys", *SKETCH])

    told = recurring.unionByName(firsts)
    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        pick, f"id long, k1 long, n int, tokens array<long>, keys array<long>, {_BITS}"
    )


def _prefixes(sets: DataFrame, n_blocks: int, percent: int) -> DataFrame:
    """(h, id, n, level, chosen, sketch): the tokens of each document's chosen prefix, rarest first."""
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        h, n = np.unique(np.concatenate(frame["tokens"].tolist()), return_counts=True)
        return pd.DataFrame({"h": h, "block": frame["block"].iloc[0], "c": n})

    counted = dealt.groupBy("block").applyInPandas(count, "h long, block int, c long")
    df = (
        counted.withColumn("df", F.sum("c").over(W.partitionBy("h"))).where(F.col("df") > 1).select("block", "h", "df")
    )

    def choose(frame: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
        rows = []
        order = np.argsort(frequent["h"].to_numpy(np.int64), kind="stable")
        h, f = frequent["h"].to_numpy(np.int64)[order], frequent["df"].to_numpy(np.int64)[order]
        for i, n, tokens, *bits in zip(*(frame[c] for c in ["id", "n", "tokens", *SKETCH]), strict=True):
            tokens = np.asarray(tokens, dtype=np.int64)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(h, tokens), len(h) - 1)
            often = np.where(h[at] == tokens, f[at], 1)
            ranked = np.lexsort((tokens, often))
            tokens, often = tokens[ranked], often[ranked]
            base = n - _needed(n, percent)
            reads = np.cumsum(often - 1)
            best = None
            for share in EXTRA_CHOICES:
                extra = min(max(1, share * n // 100), n - base)
                lists = reads[base + extra - 1]
                cost = lists + VERIFY_COST * lists / extra
                if best is None or cost < best[0]:
                    best = (cost, extra)
            upto = base + best[1]
            level = np.maximum(np.arange(upto) - base + 1, 1)
            useful = often[:upto] > 1
            if useful.sum() >= best[1]:
                rows.append(
                    pd.DataFrame(
                        {"h": tokens[:upto][useful], "id": i, "n": n, "level": level[useful], "chosen": best[1]}
                        | dict(zip(SKETCH, bits, strict=True))
                    )
                )
        return pd.concat(rows) if rows else pd.DataFrame({c: [] for c in ["h", "id", "n", "level", "chosen", *SKETCH]})

    return dealt.groupBy("block").cogroup(df.groupBy("block")).applyInPandas(
        choose, f"h long, id long, n int, level int, chosen int, {_BITS}"
    )


def _with_comp(rows: DataFrame, known: DataFrame | None, n_known: int) -> DataFrame:
    """Rows (id, ...) with `comp`, what their document has become so far."""
    if known is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(small(known, n_known), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _leader_pairs(keyed: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b) of rows (key, comp, set): per key a leader, and one document of each other component that may be similar.

    Leader and documents are drawn anew for each key and turn, so two components of a group of near copies
    that miss each other once have independent chances with others.
    """
    draw = lambda salt: F.struct(F.xxhash64("key", F.lit(2 * turn + salt), "set.id"), "set.id")
    drawn = keyed.groupBy("key", "comp").agg(
        F.min_by("set", draw(1)).alias("b"), F.min_by("set", draw(2)).alias("a"), F.min(draw(2)).alias("d")
    )
    leaders = drawn.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("comp", "a"), "d").alias("leader")
    ).where(F.col("lo") < F.col("hi"))
    return (
        drawn.drop("a").join(leaders, "key")
        .where((F.col("comp") != F.col("leader.comp")) & _may_link("leader.a", "b", percent))
        .select(F.col("leader.a.id").alias("a"), F.col("b.id").alias("b"))
        .distinct()
    )


def _linked_more(
    keyed: DataFrame, n_rows: int, sets: DataFrame, known: DataFrame | None, seen: int, turn: int, percent: int
) -> tuple[DataFrame | None, int, bool]:
    """The components and their number of ids after one turn, and whether it linked any."""
    pairs, n = checkpointed_count(filled(_leader_pairs(keyed, turn, percent), max(n_rows, seen)), F.lit(True))
    if n == 0:
        return known, seen, False
    found, n = checkpointed_count(filled(_verified(pairs, n, sets, percent), n), F.lit(True))
    if n == 0:
        return known, seen, False
    # what was linked before hangs on its smallest document: few steps are left
    links = found if known is None else _star(known).unionByName(found)
    return *checkpointed_count(components(links), F.lit(True)), True


def _star(known: DataFrame) -> DataFrame:
    return known.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _contracted(sets: DataFrame, n_sets: int, percent: int) -> tuple[DataFrame | None, int]:
    """The components (id, component) that links to leaders of equal minimum hashes make, and their number of ids."""
    known, seen = None, 0
    for turn, width in enumerate(TURN_KEYS):
        keys = F.slice("keys", sum(TURN_KEYS[:turn]) + 1, width)
        keyed = sets.select("id", F.struct("id", "n", *SKETCH).alias("set"), F.explode(keys).alias("key"))
        known, seen, more = _linked_more(_with_comp(keyed, known, seen), n_sets, sets, known, seen, turn, percent)
        if not more:
            break
    return known, seen


def _mixed(prefixes: DataFrame, known: DataFrame | None, n_known: int) -> DataFrame:
    """The tokens of prefixes that several components hold, with the component of each row."""
    token = W.partitionBy("h")
    return (
        _with_comp(prefixes, known, n_known)
        .withColumn("lo", F.min("comp").over(token))
        .withColumn("hi", F.max("comp").over(token))
        .where(F.col("lo") < F.col("hi"))
        .drop("lo", "hi")
    )


def _cross_pairs(prefixes: DataFrame, known: DataFrame | None, percent: int, n_known: int = BROADCAST_ROWS + 1) -> DataFrame:
    """Candidate pairs of different components that share enough prefix tokens."""
    rows = _mixed(prefixes, known, n_known)
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(
        b,
        (F.col("a.h") == F.col("b.h"))
        & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.comp") != F.col("b.comp"))
        & (F.col("a.n") * 100 >= F.col("b.n") * percent)
        & (F.col("b.n") * 100 >= F.col("a.n") * percent)
        & _may_link("a", "b", percent),
    ).select(
        F.col("a.id").alias("a"),
        F.col("b.id").alias("b"),
        F.least("a.chosen", "b.chosen").alias("least"),
        F.greatest("a.level", "b.level").alias("level"),
    )
    shared = both.where(F.col("level") <= F.col("least")).groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("c"))
    return shared.where(F.col("c") >= F.col("least")).select("a", "b")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = SIMILAR) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs.

    component_id is the smallest key reachable by links of Jaccard `percent` or more between sets of
    distinct five-word shingles (A-Z lowered; texts with fewer words are one shingle).  NULL, empty and
    blank texts have no shingles and link with nothing.  Rows of equal key are told apart by nothing else:
    each gets the component of that key's smallest link.  A NULL key is its own row and links with nothing.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = int(chars // BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1))), F.lit(n_blocks)).cast("int")
    # two hashes of the text name its class of exact copies
    text_ = F.coalesce("text", F.lit(""))
    blocked = rows.withColumn("block", block).withColumn("k1", F.xxhash64(text_))
    slim = checkpointed(blocked.select("id", "block", "k1", F.xxhash64(F.lit(1), text_).alias("k2")))
    keyed = slim.where(F.col("id").isNotNull())
    rep = keyed.groupBy("k1", "k2").agg(F.min(F.struct("id", "block")).alias("r"))
    classes = rep.select("k1", "k2", F.col("r.id").alias("rep"), F.col("r.block").alias("block"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = ByteHashes()
        for frame in frames:
            yield pd.DataFrame({"n_shingles": [len(shingle_set(t, words)) for t in frame["text"]]})

    picked, n_sets = checkpointed_count(_picked(blocked, classes, percent), F.col("tokens").isNotNull())
    sets = picked.where(F.col("tokens").isNotNull()).select("id", "n", "tokens", "keys", *SKETCH)
    known, seen = _contracted(sets, n_sets, percent)
    prefixes, n_rows = checkpointed_count(_mixed(_prefixes(sets, max(1, n_blocks // 4), percent), known, seen).drop("comp"), F.lit(True))
    for turn in range(PREFIX_TURNS):
        listed = prefixes.select("id", F.struct("id", "n", *SKETCH).alias("set"), F.col("h").alias("key"))
        known, seen, more = _linked_more(_with_comp(listed, known, seen), n_rows, sets, known, seen, turn, percent)
        if not more:
            break
        prefixes, n_rows = checkpointed_count(_mixed(prefixes, known, seen).drop("comp"), F.lit(True))
    pairs, n_pairs = checkpointed_count(_cross_pairs(prefixes, known, percent, seen), F.lit(True))
    cross = checkpointed(_verified(pairs, n_pairs, sets, percent))
    # copies hang on their class, classes on their component; a key with several texts ties their classes
    sized = classes.join(picked.select(F.col("id").alias("rep"), "k1", "n"), ["rep", "k1"])
    member = keyed.join(sized.select("k1", "k2", "rep", "n"), ["k1", "k2"])
    full = member.where(F.col("n") > 0)
    several = full.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where(F.col("a") < F.col("b"))
    tied = full.join(several.select("id"), "id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    cross = cross if known is None else _star(known).unionByName(cross)
    final = components(cross.unionByName(tied.where(F.col("a") != F.col("b"))))
    lowest = (
        full.groupBy("id")
        .agg(F.min("rep").alias("rep"))
        .join(final.withColumnRenamed("id", "rep"), "rep", "left")
        .select("id", F.coalesce("component", "rep").alias("component_id"))
    )
    told = member.select("id", F.col("n").cast("long").alias("n_shingles")).join(lowest, "id", "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )
    unkeyed = rows.where(F.col("id").isNull()).select("text").mapInPandas(count, "n_shingles long")
    nothing = F.lit(None).cast("long")
    return told.unionByName(unkeyed.select(nothing.alias(key), "n_shingles", nothing.alias("component_id")))
