"""Near-duplicate vectors by Euclidean p-stable hashing in several tables, then exact cosines.

A table hashes a normalised vector by `HASHES` quantised random projections floor((a.x + b) / WIDTH).  Two
unit vectors of cosine 0.93 are 0.374 apart and agree in one projection with probability 0.85, in a table
with 0.2, in at least one of `TABLES` with 0.995; unrelated ones agree in a table with under 0.001.

Vectors of a bucket are compared exactly.  Buckets larger than `CELL` are cut into blocks, and each pair
of blocks is a cell of its own, so a bucket with a third of all vectors is many tasks and nothing is left
out.  A pair that already met in an earlier table is skipped, so links are counted once.  Cells report a
count and a root per vector, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore.llm.components import components
from changelore.runtime import checkpointed

TABLES = 24
HASHES = 10
WIDTH = 2.0
SEED = 17
CELL = 1_500
#: Groups up to this size are compared together, row against row at each distance.
TINY = 48


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def keys_of(unit: np.ndarray) -> np.ndarray:
    """Bucket numbers (rows x tables) of unit vectors of one dimension."""
    a, b = projections(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, HASHES)
    key = np.full(cells.shape[:2], np.int64(1469598103934665603))
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            key = (key ^ cells[:, :, j]) * np.int64(1099511628211)
            key ^= key >> np.int64(29)
    return key


def units(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors scaled to length 1, in double precision; scaled by their largest part first."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n rows reaches over the links a-b."""
    low = ids.copy()
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        if (new == low).all():
            return low
        low = new


def _cells(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Counts and roots of all cells in a frame that is sorted by cell."""
    ids = frame["id"].to_numpy(np.int64)
    side = frame["side"].to_numpy(np.int64)
    table = frame["t"].to_numpy(np.int64)
    cell = frame["cell"].to_numpy(np.int64)
    x = units(frame["v"].tolist())
    keys = np.asarray(frame["keys"].tolist(), dtype=np.int64)
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    left, right = [], []

    def accept(i: np.ndarray, j: np.ndarray) -> None:
        earlier = np.arange(TABLES)[None, :] < table[i][:, None]
        fresh = ~((keys[i] == keys[j]) & earlier).any(axis=1) & (ids[i] != ids[j])
        left.append(i[fresh])
        right.append(j[fresh])

    size_of = np.repeat(sizes, sizes)
    tiny = np.flatnonzero(size_of <= TINY)
    for d in range(1, min(TINY, int(sizes.max(initial=1)))):
        i = tiny[tiny + d < len(cell)]
        i = i[(cell[i] == cell[i + d]) & ((side[i] == 2) | (side[i] != side[i + d]))]
        if len(i):
            near = np.einsum("ij,ij->i", x[i], x[i + d]) >= least
            accept(i[near], i[near] + d)
    for s, n in zip(starts, sizes, strict=True):
        if n <= TINY:
            continue
        rows = np.arange(s, s + n)
        first = rows[side[rows] != 1]
        second = rows if side[s] == 2 else rows[side[rows] == 1]
        for at in range(0, len(first), 512):
            part = first[at : at + 512]
            i, j = np.nonzero(x[part] @ x[second].T >= least)
            i, j = part[i], second[j]
            if side[s] == 2:
                i, j = i[i < j], j[i < j]
            accept(i, j)
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    low = roots(len(ids), i, j, ids)
    hit = np.flatnonzero(count)
    return pd.DataFrame({"id": ids[hit], "n": count[hit], "root": low[hit]})


def link(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93
) -> DataFrame:
    """Add n_links, component_id and kept to every row.

    Vectors of equal, not NULL label link when their cosine is `least` or more.  Vectors that are NULL, zero,
    empty or hold NULL or non-finite parts, and rows with a NULL key, link with nothing; vectors of
    different length do not link.  Rows of equal key are one vector (the smallest by label and parts).
    Columns of the added names are replaced.
    """
    usable = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")))
        & F.exists("v", lambda p: p != 0)
    )
    one = usable.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            lengths = frame["v"].map(len)
            for _, part in frame.groupby(lengths):
                yield part.assign(keys=list(keys_of(units(part["v"].tolist()))))

    kind = one.schema["v"].dataType.simpleString()
    label_kind = one.schema["label"].dataType.simpleString()
    signed = checkpointed(one.mapInPandas(hashed, f"id long, label {label_kind}, v {kind}, keys array<long>"))
    in_tables = signed.select(
        "id", "v", "keys", F.size("v").alias("dim"), "label", F.posexplode("keys").alias("t", "k")
    ).withColumn("bucket", F.xxhash64("label", "dim", "t", "k"))
    counts = signed.select(F.size("v").alias("dim"), "label", F.posexplode("keys").alias("t", "k")).select(
        F.xxhash64("label", "dim", "t", "k").alias("bucket")
    ).groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    placed = in_tables.join(counts, "bucket")
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # side: 2 in a cell of one block, else 0 or 1 for the lower and the higher block
    dealt = (
        placed.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("side", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")))
        .withColumn("cell", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
        .select("cell", "id", "side", "t", "v", "keys")
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            whole = frame["cell"].to_numpy() != frame["cell"].iloc[-1]
            held = frame[~whole]
            yield from compared(frame[whole])
        if held is not None:
            yield from compared(held)

    def compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in rows.groupby(rows["v"].map(len)):  # a cell has vectors of one length
            yield _cells(part, least)

    found = checkpointed(
        dealt.repartition("cell").sortWithinPartitions("cell", "id").mapInPandas(compare, "id long, n long, root long")
    )
    n_links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = n_links.join(joined, "id", "left").withColumnRenamed("id", "_id")
    base = vectors.drop("n_links", "component_id", "kept")
    return (
        base.join(known, base[key] == F.col("_id"), "left")
        .drop("_id")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
        .withColumn("component_id", F.coalesce(F.col("component"), F.col(key)).cast("long"))
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
        .drop("component")
    )
