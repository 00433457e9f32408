"""Batch encoding, quantisation and similarity of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Encoder(Protocol):
    """Built once per task; turns a batch of texts into unit vectors."""

    name: str

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic default: signed word hashing with unit length."""

    name = "hashing-384"

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            codes = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], dtype=np.int64)
            signs = np.where(codes & 1, 1.0, -1.0).astype(np.float32)
            np.add.at(out[row], (codes >> 1) % self.dim, signs)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)


def embed(
    chunks: DataFrame,
    encoder: Callable[[], Encoder] = HashingEncoder,
    text: str = "text",
    batch: int = 256,
) -> DataFrame:
    """Add `embedding` and `embedding_model`; the model is loaded once per task."""
    schema = T.StructType(
        [f for f in chunks.schema.fields if f.name not in ("embedding", "embedding_model")]
        + [
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("embedding_model", T.StringType()),
        ]
    )
    columns = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for incoming in batches:
            for start in range(0, incoming.num_rows, batch):
                part = incoming.slice(start, batch)
                texts = [t or "" for t in part.column(text).to_pylist()]
                vectors = np.asarray(model(texts), dtype=np.float32)
                offsets = np.arange(len(texts) + 1, dtype=np.int32) * vectors.shape[1]
                nested = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns]
                    + [nested, pa.array([model.name] * len(texts))],
                    names=columns + ["embedding", "embedding_model"],
                )

    return chunks.select(*columns).mapInArrow(run, schema)


def embed_new(
    chunks: DataFrame,
    stored: DataFrame,
    encoder: Callable[[], Encoder] = HashingEncoder,
    force: bool = False,
) -> DataFrame:
    """Encode only the chunks that are not stored yet (`force`: all of them)."""
    key = ["repo_id", "source_type", "source_id"]
    todo = chunks if force else chunks.join(stored.select(*key), key, "left_anti")
    return embed(todo, encoder)


def product_error(dim: int) -> float:
    """A bound on the error of a float32 product of two vectors of about unit length."""
    return (dim + 8) * 2.0**-23


def _hits(reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.nonzero` of a matrix with few hits: eight cells are looked at together."""
    width, flat = reached.shape[1], reached.reshape(-1)
    if flat.size % 8:
        return np.nonzero(reached)
    words = np.flatnonzero(flat.view(np.uint64))
    word, byte = np.nonzero(flat.reshape(-1, 8)[words])
    at = words[word] * 8 + byte
    rows = at // width
    return rows, at - rows * width


class Nearest:
    """What can be among the k nearest of a block of questions, from scores with a bound on their error.

    A question's limit is its k-th best lower bound so far.  Scores that cannot reach it are left where they
    are, so a product costs little beside itself.  `exact` gives the similarities of pairs; with it, equal
    ones (six decimals) beyond the k first places go as well, so ties are never held in numbers.
    """

    def __init__(self, n: int, k: int, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        self.limit = np.full(n, -np.inf)
        self.k, self.exact, self.slack = k, exact, 1e-6
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # rows, places, scores, rooms
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.n_fresh = 0

    def offer(self, rows: np.ndarray, first: int, scores: np.ndarray, room: np.ndarray) -> None:
        """Scores (float32) of `rows` with the places from `first` on; `room` bounds a row's errors."""
        limit = self.limit[rows]
        new = np.isneginf(limit)
        if scores.shape[1] >= self.k and new.any():
            part = scores if new.all() else scores[new]
            limit[new] = np.partition(part, -self.k, axis=1)[:, -self.k] - room[new]
            self.limit[rows] = limit
        least = (limit - room - self.slack - 2e-7).astype(np.float32)
        r, c = _hits(scores >= least[:, None])
        if len(r):
            self.fresh.append((rows[r], c + first, scores[r, c].astype(np.float64), room[r]))
            self.n_fresh += len(r)
            if self.n_fresh > 4 * self.k * len(self.limit):
                self.merge()

    def merge(self) -> None:
        rows, places, scores, rooms = (np.concatenate([h, *f]) for h, f in zip(self.held, zip(*self.fresh, strict=True), strict=True)) if self.fresh else self.held
        self.fresh, self.n_fresh = [], 0
        low = scores - rooms
        order = np.argsort(rows * 8.0 - np.clip(low, -3, 3))
        ordered = rows[order]
        nth = np.arange(len(ordered)) - np.searchsorted(ordered, ordered, "left")
        last = order[nth == self.k - 1]
        self.limit[rows[last]] = np.maximum(self.limit[rows[last]], low[last])
        kept = scores + rooms >= self.limit[rows] - self.slack
        self.held = [x[kept] for x in (rows, places, scores, rooms)]
        if self.exact is not None and len(self.held[0]) > 4 * self.k * len(self.limit):
            rows, places, values = self.best()
            self.held = [rows, places, values, np.full(len(rows), 5e-7)]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, similarity) of the k nearest, equal ones by place; those without a number come last, as -inf."""
        if self.fresh:
            self.merge()
        rows, places = self.held[:2]
        step = 1 << 16
        parts = [self.exact(rows[i : i + step], places[i : i + step]) for i in range(0, len(rows), step)]
        values = np.round(np.concatenate([np.zeros(0), *parts]), 6)
        values[np.isnan(values)] = -np.inf
        order = np.lexsort((places, -values, rows))
        rows, places, values = rows[order], places[order], values[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < self.k
        return rows[kept], places[kept], values[kept]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def quantize(vector: Column | str) -> Column:
    """`struct(scale, codes)`: int8 codes of a float vector, one scale per vector."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    peak = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(peak > 0, peak / 127.0).otherwise(F.lit(1.0))
    codes = F.transform(
        vector, lambda x: F.round(x.cast("double") / scale, 0).cast("tinyint")
    )
    return F.when(vector.isNotNull(), F.struct(scale.alias("scale"), codes.alias("codes")))


def dequantize(quantized: Column | str) -> Column:
    q = F.col(quantized) if isinstance(quantized, str) else quantized
    return F.transform(q["codes"], lambda c: (c * q["scale"]).cast("float"))
