"""Quality scores by supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax.

Every word has the mean of its own hashed vector, those of its character n-grams (3 and 4) and that of its
shape; neighbouring words add a hashed pair vector.  A document is the mean over its words and pairs, a
linear layer with softmax gives the class.  Vectors and layer are trained together by numpy stochastic
gradient descent on a bounded sample of labelled rows; every document is then scored whole in a map without
a shuffle.

N-grams are hashed by numpy over the code points of all words that are new to a task, so Python runs once
per distinct word.  The model is a fixed number of floats (`BUCKETS` x `DIM`), whatever the corpus holds,
and is broadcast; bucket weights of the sample are built where its texts lie, and one task trains on them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelore.llm.common import WORD_RE

BUCKETS = 1 << 15
DIM = 16
#: At most so many labelled rows are fitted, those with the smallest hash of their key, half of them of either class.
FIT_ROWS = 4_000
EPOCHS = 8
RATE = 0.5
FOLDS = 5
THRESHOLD = 0.3
#: A task keeps so many words, and forgets them all beyond so many code points.
WORDS_KEPT, CHARS_KEPT = 200_000, 10_000_000
GRAMS = (3, 4)
#: Words of a document are worked on in runs of at most so many, n-grams in batches of so many code points and
#: in pieces of a long word, so very long texts and words need bounded memory.
RUN = 100_000
RUN_CHARS = 1_000_000
PIECE = 4_096
_LETTERS = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fold(key: F.Column) -> F.Column:
    """crc32 of the key as text, modulo 5; rows of fold 0 are held out."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def _hash(data: str) -> int:
    return zlib.crc32(data.encode("utf-8", "surrogatepass"))


def _shape_of(word: str) -> int:
    shape = "U" if word.isupper() else "l" if word.islower() else "T" if word.istitle() else "m"
    return _hash(f"shape {shape} {'' if word.isalnum() else _LETTERS.sub('w', word[-8:])}") % BUCKETS


def _marked(words: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Pieces of marked words `<word>`: owners, texts, and how many code points of a piece begin n-grams.

    Short words are one piece each, many to a batch; a longer one is cut into pieces that overlap by three.
    """
    owners, texts, begins, size = [], [], [], 0
    for k, word in enumerate(words):
        marked = f"<{word}>"
        for at in range(0, len(marked), PIECE):
            owners.append(k)
            texts.append(marked[at : at + PIECE + GRAMS[-1] - 1])
            begins.append(min(PIECE, len(marked) - at))
            size += len(texts[-1])
            if size > RUN_CHARS:
                yield np.array(owners), texts, np.array(begins)
                owners, texts, begins, size = [], [], [], 0
    if owners:
        yield np.array(owners), texts, np.array(begins)


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, bucket) of every character n-gram of the marked words, in batches."""
    for owners, texts, begins in _marked(words):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts])
        piece = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = place < begins[piece]
        for n in GRAMS:
            at = np.flatnonzero(starts & (place + n <= sizes[piece]))
            h = np.full(len(at), np.uint64(n), np.uint64)
            for j in range(n):
                h = (h ^ points[at + j]) * _ODD
                h ^= h >> np.uint64(29)
            yield owners[piece[at]], (h % np.uint64(BUCKETS)).astype(np.int64)


def units(words: list[str]) -> np.ndarray:
    """What a word's mean is taken over: its own vector, its shape and its n-grams."""
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    return 2 + sum(np.maximum(size - n + 1, 0) for n in GRAMS)


def _runs(found: list[str]) -> Iterator[list[str]]:
    """The words in runs of at most `RUN` words."""
    for at in range(0, len(found), RUN):
        yield found[at : at + RUN]


def _pairs(own: np.ndarray) -> tuple[np.ndarray, int]:
    """Buckets of neighbouring words, and how many neighbours are equal."""
    pairs = (own[:-1] * np.uint64(1_000_003) + own[1:]) % np.uint64(BUCKETS)
    return pairs.astype(np.int64), int((own[:-1] == own[1:]).sum())


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which add up to 1; no buckets for NULL and blank texts."""
    found = WORD_RE.findall(text or "")
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counted = Counter(found)
    words = list(counted)
    own = {w: _hash(w) for w in words}
    weight = np.array([counted[w] for w in words]) / units(words)
    total = np.bincount([own[w] % BUCKETS for w in words], weights=weight, minlength=BUCKETS)
    total += np.bincount([_shape_of(w) for w in words], weights=weight, minlength=BUCKETS)
    for owner, bucket in grams(words):
        total += np.bincount(bucket, weights=weight[owner], minlength=BUCKETS)
    last: list[int] = []
    for run in _runs(found):
        hashes = np.array([*last, *(own[w] for w in run)], dtype=np.uint64)
        last = [own[run[-1]]]
        pairs, repeats = _pairs(hashes)
        total += np.bincount(pairs, minlength=BUCKETS)
        total[_hash("repeat") % BUCKETS] += repeats
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / total[at].sum()).astype(np.float32)


class Model:
    """Vectors of all buckets and the softmax layer over their weighted mean."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> None:
        self.vectors, self.layer, self.bias = vectors, layer, bias

    def scores(self) -> np.ndarray:
        """Both logits of each bucket; the mean is linear, so they can be averaged in place of the vectors."""
        return self.vectors @ self.layer


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent over `features` rows, one document a step, in seeded order; classes weigh alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    counts = np.bincount(labels, minlength=2)
    weight = np.where(counts > 0, len(labels) / np.maximum(2 * counts, 1), 0).clip(0, 10)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, w = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = w @ vectors[at]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]] * rate
            grad = layer @ p
            layer -= np.outer(hidden, p).astype(np.float32)
            bias -= p.astype(np.float32)
            # weights are below one; the usual factor keeps the step of a whole document
            vectors[at] -= np.outer(w * np.float32(len(at)) ** 0.5, grad).astype(np.float32)
    return Model(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Train on labelled rows outside fold 0: of each class at most rows / 2, those with the smallest key hash.

    The sample is bounded by `rows`, a row of it by `BUCKETS` weights, and neither grows with the input;
    the driver sees the model alone.  Labels that are NULL or neither 0 nor 1 are left out; without usable
    labels there is no model.
    """
    usable = labels.select("doc_id", F.col("quality").alias("_q")).where(
        F.col("_q").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)
    )
    usable = usable.groupBy("doc_id").agg(F.max("_q").alias("_q"))
    per_class = rows // 2
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = None
    for quality in (0, 1):
        part = usable.where(F.col("_q") == quality).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most `rows` keys, so this side may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    taken = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_q").cast("int").alias("q"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [features(t) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["doc_id"], "q": frame["q"], "at": [a for a, _ in made], "w": [w for _, w in made]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = [r for frame in frames for r in frame.itertuples(index=False)]
        drawn.sort(key=lambda r: r.key)
        if drawn:
            kinds = np.int32, np.float32
            model = train([tuple(np.asarray(c, k) for c, k in zip((r.at, r.w), kinds, strict=True)) for r in drawn], [int(r.q) for r in drawn])
            parts = [x.astype(np.float32).tobytes() for x in (model.vectors, model.layer, model.bias)]
            yield pd.DataFrame([parts], columns=["vectors", "layer", "bias"])

    weights = taken.mapInPandas(build, f"key {docs.schema['doc_id'].dataType.simpleString()}, q int, at array<int>, w array<float>")
    row = weights.repartition(1).mapInPandas(learn, "vectors binary, layer binary, bias binary").first()
    if row is None:
        return None
    vectors, layer, bias = [np.frombuffer(row[c], np.float32).copy() for c in ("vectors", "layer", "bias")]
    return Model(vectors.reshape(BUCKETS, DIM), layer.reshape(DIM, 2), bias)


class Scorer:
    """Scores whole texts: the model is linear in the bucket weights, so a word's part is a number that is kept."""

    def __init__(self, margin: np.ndarray, offset: float) -> None:
        self.margin, self.offset = margin, offset
        self.known: dict[str, int] = {}
        self.chars = 0
        self.own, self.part = np.zeros(0, np.uint64), np.zeros(0)

    def _learn(self, words: list[str]) -> None:
        """Number new words; their n-grams are hashed all at once."""
        if self._full(words):
            self.known.clear()
            self.chars = 0
            self.own, self.part = self.own[:0], self.part[:0]
        self.chars += sum(map(len, words))
        own = np.array([_hash(w) for w in words], dtype=np.uint64)
        part = self.margin[(own % np.uint64(BUCKETS)).astype(np.int64)] + self.margin[[_shape_of(w) for w in words]]
        for owner, bucket in grams(words):
            part += np.bincount(owner, weights=self.margin[bucket], minlength=len(words))
        self.known.update(zip(words, range(len(self.own), len(self.own) + len(words)), strict=True))
        self.own, self.part = np.append(self.own, own), np.append(self.part, part / units(words))

    def _full(self, more: Collection[str]) -> bool:
        return len(self.known) + len(more) > WORDS_KEPT or self.chars > CHARS_KEPT

    def _numbers(self, words: list[str]) -> np.ndarray:
        at = list(map(self.known.get, words))
        if None in at:
            new = set(words).difference(self.known)
            if self._full(new):
                new = set(words)  # all are learnt again
            self._learn(list(new))
            at = list(map(self.known.get, words))
        return np.array(at, dtype=np.int64)

    def __call__(self, text: str | None) -> float:
        found = WORD_RE.findall(text or "")
        if not found:
            return 0.0
        total, weight = 0.0, 0
        last = np.zeros(0, np.uint64)
        for run in _runs(found):
            at = self._numbers(run)
            own = np.append(last, self.own[at])
            last = own[-1:]
            pairs, repeats = _pairs(own)
            total += float(self.part[at].sum()) + float(self.margin[pairs].sum())
            total += repeats * float(self.margin[_hash("repeat") % BUCKETS])
            weight += len(run) + len(pairs) + repeats
        return float(1.0 / (1.0 + np.exp(-np.clip(total / weight + self.offset, -60, 60))))


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (probability of class 1) and predicted (score at or above the threshold).

    All input columns and repeated rows stay; columns of those names are replaced.  NULL and blank texts
    score 0.0.  Without a model every score is 0.5.
    """
    base = docs.drop("score", "predicted")
    if model is None:
        return base.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1 if threshold <= 0.5 else 0))
    logits = model.scores()
    margin = docs.sparkSession.sparkContext.broadcast((logits[:, 1] - logits[:, 0]).astype(np.float64))
    offset = float(model.bias[1] - model.bias[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(margin.value, offset)
        for frame in frames:
            scores = np.array([scorer(value) for value in frame[text]], dtype=np.float64)
            yield frame.assign(score=scores, predicted=(scores >= threshold).astype(np.int32))

    schema = T.StructType(
        [*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    return base.mapInPandas(run, schema)
