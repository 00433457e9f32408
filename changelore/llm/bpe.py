"""BPE by backtracking: longest token matches, checked pair by pair, give the exact merges without merging.

A word is covered from the left with the longest token that an Aho-Corasick automaton finds at each
position.  A neighbouring pair of tokens is allowed when merging both together would leave exactly these
two; a sequence in which every pair is allowed is the merge result.  A refused token falls back to its
longest proper prefix in the vocabulary, an exhausted position takes back the token before it, and no
position is left twice, so work is linear in the word.  Decoding gathers token texts by an offset table.

The work is a map over rows without a shuffle.  The vocabulary (a fixed file of a few MB) is read on the
driver and broadcast; words recur, so workers keep a bounded table of encoded words.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

END = ""
WORDS_KEPT = 400_000
PAIRS_KEPT = 400_000
ROWS_PER_BATCH = 500
BYTES_PER_BATCH = 8_000_000
IDS_PER_GATHER = 1_000_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Table:
    """Texts of all ids in one buffer, found by offsets."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.cumsum([0, *map(len, texts)])

    def gather(self, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), IDS_PER_GATHER):
            part = ids[at : at + IDS_PER_GATHER]
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
            yield self.buffer[place].tobytes()


class Codec:
    """Encoder and decoder of one vocabulary file with word ends and byte letters."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        internal = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.ids = {internal(t): i for t, i in model["vocab"].items()}
        names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        size = max(names) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(internal(a), internal(b)): r for r, (a, b) in enumerate(pairs)}
        self.text = {i: t for t, i in self.ids.items()}
        self.shorter = {i: self._prefix(t) for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        token = [names.get(i, "").encode() for i in range(size)]
        self.decoded = Table([t + b" " for t in token])
        self.decimal = Table([b"%d " % i for i in range(size)])
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
        )
        self.blank = regex.compile(r"\p{White_Space}+")
        self.odd_blank = regex.compile(r"[\x1c-\x1f]")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _prefix(self, t: str) -> int:
        return next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain merging, for the few letters of a pair of tokens."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def allowed(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when merged side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            both = self.text[a] + self.text[b]
            symbols = [*both[:-2], both[-2:]] if both.endswith(END) else list(both)
            known = self._merged(symbols) == [self.text[a], self.text[b]]
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def cover(self, piece: str) -> list[int]:
        """Ids of one piece: byte letters, closed by the word end."""
        longest = [-1] * (len(piece) + 1)
        for end, (i, n) in self.automaton.iter(piece):
            longest[end - n + 1] = i  # later ends are longer
        out: list[int] = []
        at, token, dead = 0, longest[0], bytearray(len(piece) + 1)
        while at < len(piece):
            while token >= 0:
                after = at + len(self.text[token])
                if not dead[after] and (not out or self.allowed(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = after
                token = longest[at]
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(self.text[last])
                token = self.shorter[last]
        return out

    def word(self, word: str) -> bytes:
        """Ids of a run without white space, as packed 4-byte numbers."""
        out: list[int] = []
        for part in self.marks.split(word) if self.marks and "<" in word else [word]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                shown = part.lower()
                found = [shown] if shown.isalpha() else self.pieces.findall(shown)
            else:  # lower case goes sign by sign: no final sigma
                shown = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found = self.pieces.findall(shown)
            for piece in found:
                ids = self.known.get(piece)
                if ids is None:
                    inner = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
                    ids = self.cover(inner + END)
                    if len(piece) < 40:
                        if len(self.known) >= WORDS_KEPT:
                            self.known.clear()
                        self.known[piece] = ids
                out.extend(ids)
        return array.array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        found = self.blank.split(text) if self.odd_blank.search(text) else text.split()
        parts = []
        for w in found:
            ids = self.words.get(w)
            if ids is None:
                ids = self.old_words.get(w)
                if ids is None:
                    ids = self.word(w)
                if len(w) < 200:
                    if len(self.words) >= WORDS_KEPT:
                        self.old_words, self.words = self.words, {}
                    self.words[w] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.decoded.gather(ids))[:-1]


@functools.lru_cache(maxsize=2)
def codec_of(content: bytes) -> Codec:
    return Codec(content)


def _digest(table: Table, ids: np.ndarray) -> str:
    """sha256 of the gathered texts without the last blank."""
    seen, held = hashlib.sha256(), b""
    for part in table.gather(ids):
        seen.update(held)
        held = part
    seen.update(held[:-1])
    return seen.hexdigest()


def encode(docs: DataFrame, path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Encode every whole text with the vocabulary file at `path` and decode it again.

    Adds n_tokens, token_ids (array of int) and decoded; with `digest`, ids_sha256 (of the decimal ids
    joined by one blank) and decoded_sha256 in their place.  All input columns and repeated rows stay;
    columns of those names are replaced.  NULL texts count as empty: no tokens, empty decoding.
    """
    spark = docs.sparkSession
    with open(path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    added = (
        [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        if digest
        else [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )
    added = [T.StructField("n_tokens", T.LongType()), *added]
    names = {f.name.lower() for f in added}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(content.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = 0
            while at < batch.num_rows:
                counts, first, second, size, start = [], [], [], 0, at
                while at < batch.num_rows and at - start < ROWS_PER_BATCH and size < BYTES_PER_BATCH:
                    value = column[at].as_py() or ""
                    ids = codec.encode(value)
                    counts.append(len(ids))
                    first.append(_digest(codec.decimal, ids) if digest else ids)
                    second.append(_digest(codec.decoded, ids) if digest else codec.decode(ids).decode())
                    size += len(value) + 4 * len(ids)
                    at += 1
                rows = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[rows.column(batch.schema.get_field_index(n)) for n in kept_names],
                        pa.array(counts, pa.int64()),
                        pa.array(first, pa.string() if digest else pa.list_(pa.int32())),
                        pa.array(second, pa.string()),
                    ],
                    names=[*kept_names, *[f.name for f in added]],
                )

    return docs.mapInArrow(run, T.StructType([*kept, *added]))
