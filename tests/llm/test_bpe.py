from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from changelore.llm import bpe
from tests.llm.texts import DOC_SCHEMA, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [
    *"abcdefghijklmnopqrstuvwxyz'  \n\t0123!?.,-<|>ΣσςİıßéÉ", "é", "́", "Å", "<|startoftext|>", "<|endoftext|>",
    "\x1c", "\x85", " ", "　", "😀", "中文", "한", "'s", "'LL", "ſ", "Ǆ", "ﬁ", "１", "²", "​", "\x00", "aaaaaaa",
]


def test_codec_equals_the_library():
    codec, library = bpe.Codec(open(PATH, "rb").read()), Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for text in [*texts, *(r[1] or "" for r in documents()), "x" * 3000, "ab" * 2000]:
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert got.tolist() == want, text
        assert codec.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_small_tables_of_words_change_nothing(monkeypatch):
    whole = bpe.Codec(open(PATH, "rb").read())
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    monkeypatch.setattr(bpe, "IDS_PER_GATHER", 3)
    tight = bpe.Codec(open(PATH, "rb").read())
    for r in documents(n=8):
        ids = whole.encode(r[1] or "")
        assert np.array_equal(ids, tight.encode(r[1] or ""))
        assert whole.decode(ids) == tight.decode(ids)


def test_operator_keeps_rows_and_columns(table_of):
    library = Tokenizer.from_file(PATH)
    rows = documents(n=12)
    docs = table_of(rows, DOC_SCHEMA).withColumnRenamed("n_chars", "n_tokens")
    out = bpe.encode(docs, PATH).collect()
    digests = {(r["doc_id"], r["text"]): r for r in bpe.encode(docs, PATH, digest=True).collect()}
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want and r["n_tokens"] == len(want)
        d = digests[r["doc_id"], r["text"]]
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs.where("doc_id > 5000"), PATH).count() == 0
