"""Small documents with every awkward case: NULL, empty, long, repeated rows, ties, extra columns."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "a", "en"]) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    passage = sentence(40)
    rows, texts = [], []
    for i in range(n):
        kind = rng.randrange(7)
        text = "\n".join(sentence(rng.randint(5, 25)) for _ in range(rng.randint(1, 8)))
        if kind == 0 and texts:
            text = rng.choice(texts)
        elif kind == 1 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = f"{text}\n{passage}\n{sentence(6)}"
        texts.append(text)
        rows.append((i * 3 + 1, text, "en", f"s{i % 4}", len(text)))
    rows += [
        (1000, None, "en", None, None),
        (1001, "", "en", "s0", 0),
        (1002, " \t\n", None, "s0", 3),
        (1003, "one two", "en", "s1", 7),
        (1004, "One TWO", "en", "s1", 7),
        (1005, " ".join(sentence(30) for _ in range(60)), "en", "s2", None),
        (1006, "é ﬁ 😀 İ\u0085x 你好", "de", "s3", 5),
        (1, rows[0][1], "en", "s0", 1),
        (None, texts[0], "en", "s1", 1),
    ]
    return rows
