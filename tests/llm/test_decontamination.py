from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelore.llm import decontamination as D
from tests.llm.texts import DOC_SCHEMA, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def brute(texts: list, items: list, window: int = 10) -> list[tuple]:
    """(n_words, n_hit, items) of each text, every window of every item looked for at every place."""
    cut = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        cut += [(item, w[s : s + n]) for s in range(len(w) - n + 1) if n]
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        starts: dict[str, list[int]] = {}
        for p, x in enumerate(w):
            starts.setdefault(x, []).append(p)
        for item, g in cut:
            for p in starts.get(g[0], ()):
                if w[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    found.add(item)
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def cases(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "e5", "f", "Über", "ß", "日本", "x1"]
    prose = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(25)]
    items += [(3, prose(12)), (None, prose(10)), (50, None), (51, ""), (52, " .,- "), (53, items[4][1]), (54, "A " * 10)]
    docs = []
    for i in range(60):
        parts = [prose(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            taken = words(rng.choice(items)[1])
            low = rng.randint(0, max(0, len(taken) - 3))
            parts += [" ".join(taken[low : low + rng.randint(5, 30)]).upper(), prose(rng.randint(0, 4))]
        docs.append((i, ". ".join(parts), "en", "s", 1))
    return docs + documents(seed, 10), items


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_equal_brute_force(table_of, seed):
    docs, items = cases(seed)
    clashing = table_of(docs, DOC_SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("h", "k1", "unit", "words", "item", "id", "n_hit")])
    got = D.contaminated(clashing, table_of(items, "item_id long, text string").withColumn("tokens", F.lit("x"))).collect()
    want = brute([d[1] for d in docs], items)
    assert sorted(map(repr, [(r[0], r[1], r[2], r["items"]) for r in got])) == sorted(
        repr((d[0], *w)) for d, w in zip(docs, want, strict=True)
    )
    assert all(r["n_items"] == len(r["items"]) for r in got)


def test_whole_long_texts_and_copies(table_of):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(14))
    long = " ".join(rng.choice("bcdfg") + str(rng.randrange(5000)) for _ in range(20_000))
    rows = [(1, f"{long} {passage} {long}", "en", "s", 1), (2, f"{passage}", "en", "s", 1)]
    rows += [(7, f"start {passage[:20]} and {passage}.", "en", "s", 1)] * 300 + [(None, passage, "en", "s", 1)]
    items = [(9, passage), (10, " ".join(passage.split()[2:12]))]
    got = D.contaminated(table_of(rows, DOC_SCHEMA), table_of(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_words"] == 40_014 and by_id[1]["n_hit"] == 14
    assert all((r["n_hit"], r["items"]) == (14, ["10", "9"]) for r in got)


def test_a_gap_of_one_word_is_no_hit(table_of):
    passage = [f"q{i}" for i in range(10)]
    broken = passage[:5] + ["other"] + passage[5:]
    rows = [(1, " ".join(broken), "", "", 1), (2, " ".join(passage[:9]), "", "", 1), (3, " ".join(passage[1:] + passage[:1]), "", "", 1)]
    items = table_of([(1, " ".join(passage))], "item_id long, text string")
    assert D.contaminated(table_of(rows, DOC_SCHEMA), items).agg(F.sum("n_hit")).first()[0] == 0


def test_empty_tables(table_of):
    docs, items = table_of([(1, "a b", "", "", 1)], DOC_SCHEMA), table_of([(1, "a b")], "item_id long, text string")
    assert D.contaminated(docs.where("doc_id > 1"), items).count() == 0
    assert [tuple(r) for r in D.contaminated(docs, items.where("item_id > 1")).collect()] == [(1, 2, 0, 0, [])]
    assert [tuple(r) for r in D.contaminated(docs, items).collect()] == [(1, 2, 2, 1, ["1"])]


def test_windows_of_items_are_bits_of_the_table(table_of):
    windows = D.item_windows(table_of([(1, " ".join(f"w{i}" for i in range(400)))], "item_id long, text string"), "item_id", "text", 10, 3)
    tokens = windows.select(F.explode("tokens").alias("h")).distinct()
    table, bits = D.bit_table(tokens, 398)
    assert len(table) * 8 == bits and int(np.unpackbits(table).sum()) == tokens.count()
    assert D._member(np.array([r["h"] for r in tokens.collect()]), table, bits).all()
