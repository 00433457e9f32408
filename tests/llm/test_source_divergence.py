from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from changelore.llm import source_divergence as S
from tests.llm.texts import DOC_SCHEMA, documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        share = {}
        whole = sum((counts[lang, s] for s in sources), Counter())
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, whole)]:
            n = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        for s in sources:
            p = share[s]
            pairs = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode()) for o, q in share.items() if o not in (s, None)]
            q = share[None]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_rows_equal_brute_force(table_of):
    rng = random.Random(5)
    stems = ["Zug", "été", "don't", "x2y", "日本", "naïve", "a", "B", "ÀB", "z_z"]
    rows = documents(5, 80)
    for i in range(150):
        skew = rng.randrange(1, len(stems) + 1)
        text = " ".join(rng.choice(stems[:skew]) + rng.choice(["", "", "q", "r"]) for _ in range(rng.randint(0, 40)))
        rows.append((5000 + i, text, rng.choice(["en", "de", None, "ünd"]), rng.choice(["a", "b", "c", None, "é"]), 1))
    # a language without kept terms, groups without terms, a repeated row
    rows += [(9000, "alone", "xx", "a", 1), (9001, None, "xx", "b", 1), (9002, "123 !", "en", "empty", 1)] + [rows[70]] * 5
    clashing = table_of(rows, DOC_SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("term", "n", "p", "docs", "value", "rank", "item")])
    got = sorted(tuple(r) for r in S.divergence(clashing).collect())
    assert got == brute(rows)
    got = sorted(tuple(r) for r in S.divergence(clashing, least=1, top=5).collect())
    assert got == brute(rows, 1, 5)


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(10**12, 3 * 10**13, 10**9), (0, 0, 1), (5 * 10**11 - 1, 10**12, 0), (7, 10, 3), (9 * 10**17, 9 * 10**17, 10**9)]
    rows = spark.createDataFrame([(str(c), str(n), str(v)) for c, n, v in cases], "c string, n string, v string")
    got = rows.select(S.share(F.col("c").cast("long"), F.col("n").cast("long"), F.col("v").cast("long")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]
    assert rows.select(S.share(F.lit(0), F.lit(0), F.lit(0)).alias("p")).first()["p"] is None
    assert rows.select(S.excess(F.lit(10**9 + 1), F.lit(1)).alias("f")).first()["f"] == 10**18


def test_a_hot_source_and_long_texts(table_of):
    rng = random.Random(8)
    words = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnr") + rng.choice(["", "x", "y"]) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en", "hot" if i % 3 else f"s{i % 12}", 1) for i in range(600)]
    rows.append((1000, " ".join(rng.choice(words) for _ in range(30_000)), "en", "long", 1))
    got = sorted(tuple(r) for r in S.divergence(table_of(rows, DOC_SCHEMA)).collect())
    assert got == brute(rows)


def test_empty_table(table_of):
    assert S.divergence(table_of([(1, "a", "en", "s", 1)], DOC_SCHEMA).where("doc_id > 1")).count() == 0
    alone = S.divergence(table_of([(1, "a", "en", "s", 1)], DOC_SCHEMA))
    assert alone.count() == 0  # no other source, no kept term
