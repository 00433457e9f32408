from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelore.llm import embedding_dedup, ngram_join, substring_dedup
from changelore.llm.components import components
from tests.llm.texts import DOC_SCHEMA, WORDS, documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Forest:
    def __init__(self) -> None:
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def tie(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text: str | None) -> frozenset:
    words = WORDS.findall((text or "").translate(LOW))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(rows) -> dict:
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    forest, where = Forest(), defaultdict(list)
    for k, (i, s) in enumerate(sets):
        forest.root(i)
        shared = Counter(o for x in s for o in where[x])
        for o, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[o][1]) - n):
                forest.tie(i, sets[o][0])
        for x in s:
            where[x].append(k)
    return {i: forest.root(i) for i, _ in sets}


@pytest.mark.parametrize("seed", [3, 8])
def test_ngram_groups_equal_brute_force(table_of, seed):
    rows = documents(seed, 90)
    # a chain of near copies whose ends are not similar, and a large group of near copies
    base = [f"w{i}" for i in range(60)]
    for step in range(12):
        rows.append((5000 + step, " ".join(base[: 60 - 3 * step] + [f"z{i}" for i in range(3 * step)]), "", "", 1))
    for step in range(40):
        words = [f"v{i}" for i in range(80)]
        words[step % 80] = f"odd{step}"
        rows.append((6000 + step, " ".join(words), "", "", 1))
    docs = table_of(rows, DOC_SCHEMA).withColumn("component_id", F.lit("clash"))
    got = ngram_join.groups(docs).collect()
    want = brute_groups(rows)
    assert len(got) == len(rows)
    sizes = defaultdict(set)
    for r in rows:
        sizes[r[0]].add(len(shingles(r[1])))
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]), r
        assert r["n_shingles"] in sizes[r["doc_id"]]


def _sets(made):
    return [(k, len(t), t.tolist(), *ngram_join.sketch(t)) for k, t in enumerate(made)]


SET_SCHEMA = "id long, n int, tokens array<long>, " + ", ".join(f"{c} long" for c in ngram_join.SKETCH)


def test_sets_that_share_frequent_tokens_only_are_no_candidates(spark):
    """Jaccard 0.69 in every pair: 780 pairs met on tokens before sketches bounded what they differ by."""
    draw = np.random.default_rng(3)
    common = draw.integers(-(2**63), 2**63, 41)
    made = [np.r_[common, draw.integers(-(2**63), 2**63, 9)] for _ in range(40)]
    sets = spark.createDataFrame(_sets(made), SET_SCHEMA)
    nothing = spark.createDataFrame([], "id long, component long")
    assert ngram_join._cross_pairs(ngram_join._prefixes(sets, 1, 80), nothing, 80).count() < 40


def test_sketches_lose_no_similar_pair(spark):
    draw = np.random.default_rng(4)
    made = []
    for n in (1, 2, 9, 40, 300, 2_000):
        whole = draw.integers(-(2**63), 2**63, n + n // 4)
        made += [whole[:n], whole, whole[n // 4 :], np.r_[whole[: n - n // 9], draw.integers(-(2**63), 2**63, n // 9)]]
    rows = spark.createDataFrame(_sets(made), SET_SCHEMA)
    kept = rows.alias("a").crossJoin(rows.alias("b")).where(ngram_join._may_link("a", "b", 80))
    kept = {tuple(r) for r in kept.select("a.id", "b.id").collect()}
    for i, a in enumerate(made):
        for j, b in enumerate(made):
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                assert (i, j) in kept


def test_minimum_hashes_agree_as_often_as_sets_are_similar(monkeypatch):
    """Orders of their own, whatever the pieces that tokens are multiplied in."""
    draw = np.random.default_rng(6)
    agree = []
    for _ in range(200):
        whole = draw.integers(0, 1 << 63, 110, np.uint64) * np.uint64(2)
        one, other = ngram_join.min_hashes(whole[:100]), ngram_join.min_hashes(whole[10:])
        with monkeypatch.context() as m:
            m.setattr(ngram_join, "MIN_TOKENS", 7)
            assert ngram_join.min_hashes(whole[:100].view(np.int64)) == one
        agree.append(np.mean(np.equal(one, other)))
    assert len(one) == sum(ngram_join.TURN_KEYS)
    assert abs(np.mean(agree) - 90 / 110) < 0.05


def test_ngram_groups_of_nothing(table_of):
    docs = table_of([(1, None, "", "", 1), (2, "", "", "", 1), (3, " ", "", "", 1)], DOC_SCHEMA)
    assert {tuple(r) for r in ngram_join.groups(docs).collect()} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert ngram_join.groups(docs.where("doc_id > 5")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 190), (190, 195)]
    forest = Forest()
    for a, b in links:
        forest.tie(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: forest.root(i) for i in forest.parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows) -> dict:
    first: dict = {}
    texts = [(r[0], WORDS.findall(r[1] or "")) for r in rows]
    for i, words in texts:
        for k in range(len(words) - 12 if i is not None else 0):
            window = tuple(words[k : k + 13])
            first[window] = min(first.get(window, i), i)
    out = Counter()
    for i, words in texts:
        gone = set()
        for k in range(len(words) - 12 if i is not None else 0):
            if first[tuple(words[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


@pytest.mark.parametrize("shard", [20_000, 7])
def test_passages_equal_brute_force(table_of, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", shard)
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", 4_000)
    rows = documents(6, 50) + [(7000, "a b " * 40, "", "", 1), (7001, "x " + "a b " * 30, "", "", 1)]
    docs = table_of(rows, DOC_SCHEMA).withColumn("n_words", F.lit("clash"))
    got = Counter(tuple(r) for r in substring_dedup.remove(docs).collect())
    assert got == brute_removal(rows)
    assert substring_dedup.remove(docs.where("doc_id > 9000")).count() == 0


def test_links_equal_brute_force_for_awkward_vectors(table_of, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 30)
    monkeypatch.setattr(embedding_dedup, "TINY", 8)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centre[i % 6] + rng.normal(size=16) * (0.02 if i % 3 else 0.12)
        rows.append((i, [float(x) for x in v * 10.0 ** (i % 5)], i % 2 if i % 17 else None))
    inf = float("inf")
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0, None], 0), (904, [inf, 1.0], 0)]
    rows += [(905, [float("nan")] * 16, 0), (906, rows[0][1], rows[0][2]), (907, [1e300] * 16, 1), (908, [1e300] * 16, 1)]
    rows += [rows[5], (None, rows[1][1], 1), (909, [2.0, 1.0], 0), (910, [2.0, 1.0], 0)]
    docs = table_of(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = embedding_dedup.link(docs).collect()
    assert len(got) == len(rows)
    usable = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v) / max(map(abs, v))
        usable[i] = (label, x / np.linalg.norm(x))
    forest, links = Forest(), Counter()
    for a in usable:
        for b in usable:
            if a < b and usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]):
                if usable[a][1] @ usable[b][1] >= 0.93:
                    links.update([a, b])
                    forest.tie(a, b)
    missed = 0
    for r in got:
        i = r["vec_id"]
        assert r["n_links"] <= links[i]
        missed += links[i] - r["n_links"]
        assert r["kept"] == (r["component_id"] == i)
        if not links[i]:
            assert r["component_id"] == i
    assert missed <= 0.01 * sum(links.values())  # tables are independent draws; nearly all links are found
    assert embedding_dedup.link(docs.where("vec_id > 5000")).count() == 0
