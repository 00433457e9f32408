"""Positional helpers against brute force, on groups with one heavy key."""

from __future__ import annotations

import random

import pytest

from changelore.operators import skew
from changelore.operators.threads import discussions


def test_ordinal_is_dense(spark):
    rows = [("hot", i) for i in range(5_000)] + [("cold", 1)]
    got = skew.ordinal(spark.createDataFrame(rows, "k STRING, v INT"), ["k"], ["v"]).collect()
    assert sorted(r["ordinal"] for r in got if r["k"] == "hot") == list(range(1, 5_001))
    assert [r["ordinal"] for r in got if r["k"] == "cold"] == [1]


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_carry_backward(spark, width):
    rng = random.Random(width)
    rows = []
    for k in range(3):
        ats = sorted(rng.sample(range(300), 60))
        rows += [(k, at, rng.randint(0, 99) if rng.random() < 0.3 else None) for at in ats]
    want = {}
    for k, at, _ in rows:
        later = [(a, v) for kk, a, v in rows if kk == k and a > at and v is not None]
        want[(k, at)] = min(later)[1] if later else None
    df = spark.createDataFrame(rows, "k INT, at BIGINT, v INT")
    got = {(r["k"], r["at"]): r["n"] for r in skew.carry_backward(df, ["k"], "at", "v", width, "n").collect()}
    assert got == want


@pytest.mark.parametrize(("n", "accuracy"), [(1, 100), (2, 100), (40, 5), (9_000, 50), (9_001, 2_000)])
def test_order_statistic_is_exact(spark, n, accuracy):
    rng = random.Random(n)
    values = [round(rng.expovariate(1), rng.choice([1, 4])) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.5)], "k STRING, v DOUBLE")
    got = {r["k"]: r["p"] for r in skew.order_statistic(df, ["k"], "v", 0.95, "p", accuracy).collect()}
    assert got == {"a": sorted(values)[int(0.95 * (n - 1))], "b": 1.5}


def test_discussion_of_a_huge_thread(spark):
    """Only the first comments can show, whatever the thread's length."""
    rows = [(1, i, "u", f"c{i}") for i in range(30_000)] + [(2, 0, None, "x"), (2, 1, "v", " ")]
    df = spark.createDataFrame(rows, "pr INT, turn INT, author STRING, body STRING")
    got = {r["pr"]: r["discussion"] for r in discussions(df, ["pr"], "turn").collect()}
    whole = "\n---\n".join(f"u: c{i}" for i in range(30_000))
    assert got == {1: whole[:16_000], 2: "unknown: x"}


def test_shortest_comments_still_fill_the_text(spark):
    df = spark.createDataFrame([(1, i, "", "z") for i in range(4_000)], "pr INT, turn INT, author STRING, body STRING")
    text = discussions(df, ["pr"], "turn").first()["discussion"]
    assert len(text) == 16_000
