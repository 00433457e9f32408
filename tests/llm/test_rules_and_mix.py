from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from changelore.llm import mixing, quality_rules
from tests.llm.texts import DOC_SCHEMA, WORDS, documents


def brute_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    base_failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), base_failed


def test_base_counts_equal_brute_force(table_of):
    rows = documents() + [
        (2000, "a b c d e f g h " * 9, "en", "s", 1),
        (2001, "x " * 8 + "y " + "x " * 8, "en", "s", 1),
        (2002, "a b c d e f g h i", "en", "s", 1),
        (2003, "a\na\n\nb\na\n \n ", "en", "s", 1),
        (2004, "# | $a <b>", "en", "s", 1),
    ]
    got = quality_rules.clean(table_of(rows, DOC_SCHEMA)).select(
        "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    for r in got.collect():
        assert tuple(r)[1:] == brute_counts(r["text"]), r["text"]
    assert got.count() == len(rows)


def test_lines_fail_by_rule_and_loss_decides(table_of):
    prose = "This is a plain line of some words, and it ends with a stop.\n" * 1
    body = "\n".join(f"Plain words number {i} stand{i} here{i} and{i} the{i} sentence goes{i} on for a{i} while{i}." for i in range(6))
    rows = [
        (1, body, ""),
        (2, body + "\nHome | News | Sport | About us | Contact | Terms", ""),
        (3, "\n".join(f"STOP{i}!! NOW!! BUY!! THIS!! GREAT!! OFFER!! TODAY!!" for i in range(9)), ""),
        (4, prose + "We use cookies to improve this site.\n" + body, ""),
        (5, "\n".join(f"one{i} | two | three | four | five | six | seven" for i in range(9)), ""),
    ]
    got = {r["doc_id"]: r for r in quality_rules.clean(table_of(rows, "doc_id long, text string, kept string")).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4, 5)] == [True, True, False, True, False]
    assert got[1]["clean_text"] == body and got[2]["clean_text"] == body
    assert "cookies" not in got[4]["clean_text"] and got[4]["n_failed_lines"] == 1


def test_empty_tables(table_of):
    docs = table_of([(1, "a", "en", "s", 1)], DOC_SCHEMA).where("doc_id > 5")
    assert quality_rules.clean(docs).count() == 0
    assert mixing.mix(docs).count() == 0


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_meets_targets_and_agrees_with_itself(table_of):
    rows = documents(5, 80)
    docs = table_of(rows, DOC_SCHEMA).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(WORDS.findall(r["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 + 2 * max(len(WORDS.findall(rows[0][1])), 1) * (s == "s0")
    again = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["text"]): r["taken"] for r in got}


def test_whole_epochs_come_first(table_of):
    rows = [(i, "w " * 10, "en", "a", 1) for i in range(10)] + [(100 + i, "w " * 10, "en", "b", 1) for i in range(90)]
    got = mixing.mix(table_of(rows, DOC_SCHEMA)).collect()
    small = [r["taken"] for r in got if r["source"] == "a"]
    assert set(small) == {30}  # a third of all words would be more than three epochs
    assert sum(r["taken"] for r in got) == 1000


def long_text(n: int) -> str:
    return "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) + "." for i in range(n // 20))


def test_filters_on_the_verdict_of_long_texts(table_of):
    rows = [(i, long_text(20_000), "en", "s", 1) for i in range(6)] + [(7, "a b", "en", "s", 1), (8, None, "en", "s", 1)]
    judged = quality_rules.clean(table_of(rows, DOC_SCHEMA))
    assert sorted(r["doc_id"] for r in judged.where("kept").select("doc_id").collect()) == list(range(6))
    assert [r["doc_id"] for r in judged.where("base_failed AND n_words > 0").collect()] == [7]
    assert judged.where("lost_chars = 0").where("clean_text <> ''").count() == 7
