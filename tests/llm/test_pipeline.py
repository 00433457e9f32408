"""The pipeline against plain computations of each stage on what its predecessor kept."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_duplicates import brute_groups
from tests.llm.test_pii import PATTERNS, brute
from tests.llm.test_rules_and_mix import brute_counts
from tests.llm.texts import DOC_SCHEMA, WORDS, documents


def prose(seed: int) -> list[tuple]:
    """Documents with unique keys; every fifth holds personal data."""
    rows, seen = [], set()
    for r in documents(seed, 50):
        if r[0] is None or r[0] in seen:
            continue
        seen.add(r[0])
        text = r[1]
        if text and r[0] % 5 == 0:
            text += " Write to ann.b@mail3.example.com or +1 (988) 555-2485 from 10.2.3.4 today."
        rows.append((r[0], text, *r[2:]))
    return rows


def test_every_stage_on_what_the_last_one_kept(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(prose(4), DOC_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs.collect())
        assert k == len(P.STAGES) - 1 or docs.columns == P.COLUMNS

    # quality: nothing in these texts fails by line, so the base counts alone decide
    want = {r[0]: r[1] for r in prose(4) if not brute_counts(r[1])[-1]}
    assert {r["doc_id"]: r["text"] for r in kept[0]} == want

    groups = brute_groups([(r["doc_id"], r["text"]) for r in kept[0]])
    assert {r["doc_id"] for r in kept[1]} == set(groups.values())
    assert len(kept[1]) == len(set(groups.values()))

    for r in kept[2]:
        before = want[r["doc_id"]]
        if brute(before):
            assert "[EMAIL]" in r["text"] and "[PHONE]" in r["text"] and "[IP]" in r["text"]
            assert not re.search(PATTERNS["email"], r["text"])
        else:
            assert r["text"] == before
        assert r["n_chars"] == len(r["text"])

    copies = Counter(r["doc_id"] for r in kept[3])
    texts = {r["doc_id"]: r["text"] for r in kept[2]}
    assert copies.keys() <= texts.keys() and max(copies.values()) <= 3
    assert all(r["text"] == texts[r["doc_id"]] for r in kept[3])
    total = sum(len(WORDS.findall(t)) for t in texts.values())
    longest = max(len(WORDS.findall(t)) for t in texts.values())
    mixed = sum(len(WORDS.findall(r["text"])) for r in kept[3])
    assert abs(mixed - total) <= 4 * longest

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter(r["doc_id"] for r in kept[4]) == copies
    for r in kept[4]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)

    assert sorted(map(tuple, P.run(spark, folder).collect())) == sorted(map(tuple, kept[4]))


def test_an_empty_table_goes_through(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    assert P.run(spark, folder).count() == 0
