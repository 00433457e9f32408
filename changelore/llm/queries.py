"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore.llm import bpe, conversation_repair, decontamination, embedding_dedup, html_extract, license_scan, mixing, ngram_join, pii, quality_classifier, quality_rules, source_divergence, substring_dedup
from changelore.llm.common import table
from changelore.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.clean(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_failed_lines",
        "lost_chars",
    )


@query("op5_pii_labelers")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin(pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.digest(base), 256).alias("base_sha256"),
        pii.digest(F.col("pii")).alias("spans"),
    )


@query("op3_bpe_backtracking")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op6_source_mix")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, folder, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id",
        (quality_classifier.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        "predicted",
    )


@query("op9_html_differencing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op7_passage_automata")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.remove(docs, keep_text=False)


@query("op8_ngram_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.groups(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_embedding_lsh")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.link(table(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    # documents have no path: source and language are folders, with one below for each 500 keys
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
        F.floor(F.col("doc_id") / 500).cast("string"), F.col("doc_id").cast("string"),
    )
    docs = table(spark, folder, "documents").select("doc_id", "text", path.alias("path"))
    found = license_scan.scan(docs, license_scan.templates(spark))
    return found.select("doc_id", "path", "license", "similarity", "origin", "n_statements")


@query("op11_benchmark_decontamination")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.contaminated(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, folder, "conversations"))
    return conversation_repair.repair(rows, present="present")


@query("op13_source_divergence")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergence(table(spark, folder, "documents"))
