"""Scalar functions over whole text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore.functions import text as X
from changelore.plans import adapters as A
from changelore.plans.registry import query


@query(
    "text_functions",
    r"""SELECT doc_id, md5(split_part(text, chr(10), 1)) AS first_line,
      md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed,
      left(text, 9) AS cut, CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE text END AS shown,
      len(string_split(rtrim(text, chr(10)), chr(10))) AS n_lines, md5(trim(text, ' ' || chr(10))) AS stripped
    FROM documents""",
)
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    return A.documents(spark, folder).select(
        "doc_id",
        F.md5(X.first_line("text")).alias("first_line"),
        F.md5(X.collapse_whitespace("text")).alias("collapsed"),
        X.cut("text", 9).alias("cut"),
        X.ellipsis("text", 400).alias("shown"),
        F.size(X.lines("text")).cast("long").alias("n_lines"),
        F.md5(X.strip("text")).alias("stripped"),
    )


@query(
    "path_functions",
    f"""SELECT p_partkey, {A.EXTENSION.format(key="p_partkey")} AS suffix, p_partkey % 5 IN (0, 1, 4) AS is_code,
      'p' || CAST(p_partkey AS VARCHAR) || {A.EXTENSION.format(key="p_partkey")} AS short FROM part""",
)
def path_functions(spark: SparkSession, folder: str) -> DataFrame:
    path = F.expr(A.path_of("p_partkey"))
    return A.table(spark, folder, "part").select(
        "p_partkey",
        X.suffix(path).alias("suffix"),
        X.has_code_suffix(path).alias("is_code"),
        X.repo_short(path).alias("short"),
    )


@query(
    "time_functions",
    """SELECT event_id, strftime(CASE WHEN event_id % 10 != 0 THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS from_epoch,
      strftime(CASE WHEN event_id % 3 != 0 THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS from_iso,
      strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def time_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Epoch 0 and malformed ISO texts are no dates."""
    ts = F.col("ts").cast("timestamp")
    epoch = F.when(F.col("event_id") % 10 != 0, F.unix_seconds(ts)).otherwise(0)
    iso = F.when(F.col("event_id") % 3 == 0, F.lit("not a date")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    shown = "yyyy-MM-dd HH:mm:ss"
    return A.table(spark, folder, "events").select(
        "event_id",
        F.date_format(X.epoch_to_timestamp(epoch), shown).alias("from_epoch"),
        F.date_format(X.iso_to_timestamp(iso), shown).alias("from_iso"),
        X.iso_date("ts").alias("day"),
    )


@query(
    "payload_merge",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS stage, 'done' AS cursor,
      3 AS n_keys FROM events""",
)
def payload_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON payload read, two keys merged over it, written and read again."""
    old = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("stage"), F.col("event_type"), F.lit("cursor"), F.lit("done"))
    merged = F.to_json(F.map_concat(old, new))
    again = F.from_json(merged, "map<string,string>")
    return A.table(spark, folder, "events").select(
        "event_id",
        again["k"].cast("long").alias("k"),
        again["stage"].alias("stage"),
        again["cursor"].alias("cursor"),
        F.size(again).alias("n_keys"),
    )


@query(
    "mermaid_blocks",
    """SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN trim('before' || chr(10) || 'after ' || text, ' ' || chr(10))
        ELSE 'x ```mermaid' || chr(10) || ' ``` ' || text END) AS rest_digest,
      CASE WHEN turn % 3 = 1 THEN md5('flowchart TD' || chr(10) || 'A[' || CAST(conv_id AS VARCHAR) || ']') END AS diagram
    FROM conversations""",
)
def mermaid_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """No diagram, a diagram, a blank diagram."""
    kind = F.col("turn") % 3
    block = F.concat(
        F.lit("before\n```mermaid\nflowchart TD\nA["), F.col("conv_id").cast("string"), F.lit("]\n```after ")
    )
    answer = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(block, F.col("text")))
        .otherwise(F.concat(F.lit("x ```mermaid\n ``` "), F.col("text")))
    )
    return A.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.md5(X.without_mermaid(answer)).alias("rest_digest"),
        F.md5(X.mermaid_block(answer)).alias("diagram"),
    )
