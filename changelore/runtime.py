"""Session, checkpoint and size-check helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(app: str = "changelore", cores: str | int = "*") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("CHANGELORE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="changelore-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job at a written table in the shared folder.

    Unlike an eager `checkpoint()`, which computes its input twice, the write
    runs once, survives lost executors and is read back column by column.
    """
    return checkpointed_count(df, F.lit(True))[0]


def checkpointed_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """`checkpointed` and the number of rows that meet a condition, in one job."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count_if(condition).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count is already known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a table with fewer scan partitions than cores out to all cores.

    Meant in front of heavy work on every row.  A table of many files keeps the
    partitions of its scan, nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the short rows of a table out, a few parts for each core, before they grow.

    A small file is one or few scan partitions whatever its rows become; a fixed number of parts is not
    merged by AQE, which only sees how short the rows are.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Count the rows and add up their rendered size, in the tasks that compute them.

    Meant for tables that are cheap to compute, such as questions.
    """
    rendered = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(rendered), F.lit(0)).alias("b")).first()
    return seen["n"] <= max_rows and seen["b"] <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a table that was checked to be small, else leave the join to AQE.

    A larger side keeps the shuffle join with AQE skew splitting.
    """
    return F.broadcast(df) if is_small(df) else df
