"""Stored tables, partitioned by batch and bucketed by a key, that joins on the key read without an exchange.

The files below `path` are the table; the session's catalog only names them, so any session opens what
another one wrote.  A batch is written as a whole and replaces itself, so a repeated batch changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelore import schemas


MANAGED = "spark.sql.hive.manageFilesourcePartitions"


def declare(spark: SparkSession, ddl: str) -> None:
    """Name files in the catalog; their partitions are found by listing, as other writers add to them."""
    before = spark.conf.get(MANAGED, "true")
    spark.conf.set(MANAGED, "false")
    try:
        spark.sql(ddl)
    finally:
        spark.conf.set(MANAGED, before)


@dataclass(frozen=True)
class BucketedTable:
    """`schema` names the columns, `key` the one that buckets and orders the rows of a file."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    buckets: int

    @property
    def name(self) -> str:
        return "stored_" + hashlib.sha256(f"{self.path}|{self.buckets}".encode()).hexdigest()[:24]

    def declared(self) -> str:
        """The table's name, known to the catalog."""
        declare(
            self.spark,
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}, batch BIGINT) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'",
        )
        return self.name

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.declared())
        return self.spark.table(self.name)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store the rows as this batch, in place of what it held; one file for each bucket."""
        columns = ", ".join(schemas.fields(self.schema))
        dealt = rows.select(*schemas.fields(self.schema)).repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.declared()} PARTITION (batch = {int(batch)}) SELECT {columns} FROM {{rows}}", rows=dealt
        )
        self.spark.catalog.refreshTable(self.name)

    def others(self, batch: int) -> DataFrame:
        """The rows of all batches but one."""
        return self.read().where(F.col("batch") != batch)
