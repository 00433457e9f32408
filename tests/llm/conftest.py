from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def table_of(spark, tmp_path_factory):
    """Rows as a Parquet table, so that plans are those of a scan."""

    def make(rows, schema):
        path = str(tmp_path_factory.mktemp("rows") / "t.parquet")
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return make
