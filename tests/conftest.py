import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TEST_MEMORY", "8g"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


CELLS = "source string, sheet string, row int, col int, value string, value_type string"


@pytest.fixture(scope="session")
def make_cells(spark):
    """Cells from rows ``(row, col, value)`` of one sheet."""

    def make(rows, sheet="s", source="b.xlsx", kind="text"):
        full = [(source, sheet, r, c, v, kind if v is not None else None) for r, c, v in rows]
        cells = spark.createDataFrame(full, CELLS)
        from gridsieve.functions.refs import a1
        from pyspark.sql import functions as F

        return cells.withColumn("cell_ref", a1(F.col("row"), F.col("col"))).withColumn(
            "formula", F.lit(None).cast("string")
        )

    return make


@pytest.fixture(scope="session")
def make_queries(spark):
    def make(*queries):
        return spark.createDataFrame(list(enumerate(queries, 1)), "query_id int, query string")

    return make
