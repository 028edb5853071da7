import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column built from named value lists; results in input order."""
    from pyspark.sql import functions as F

    def run(build, rows, ddl):
        numbered = [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
        df = spark.createDataFrame(numbered, "_i int, " + ddl)
        names = [c for c in df.columns if c != "_i"]
        found = df.select("_i", build(*[F.col(n) for n in names]).alias("v")).collect()
        return [r.v for r in sorted(found, key=lambda r: r["_i"])]

    return run
