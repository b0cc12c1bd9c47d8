import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression built from literal columns a, b, ... of one row."""

    def run(build, *values, schema=None):
        names = [chr(ord("a") + i) for i in range(len(values))]
        ddl = schema or ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(values)], ddl)
        return df.select(build(*names).alias("out")).first().out

    return run
