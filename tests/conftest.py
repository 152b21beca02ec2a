import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from notelode.shipping import ship

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="notelode-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over literal inputs."""
    from pyspark.sql import functions as F

    def value(build, *inputs):
        frame = spark.createDataFrame(
            [tuple(inputs) + (0,)], ", ".join([f"c{i} {kind(v)}" for i, v in enumerate(inputs)] + ["z int"])
        )
        return frame.select(build(*(F.col(f"c{i}") for i in range(len(inputs)))).alias("x")).first()["x"]

    def kind(v):
        if isinstance(v, list):
            return f"array<{kind(v[0]) if v else 'string'}>"
        return {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}[type(v)]

    return value
