import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from docketscope.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over literal inputs: one(lambda a: f(a), "text")."""
    from pyspark.sql import functions as F

    def run(build, *values):
        names = [f"c{i}" for i in range(len(values))]
        schema = ", ".join(
            f"{n} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}"
            for n, v in zip(names, values, strict=True)
        )
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(build(*[F.col(n) for n in names]).alias("r")).first()["r"]

    return run
