import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from jobweave.session import configure, use_local_folder
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield use_local_folder(configure(session))
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate an expression over rows given as tuples: column(fn, rows, schema) -> list of values."""
    def run(fn, rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema)
        names = df.columns[1:]
        return [r[0] for r in df.orderBy("_i").select(fn(*[df[n] for n in names])).collect()]
    return run
