"""Registry of queries and of the SQL they are checked against."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.checks.views import tables, view
from jobweave.session import discard, dropping_shuffles, use_local_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (view lookup, session, folder) under its own name."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables(use_local_folder(spark), sf_dir)
            return fn(lambda name: view(spark, name), spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def in_parts(df, folder: str, order: str, parts: int = 4, files: int = 1):
    """Rows written in ranges of a column, one append after the other, and read as a stream of a range per batch."""
    df = written(df, "parts")  # read once for the cuts and once for each part
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    number = sum(((F.col(order) > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    with dropping_shuffles(df.sparkSession):
        for i in range(parts):
            df.filter(number == i).repartition(files).write.mode("append").parquet(f"{folder}/in")
    discard(df)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
