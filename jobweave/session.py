"""Session settings and the shared work folder."""
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the joins rely on: sizes are checked at run time and hot join keys are split.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM compiles no method of over 8000 bytes; steps that need one run as several that it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows go to Python in batches of bounded size, so that long texts don't add up in a worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution with skew handling; dates are read in UTC.

    Small partitions are merged to three for each core at least: with about one, a single one more doubles a stage's time.
    """
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(3 * spark.sparkContext.defaultParallelism))
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder, for stream state and written tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def use_local_folder(spark: SparkSession) -> SparkSession:
    """For tests and benches on one machine: where no shared folder is named, take a new local one. A cluster gets none."""
    unset = not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    if unset and re.match(r"local(\[[^,\]]*(,\s*\d+)?\])?$", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="jobweave-"))
    return spark


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted as soon as it is done: once rows are written, these only take disk."""
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared work folder, for results that several steps read.

    It cuts the lineage: a lost executor costs a re-read, not a new run of what came before.
    """
    path, spark = work_folder(df.sparkSession, name), df.sparkSession
    with dropping_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, wherever they are; one that is not there is no error."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, when nothing reads them any more; others stay."""
    for table in tables:
        if getattr(table, "written_path", None):
            remove(table.sparkSession, table.written_path)
