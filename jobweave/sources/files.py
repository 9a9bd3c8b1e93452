"""Usage log, request files and result sink."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CALLS = "call_id bigint, ts timestamp, service string, ok boolean"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """S-03: files below a folder whose names end in `.pdf`, as binary rows; decoding is left to the caller."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def write_batch(df: DataFrame, path: str, batch: str | int, source: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Rows as one batch of a growing table; written again, a batch replaces itself, so a repeated write leaves one copy.

    A write that dies midway leaves no `_SUCCESS`, and `committed` passes such a batch over until it is written again.
    """
    df.write.mode("overwrite").format(source).partitionBy(*by).save(f"{path.rstrip('/')}/batch={batch}")


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of all batches at a path that were written to their end."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def append_calls(calls: DataFrame, path: str, batch: str | int) -> None:
    """S-08: add calls to the usage log as a batch of that name, one folder per day in it (see `write_batch`)."""
    write_batch(calls.withColumn("day", F.to_date("ts")), path, batch, by=("day",))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """S-08: the usage log, whole batches only; a log that does not exist yet is empty."""
    schema, whole = CALLS + ", day date", committed(spark, path)
    if not whole:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*whole).drop("batch")


def read_call_lines(spark: SparkSession, path: str) -> DataFrame:
    """S-08: a usage log kept as JSON lines; unreadable lines are left out."""
    log = spark.read.schema(CALLS + ", _bad string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_bad").json(path)
    return log.filter(F.col("_bad").isNull() & F.col("service").isNotNull()).drop("_bad")


def to_lines(df: DataFrame) -> DataFrame:
    """S-07: each row as one line of JSON, framed as `data: ...` plus an empty line."""
    return df.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("value"))


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S-07: rows as JSON files; what lies at the path stays unless `mode` says otherwise."""
    df.write.mode(mode).json(path)


def stream_results(rows: DataFrame, folder: str) -> StreamingQuery:
    """S-07 on a stream: framed lines as text below `folder`/lines, a batch each; a batch that is run again leaves one copy."""
    def write(batch: DataFrame, n: int) -> None:
        write_batch(batch, f"{folder}/lines", n, "text")

    return (to_lines(rows).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start())


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The framed lines that `stream_results` wrote, whole batches only."""
    whole = committed(spark, f"{folder}/lines")
    if not whole:
        return spark.createDataFrame([], "value string")
    return spark.read.text(whole).where("value <> ''").select(F.concat("value", F.lit("\n\n")).alias("value"))
