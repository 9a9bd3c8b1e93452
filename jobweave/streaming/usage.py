"""Streams of service calls and of votes."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobweave import fixed
from jobweave.operators.usage import admit_calls
from jobweave.session import remove
from jobweave.streaming.results import _previous, start


def usage_windows(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """W-03: good calls per day and service; rows later than `delay` are dropped."""
    return (calls.filter("ok").withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "service")
            .agg(F.count("*").alias("used"))
            .select(F.to_date("window.start").alias("day"), "service", "used"))


def write_usage(calls: DataFrame, folder: str, delay: str = "1 day") -> StreamingQuery:
    """W-03: the counts that each batch changed, days still open included, below `folder`/used; see `read_usage`."""
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/used/batch={n}")

    return (usage_windows(calls, delay).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())


def read_usage(spark, folder: str) -> DataFrame:
    """Good calls per day and service, as counted so far."""
    return spark.read.parquet(f"{folder}/used").groupBy("day", "service").agg(F.max_by("used", "batch").alias("used"))


def stream_quota(calls: DataFrame, folder: str, limits: dict[str, int] = fixed.DAILY_LIMITS,
                 share: float = fixed.STOP_SHARE, delay_days: int = 1) -> StreamingQuery:
    """W-06: calls with flag `admitted`, written below `folder`/calls; the count starts anew every day.

    The state is the number of good calls per (day, service). Days that end more than `delay_days` before the newest call's
    day are over: their state is freed, and calls that still arrive for them are late and dropped. So the state holds
    `delay_days` + 1 days, however long the stream runs. Calls of a batch are taken in time order, in parallel inside a hot
    day and service too (`admit_calls`). A batch that is run again overwrites only what it wrote itself.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        used = _previous(spark, f"{folder}/state", n, "day date, service string, used bigint")
        over = used.agg(F.max("day")).first()[0]  # as the batches before left it, so that a batch's own order does not matter
        if over is not None:
            batch = batch.filter(F.to_date("ts") >= F.date_sub(F.lit(over), delay_days))
        admit_calls(batch, limits, share, used=used).write.mode("overwrite").parquet(f"{folder}/calls/batch={n}")
        new = (batch.groupBy(F.to_date("ts").alias("day"), "service").agg(F.count_if("ok").alias("used")))
        counts = used.unionByName(new).groupBy("day", "service").agg(F.sum("used").alias("used"))
        newest = counts.agg(F.max("day").alias("newest"))
        (counts.crossJoin(newest).filter(F.col("day") >= F.date_sub("newest", delay_days)).drop("newest")  # one row
         .coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={n}"))
        if n > 1:
            remove(spark, f"{folder}/state/batch={n - 2}")

    return start(calls, folder, write)


def stream_feedback(votes: DataFrame) -> DataFrame:
    """W-07: the last vote per key so far; run it in update mode."""
    return votes.groupBy("profile_key").agg(F.max_by(F.struct("vote", "ts", "event_id"), F.struct("ts", "event_id")).alias("last"))


def write_feedback(votes: DataFrame, folder: str) -> StreamingQuery:
    """W-07: changed keys of each batch below `folder`/votes; `read_feedback` gives the last vote of each."""
    def write(batch: DataFrame, n: int) -> None:
        batch.select("profile_key", "last.*").write.mode("overwrite").parquet(f"{folder}/votes/batch={n}")

    return (stream_feedback(votes).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())


def read_feedback(spark, folder: str) -> DataFrame:
    """The last vote per key, as written so far."""
    rows = spark.read.parquet(f"{folder}/votes")
    return rows.groupBy("profile_key").agg(F.max_by("vote", "batch").alias("vote"))
