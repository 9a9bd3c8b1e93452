"""Streams of result lines and of search results."""
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from jobweave.functions import py_strip
from jobweave.operators.matching import PROFILE_CLASS, class_matches
from jobweave.session import remove

CLOSE = "event: close"


def parse_result_stream(lines: DataFrame, line: str = "line") -> DataFrame:
    """W-01: kind and payload of each data line; works on tables and on streams.

    Blank and empty-object lines and lines that are no JSON are skipped.
    """
    payload = py_strip(F.substr(F.col(line), F.lit(7)))
    data = F.try_parse_json(payload)

    def given(name: str):
        value = F.to_json(F.try_variant_get(data, f"$.{name}", "variant"))
        return F.coalesce(~value.isin('""', "0", "false", "null"), F.lit(False))

    kind = F.when(given("error"), "error").when(given("id") | given("company"), "job").otherwise("status")
    return (lines.filter(F.col(line).startswith("data: ")).withColumn("payload", payload)
            .filter(~F.col("payload").isin("", "{}", "null") & data.isNotNull()).withColumn("kind", kind))


def cut_at_close(rows: DataFrame) -> DataFrame:
    """W-02 on a table: lines of a session before its first closing line (`session_id, line_no, line`)."""
    closing = rows.filter(F.col("line").startswith(CLOSE)).groupBy("session_id").agg(F.min("line_no").alias("_closed"))
    return (rows.join(closing, "session_id", "left")
            .filter(F.col("_closed").isNull() | (F.col("line_no") < F.col("_closed"))).drop("_closed"))


def stream_dedupe(results: DataFrame, delay: str = "1 day") -> DataFrame:
    """W-04: the first arrival of every (query, URL); `results` has an event time `ts`."""
    return results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query_id", "url"])


def _previous(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    """State as the batch before left it."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch - 1}")


def start(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run `write` on every batch that is available now."""
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start())


def keep_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB on the executors and, as changes per batch, in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SessionCut(StatefulProcessor):
    """Lines before their session's close. The state of a session is where it closed; a timer frees it once it is idle."""

    def __init__(self, idle_ms: int, columns: list[str]):
        self.idle_ms, self.columns = idle_ms, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "line bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(rows)
        closing = batch.loc[batch["line"].str.startswith(CLOSE), "line_no"]
        closed = self.closed.get()[0] if self.closed.exists() else None
        if len(closing):
            closed = int(closing.min()) if closed is None else min(closed, int(closing.min()))
            self.closed.update((closed,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(batch["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield (batch if closed is None else batch[batch["line_no"] < closed])[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.closed.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_cut(lines: DataFrame, folder: str, delay: str = "1 hour", idle_ms: int = 24 * 3_600_000) -> StreamingQuery:
    """W-02 on a stream: lines before their session's close, written below `folder`/lines.

    `lines` has `session_id, line_no, line, ts`. A session is over `idle_ms` after its last line by event time; its state is
    then freed, and a number that comes again begins a new one. Lines that arrive more than `delay` behind the newest line are
    late and dropped. A task holds the lines of one session in one batch.
    """
    keep_in_rocksdb(lines.sparkSession)
    columns = ["session_id", "line_no", "line"]
    schema = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in columns)
    cut = (lines.select(*columns, "ts").withWatermark("ts", delay).groupBy("session_id")
           .transformWithStateInPandas(SessionCut(idle_ms, columns), schema, "append", "EventTime"))
    return (cut.writeStream.format("parquet").option("path", f"{folder}/lines").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start())


def first_arrivals(stream: DataFrame, key: list[str], delay: str = "30 days") -> DataFrame:
    """The first row of each key to arrive; of rows of one key in the same batch any may be it.

    Keys that came before are keyed state in RocksDB: a batch looks up its own keys, whatever the length of the history. Where
    rows have an event time `ts`, a key is forgotten `delay` after it came, and rows later than that are dropped; without one
    all keys are kept.
    """
    keep_in_rocksdb(stream.sparkSession)
    if "ts" in stream.columns:
        return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def stream_matches(profiles: DataFrame, jobs: DataFrame, folder: str, k: int = 10, delay: str = "30 days") -> StreamingQuery:
    """W-05: matches as postings arrive, at most k per profile over the whole stream.

    The first arrival of a (query, URL) counts, as keyed state tells (`first_arrivals`). The number of matches per class of profiles is a table as small as the distinct facts. A
    batch fills each class up to k in its order of arrival; new matches go to `folder`/matches, one row per class, to be
    joined with the profiles by `matches_of`. So a batch's work follows its own rows. A batch that is run again overwrites
    only what it wrote itself.
    """
    state = ", ".join(f"{c} {profiles.schema[c].dataType.simpleString()}" for c in PROFILE_CLASS) + ", found bigint"

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        found = _previous(spark, f"{folder}/state", n, state)
        batch.write.mode("overwrite").parquet(f"{folder}/new/batch={n}")  # the state is read once
        first = spark.read.schema(batch.schema).parquet(f"{folder}/new/batch={n}")
        picked = (class_matches(profiles, first, k).join(found, PROFILE_CLASS, "left")
                  .withColumn("pos", F.col("pos") + F.coalesce("found", F.lit(0))).filter(F.col("pos") <= k).drop("found"))
        picked.write.mode("overwrite").parquet(f"{folder}/matches/batch={n}")
        new = spark.read.schema(picked.schema).parquet(f"{folder}/matches/batch={n}").groupBy(*PROFILE_CLASS).agg(F.count("*").alias("found"))
        (found.unionByName(new).groupBy(*PROFILE_CLASS).agg(F.sum("found").alias("found"))
         .write.mode("overwrite").parquet(f"{folder}/state/batch={n}"))
        remove(spark, f"{folder}/new/batch={n}", *([f"{folder}/state/batch={n - 2}"] if n > 1 else []))

    return start(first_arrivals(jobs, ["query_id", "url"], delay), folder, write)


def matches_of(profiles: DataFrame, folder: str) -> DataFrame:
    """Matches of each profile found by `stream_matches` so far."""
    picked = profiles.sparkSession.read.parquet(f"{folder}/matches")
    return profiles.select("profile_id", *PROFILE_CLASS).join(picked, PROFILE_CLASS)
