"""Checks of the streams: each runs over the tables until all is read and must equal the batch result."""
from pyspark.sql import functions as F

from jobweave.checks import sql as o
from jobweave.checks.q_discovery import VIEWS, _jobs, _profiles
from jobweave.checks.q_usage import ADMITTED, LIMITS
from jobweave.checks.registry import in_parts, query
from jobweave.session import work_folder, written
from jobweave.streaming import results, usage

KINDS = """o_kinds AS (
  SELECT session_id, line_no, trim(substr(line, 7)) AS payload FROM v_sse_lines WHERE line LIKE 'data: %'),
o_typed AS (
  SELECT session_id, line_no, payload, CASE WHEN coalesce(payload->>'$.error', '') NOT IN ('', '0', 'false') THEN 'error'
         WHEN coalesce(payload->>'$.id', '') NOT IN ('', '0', 'false') OR coalesce(payload->>'$.company', '') NOT IN ('', '0', 'false') THEN 'job'
         ELSE 'status' END AS kind
  FROM (SELECT * FROM o_kinds WHERE payload NOT IN ('', '{}') AND json_valid(payload)))"""

CUT = """o_cut AS (
  SELECT r.* FROM v_sse_lines r LEFT JOIN (SELECT session_id, min(line_no) AS closed FROM v_sse_lines WHERE line LIKE 'event: close%' GROUP BY ALL) c
  ON r.session_id = c.session_id WHERE closed IS NULL OR line_no < closed)"""


def _stream(spark, sf_dir: str, table: str, view_sql: str, options: dict | None = None):
    """A table read as a stream, shaped by the SQL of one of the views over it."""
    rows = (spark.readStream.schema(spark.table(table).schema).option("pathGlobFilter", f"{table}.parquet")
            .options(**(options or {})).parquet(sf_dir))
    return spark.sql(view_sql.replace(f"FROM {table}", "FROM {source}"), source=rows)


def _events(spark, sf_dir, view_name):
    from jobweave.checks.views import VIEWS as SQL
    sql = SQL[view_name]
    braces = sql.replace("{", "{{").replace("}", "}}")
    stream = _stream(spark, sf_dir, "events", braces)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def _run(stream, folder: str, mode: str = "append"):
    """Write a stream to files until all is read, and read them back."""
    (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(o.ctes(KINDS, views=("v_sse_lines",)) + "SELECT session_id, line_no, kind, payload FROM o_typed")
def typed_result_stream(view, spark, sf_dir):
    """W-01"""
    view("events")
    typed = results.parse_result_stream(_events(spark, sf_dir, "v_sse_lines"))
    return _run(typed.select("session_id", "line_no", "kind", "payload"), work_folder(spark, "typed"))


@query(o.ctes(CUT, views=("v_sse_lines",)) + "SELECT session_id, line_no, line FROM o_cut")
def lines_before_close(view, spark, sf_dir):
    """W-02 on a table"""
    return results.cut_at_close(view("v_sse_lines")).select("session_id", "line_no", "line")


@query(o.ctes(CUT, views=("v_sse_lines",)) + "SELECT session_id, line_no, line FROM o_cut")
def stream_before_close(view, spark, sf_dir):
    """W-02 on a stream of four batches, in order of the lines; sessions stay open as long as the table lasts."""
    folder = work_folder(spark, "cut")
    lines = view("v_sse_lines").withColumn("ts", F.col("ts").cast("timestamp"))
    results.stream_cut(in_parts(lines, folder, "line_no"), folder, "400 days", 400 * 86_400_000).awaitTermination()
    return spark.read.parquet(f"{folder}/lines").select("session_id", "line_no", "line")


@query(o.ctes(views=("v_api_calls",)) + """SELECT CAST(ts AS DATE)::VARCHAR AS day, service, count(*) AS used FROM v_api_calls
WHERE ok GROUP BY ALL""")
def daily_usage_stream(view, spark, sf_dir):
    """W-03: all days, those still open included."""
    folder = work_folder(spark, "windows")
    usage.write_usage(_events(spark, sf_dir, "v_api_calls"), folder).awaitTermination()
    return usage.read_usage(spark, folder).withColumn("day", F.col("day").cast("string"))


@query(o.ctes(views=("v_api_calls",)) + "SELECT DISTINCT query_id, url FROM (SELECT user_id % 50 AS query_id, 'https://x.example/' || event_type || '/' || (event_id % 40) AS url FROM events)")
def stream_first_urls(view, spark, sf_dir):
    """W-04: the delay spans the whole table, so that every (query, URL) comes out once."""
    sql = ("SELECT user_id % 50 AS query_id, CONCAT('https://x.example/', event_type, '/', event_id % 40) AS url, "
           "CAST(ts AS timestamp) AS ts FROM events")
    view("events")
    once = results.stream_dedupe(_stream(spark, sf_dir, "events", sql), "400 days")
    return _run(once.select("query_id", "url"), work_folder(spark, "dedupe"))


@query(o.ctes(o.MATCHES, views=VIEWS) + "SELECT profile_id, pos, url FROM o_matches")
def stream_of_matches(view, spark, sf_dir):
    """W-05: results arrive in four batches by the order of their sources and ranks, with some of the first ones again."""
    folder = work_folder(spark, "matches")
    jobs = written(_jobs(view).withColumn("place", F.col("source_order") * 10_000_000_000 + F.col("rank")), "jobs")
    again = jobs.filter(F.col("rank") % 5 == 0).withColumn("place", F.col("place") + 15_000_000_000)
    profiles = _profiles(view)
    results.stream_matches(profiles, in_parts(jobs.unionByName(again), folder, "place"), folder).awaitTermination()
    return results.matches_of(profiles, folder).select("profile_id", F.col("pos").cast("bigint").alias("pos"), "url")


@query(o.ctes(ADMITTED.replace("ELSE 60 END", "ELSE 1000 END"), views=("v_api_calls",)) + "SELECT call_id, service, admitted FROM o_admitted")
def quota_stream(view, spark, sf_dir):
    """W-06: four batches in order of time."""
    folder = work_folder(spark, "quota")
    calls = view("v_api_calls").withColumn("ts", F.col("ts").cast("timestamp"))
    usage.stream_quota(in_parts(calls.orderBy("ts"), folder, "ts"), folder, LIMITS).awaitTermination()
    return spark.read.parquet(f"{folder}/calls").select("call_id", "service", "admitted")


@query(o.ctes(views=("v_feedback",)) + "SELECT profile_key, arg_max(vote, (ts, event_id)) AS vote FROM v_feedback GROUP BY profile_key")
def feedback_stream(view, spark, sf_dir):
    """W-07"""
    folder = work_folder(spark, "votes")
    usage.write_feedback(_events(spark, sf_dir, "v_feedback"), folder).awaitTermination()
    return usage.read_feedback(spark, folder)
