"""Streams over several small batches against the batch operators."""
import calendar
import datetime
import random

from pyspark.sql import functions as F

from jobweave.operators import matching
from jobweave.operators.usage import admit_calls, latest_feedback
from jobweave.streaming import news, results, usage
from tests.test_operators import J_SCHEMA, P_SCHEMA, _random_world


def _arrive(spark, df, path, order, files=4):
    """Write rows in order as several files and read them as a stream, one file per batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)


def test_matches_fill_up_over_batches(spark, tmp_path):
    profiles, jobs = _random_world(4)
    pdf = spark.createDataFrame(profiles, P_SCHEMA)
    jdf = spark.createDataFrame(jobs, J_SCHEMA)
    stream = _arrive(spark, jdf, str(tmp_path / "in"), ["source_order", "rank", "url"])
    folder = str(tmp_path / "run")
    results.stream_matches(pdf, stream, folder).awaitTermination()
    got = {(r.profile_id, r.pos, r.url) for r in results.matches_of(pdf, folder).collect()}
    assert got == {(r.profile_id, r.pos, r.url) for r in matching.match(pdf, jdf).collect()}
    results.stream_matches(pdf, stream, folder).awaitTermination()
    assert results.matches_of(pdf, folder).count() == len(got)


def test_a_url_that_arrives_again_takes_no_second_place(spark, tmp_path):
    profiles = spark.createDataFrame([(1, 7, 5, "A", False)], P_SCHEMA)
    urls = ["a", "a", "b", "c", "b", "a", "d", "c", "e", "f", "g", "h", "i", "j", "k", "l"]
    jobs = spark.createDataFrame([(7, 0, i, u, False, False, None, "A", False, True) for i, u in enumerate(urls)], J_SCHEMA)
    results.stream_matches(profiles, _arrive(spark, jobs, str(tmp_path / "in"), ["rank"]), str(tmp_path / "run")).awaitTermination()
    got = sorted((r.pos, r.url) for r in results.matches_of(profiles, str(tmp_path / "run")).collect())
    assert got == list(enumerate("abcdefghij", 1))


def test_quota_over_batches(spark, tmp_path):
    rng, t0 = random.Random(9), datetime.datetime(2024, 1, 1)
    calls = [(i, t0 + datetime.timedelta(minutes=5 * i), rng.choice("aab"), rng.random() < 0.8) for i in range(600)]
    df = spark.createDataFrame(calls, "call_id int, ts timestamp, service string, ok boolean")
    limits = {"a": 60, "b": 20}
    usage.stream_quota(_arrive(spark, df, str(tmp_path / "in"), ["ts"]), str(tmp_path / "run"), limits).awaitTermination()
    got = {r.call_id: r.admitted for r in spark.read.parquet(str(tmp_path / "run" / "calls")).collect()}
    assert got == {r.call_id: r.admitted for r in admit_calls(df, limits).collect()}
    assert False in got.values()


def test_a_day_that_is_over_frees_its_state(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    calls = [(i, t0 + datetime.timedelta(hours=i), "ab"[i % 2], True) for i in range(24 * 12)]
    calls.append((9_000, t0, "a", True))  # arrives with the last batch, eleven days late
    df = spark.createDataFrame(calls, "call_id int, ts timestamp, service string, ok boolean")
    folder = str(tmp_path / "run")
    usage.stream_quota(_arrive(spark, df, str(tmp_path / "in"), ["call_id"], files=6), folder, {"a": 10, "b": 10}).awaitTermination()
    got = {r.call_id: r.admitted for r in spark.read.parquet(f"{folder}/calls").collect()}
    want = {r.call_id: r.admitted for r in admit_calls(df.where("call_id < 9000"), {"a": 10, "b": 10}).collect()}
    assert got == want and False in want.values()
    states = [spark.read.parquet(str(p)) for p in (tmp_path / "run" / "state").iterdir()]
    assert len(states) <= 2 and all(s.select("day").distinct().count() <= 2 for s in states)


def test_close_holds_in_later_batches(spark, tmp_path):
    rng, t0 = random.Random(3), datetime.datetime(2024, 1, 1)
    lines = [(0 if rng.random() < 0.5 else rng.randrange(6), i, "event: close" if rng.random() < 0.05 else "data: {}", t0 + datetime.timedelta(seconds=i)) for i in range(400)]
    df = spark.createDataFrame(lines, "session_id bigint, line_no bigint, line string, ts timestamp")
    results.stream_cut(_arrive(spark, df, str(tmp_path / "in"), ["line_no"]), str(tmp_path / "run")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "run" / "lines")).select("session_id", "line_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, results.cut_at_close(df).select("session_id", "line_no").collect()))


def test_idle_sessions_end_and_late_lines_are_dropped(spark, tmp_path):
    def at(hour):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)

    batches = [[(1, 0, "data: a", at(0)), (1, 1, "event: close", at(0)), (2, 0, "data: b", at(0))], [(1, 2, "data: closed", at(1)), (2, 1, "data: c", at(9))],
               [(2, 2, "data: d", at(20))], [(1, 3, "data: new session", at(21)), (2, 3, "data: late", at(2))]]
    rows = [r for b in batches for r in b]
    schema = "session_id bigint, line_no bigint, line string, ts timestamp"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    results.stream_cut(stream, str(tmp_path / "run"), "1 hour", 5 * 3_600_000).awaitTermination()
    got = {r.line for r in spark.read.parquet(str(tmp_path / "run" / "lines")).collect()}
    assert got == {r[2] for r in rows} - {"event: close", "data: closed", "data: late"}


def test_last_vote_over_batches(spark, tmp_path):
    rng, t0 = random.Random(6), datetime.datetime(2024, 1, 1)
    votes = [(i, t0 + datetime.timedelta(minutes=rng.randrange(900)), f"k{rng.randrange(9)}", rng.choice(["up", "down"])) for i in range(300)]
    df = spark.createDataFrame(votes, "event_id int, ts timestamp, profile_key string, vote string")
    usage.write_feedback(_arrive(spark, df, str(tmp_path / "in"), ["event_id"]), str(tmp_path / "run")).awaitTermination()
    assert sorted(map(tuple, usage.read_feedback(spark, str(tmp_path / "run")).collect())) == sorted(map(tuple, latest_feedback(df).collect()))


def test_kinds_of_lines(spark):
    lines = ["data: {}", 'data: {"error":"x"}', 'data: {"id":"1"}', 'data: {"status":"s"}', 'data: {"id": 0}', 'data: {"id": "0"}',
             'data: {"error": "", "company": "c"}', "data: ", "data: {oops", "event: close", "", "data: null", 'data: {"error": null}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    got = {r.n: r.kind for r in results.parse_result_stream(df).collect()}
    assert got == {1: "error", 2: "job", 3: "status", 4: "status", 5: "job", 6: "job", 12: "status"}


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    days = [0, 5, 6, 0, 12]
    rows = [(i, t0 + datetime.timedelta(days=d, hours=i), "a", True) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "call_id int, ts timestamp, service string, ok boolean")
    windows = usage.usage_windows(_arrive(spark, df, str(tmp_path / "in"), ["call_id"], files=5))
    (windows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("day").collect()
    assert [(str(r.day), r.used) for r in got] == [("2024-01-01", 1), ("2024-01-06", 1), ("2024-01-07", 1)]


def test_first_url_wins_in_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, "u", t0, 0), (1, "v", t0, 1), (1, "u", t0 + datetime.timedelta(hours=2), 2), (2, "u", t0, 3)]
    df = spark.createDataFrame(rows, "query_id int, url string, ts timestamp, n int")
    once = results.stream_dedupe(_arrive(spark, df, str(tmp_path / "in"), ["n"], files=2))
    (once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 3]


def test_news_stream_counts_each_item_wherever_it_comes(spark, tmp_path):
    rng, day = random.Random(5), datetime.datetime(2024, 1, 1)

    def at(i):  # times within few days of each other, in no order; items also come after their requests
        return day + datetime.timedelta(days=i + rng.randrange(-30, 30), hours=rng.choice([0, 9, 12, 15]))

    items = [(i, f"c{0 if rng.random() < .6 else rng.randrange(3)}", f"t{i}", at(i)) for i in range(300)]
    items += items[40:43] + [(400 + i, "c0", f"s{i}", day + datetime.timedelta(days=60, hours=9 + i)) for i in range(6)]
    asked = [(i, f"c{rng.randrange(4)}", at(2 * i)) for i in range(150)] + [(200 + i, "c0", day + datetime.timedelta(days=60, hours=8 + i)) for i in range(8)]
    idf = spark.createDataFrame(items, "news_id int, company string, title string, published_at timestamp")
    adf = spark.createDataFrame(asked, "request_id int, company string, asked_at timestamp")
    run = str(tmp_path / "run")
    news.stream_news(_arrive(spark, adf, str(tmp_path / "asked"), F.hash("request_id")), _arrive(spark, idf, str(tmp_path / "news"), F.hash("title")),
                     run, delay="4000 days").awaitTermination()

    def first(d):
        y, m = divmod(d.year * 12 + d.month - 1 - 6, 12)
        return datetime.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))

    want = {}
    for r, c, t in asked:
        near = sorted((x for x in items if x[1] == c and x[3] <= t and x[3].date() > first(t.date())), key=lambda x: (-x[3].toordinal(), x[0]))
        want.update({(r, p + 1): x[0] for p, x in enumerate(near[:3])})
    got = [((r.request_id, r.pos), r.news_id) for r in news.newest_of(spark, run).collect()]
    assert dict(got) == want and len(got) == len(want)
    per_batch = spark.read.parquet(f"{run}/pairs").groupBy("request_id", "batch").count().agg(F.max("count")).first()[0]
    assert per_batch <= 6  # 3 newest of each side of a batch, not every item of the six months


def test_late_news_are_dropped_and_old_months_freed(spark, tmp_path):
    day = datetime.datetime(2020, 1, 15)
    step = [day + datetime.timedelta(days=200 * i) for i in range(6)]
    asked = spark.createDataFrame([(i, "c", d, i) for i, d in enumerate(step)], "request_id int, company string, asked_at timestamp, o int")
    rows = [(i, "c", f"t{i}", d, i) for i, d in enumerate(step[:4])] + [(8, "c", "late", day, 4), (9, "c", "t9", step[5], 5)]
    items = spark.createDataFrame(rows, "news_id int, company string, title string, published_at timestamp, o int")
    run = str(tmp_path / "run")
    news.stream_news(_arrive(spark, asked, str(tmp_path / "asked"), ["o"], 6), _arrive(spark, items, str(tmp_path / "news"), ["o"], 6), run).awaitTermination()
    assert {(r.request_id, r.news_id) for r in news.newest_of(spark, run).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 9)}
    kept = spark.read.parquet(f"{run}/rows")
    assert kept.filter("news_id = 8").count() == 0
    assert kept.agg(F.min("at")).first()[0] > step[1]


def test_requests_and_news_are_merged_without_a_join(spark):
    """Items of a request's own day stand before it in the same order; those of no day and no company meet nothing."""
    from jobweave.operators.contacts import newest_before
    asked = spark.createDataFrame([(1, "a", "2024-03-05 12:00:00"), (2, "a", "2024-03-05 00:00:00"), (3, "a", "2024-03-06 00:00:00"), (4, "b", "2024-03-05 12:00:00"),
                                   (5, None, "2024-03-05 12:00:00"), (6, "a", None)], "request_id int, company string, asked_at string")
    news = spark.createDataFrame([(10, "a", "x", "2024-03-05 11:00:00"), (11, "a", "x", "2024-03-05 12:00:01"), (12, "a", "x", "2024-03-05 12:00:00"), (13, "a", "x", "2024-03-04 23:00:00"),
                                  (14, "a", "x", "2024-01-31 00:00:00"), (15, None, "x", "2024-03-05 11:00:00"), (16, "b", "x", None)], "news_id int, company string, title string, published_at string")
    found = newest_before(asked.withColumn("asked_at", F.col("asked_at").cast("timestamp")), news.withColumn("published_at", F.col("published_at").cast("timestamp")))
    assert {r.request_id: [n.news_id for n in r.news] for r in found.collect()} == {1: [10, 12, 13], 2: [13, 14], 3: [10, 11, 12], 4: [], 5: [], 6: []}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_stream_are_not_kept_twice(spark, tmp_path):
    import os
    from urllib.parse import urlparse
    from jobweave.checks.registry import in_parts
    kept = urlparse(spark.sparkContext.getCheckpointDir()).path
    before = {f for f in os.listdir(kept) if f.startswith("parts-")}
    rows = in_parts(spark.range(100), str(tmp_path), "id", 2)
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/in").count() == 100
    assert {f for f in os.listdir(kept) if f.startswith("parts-")} == before
