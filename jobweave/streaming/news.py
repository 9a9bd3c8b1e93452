"""News of requests as both arrive."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobweave import fixed
from jobweave.operators.contacts import _month, newest_before
from jobweave.operators.ordered import top_k
from jobweave.session import dropping_shuffles, remove
from jobweave.streaming.results import _previous, start

STATE = "asked timestamp, published timestamp"


def _months(spark: SparkSession, folder: str, kind: str) -> list[tuple[int, str]]:
    """The months of one kind of rows that are kept, with their folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows/batch=*/kind={kind}/month=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [(int(f.getPath().getName().split("=")[1]), f.getPath().toString()) for f in found or []]


def stream_news(requests: DataFrame, news: DataFrame, folder: str, months: int = 6, delay: str = "1 day", k: int = fixed.MAX_NEWS) -> StreamingQuery:
    """J-04 on streams: (request, item) for the k newest items of the request's company in the months before it, below `folder`/pairs.

    `requests` has `request_id, company, asked_at`, `news` has `news_id, company, title, published_at`, both with timestamps.
    Rows that come more than `delay` behind the newest of the stream that is less far are late and dropped. Rows that came are kept
    by month: a batch brings its requests together with the items they may reach, and its items with the earlier requests that
    reach them, and reads no other months. Months are deleted by the watermark: of items once no request can reach back to
    them, of requests once no earlier item can come. An item may also come after its request, so a request has up to k items of
    each batch that has news for it; `newest_of` gives the first k. A batch that is run again overwrites only its own output.
    """
    asked = requests.select(F.lit("asked").alias("kind"), "company", F.col("asked_at").alias("at"), "request_id")
    items = news.select(F.lit("news").alias("kind"), "company", F.col("published_at").alias("at"), "news_id", "title")
    both = asked.unionByName(items, allowMissingColumns=True).withColumn("month", _month(F.col("at")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        seen = _previous(spark, f"{folder}/state", n, STATE).first()
        late = F.least(F.lit(seen.asked), F.lit(seen.published)) - F.expr(f"INTERVAL {delay}") if seen and seen.asked and seen.published else F.lit(None)
        (batch.filter("company is not null and at is not null").filter(F.coalesce(F.col("at") >= late, F.lit(True)))
         .write.mode("overwrite").partitionBy("kind", "month").parquet(f"{folder}/rows/batch={n}"))
        own = spark.read.schema(schema).parquet(f"{folder}/rows/batch={n}")
        newest = {r["kind"]: r for r in own.groupBy("kind").agg(F.max("at").alias("at"), F.min("month").alias("low"), F.max("month").alias("high")).collect()}

        def rows(kind: str, table: DataFrame) -> DataFrame:
            id_, at = ("request_id", "asked_at") if kind == "asked" else ("news_id", "published_at")
            return table.filter(F.col("kind") == kind).select(id_, "company", F.col("at").alias(at), *(["title"] if kind == "news" else []))

        def kept(kind: str, low: int, high: int) -> DataFrame:
            """Rows of earlier batches in a range of months."""
            table = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/rows")
            return rows(kind, table.filter(F.col("batch") < n).filter(F.col("month").between(low, high)))

        met = []
        if "asked" in newest:
            reach = kept("news", newest["asked"].low - months, newest["asked"].high)
            met.append(newest_before(rows("asked", own), rows("news", own).unionByName(reach), months, k))
        if "news" in newest:
            waiting = kept("asked", newest["news"].low, newest["news"].high + months)
            met.append(newest_before(waiting, rows("news", own), months, k))
        for i, found in enumerate(met or [None]):
            if found is not None:
                pairs = found.select("request_id", "asked_at", "company", F.explode("news").alias("n")).select("request_id", "asked_at", "company", "n.*")
                with dropping_shuffles(spark):
                    pairs.write.mode("append" if i else "overwrite").parquet(f"{folder}/pairs/batch={n}")
        state = spark.range(1).select(*[
            F.greatest(F.lit(seen[c] if seen else None), F.lit(newest[kind].at if kind in newest else None)).cast("timestamp").alias(c)
            for c, kind in (("asked", "asked"), ("published", "news"))])
        state.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={n}")
        bound = spark.range(1).select(_month(late).alias("m")).first().m if seen and seen.asked and seen.published else None
        if bound is not None:
            gone = [p for m, p in _months(spark, folder, "news") if m < bound - months] + [p for m, p in _months(spark, folder, "asked") if m < bound]
            remove(spark, *gone, f"{folder}/state/batch={n - 2}")

    return start(both, folder, write)


def newest_of(spark: SparkSession, folder: str, k: int = fixed.MAX_NEWS) -> DataFrame:
    """The k newest items of each request found by `stream_news` so far, numbered by `pos`; a batch has at most k for a request."""
    return top_k(spark.read.parquet(f"{folder}/pairs"), ["request_id"], [F.desc(F.to_date("published_at")), F.asc("news_id")], k)
