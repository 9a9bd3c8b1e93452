"""Search responses and posting texts."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "array<struct<title:string,link:string,snippet:string>>"
NEWS_ITEM = "array<struct<title:string,link:string,snippet:string,source:string,date:string>>"


def explode_results(df: DataFrame, json_col: str, kind: str = "organic") -> DataFrame:
    """S-01: one row per result of a raw response, with its rank; a response without results gives none."""
    item = NEWS_ITEM if kind == "news" else ITEM
    parsed = F.from_json(F.col(json_col), f"struct<{kind}:{item}>")[kind]
    rest = [c for c in df.columns if c != json_col]
    rows = df.select(*rest, F.posexplode(parsed).alias("rank", "item"))
    extra = [F.col("item.source").alias("source"), F.col("item.date").alias("date")] if kind == "news" else []
    return rows.select(*rest, "rank", F.col("item.link").alias("url"),
                       F.coalesce("item.title", F.lit("")).alias("title"), F.col("item.snippet").alias("snippet"), *extra)


def resolve(urls: DataFrame, primary: DataFrame, fallback: DataFrame, value: str) -> DataFrame:
    """S-05 for what was made of each text: `value` of the text that counts for a URL, null without one.

    LinkedIn pages come from the fallback only, others prefer the primary. `primary` and `fallback` have `url` and `value`, one
    row per URL; the value is null where the text is. Only values go through the joins, so texts need not.
    """
    first = primary.filter(~F.contains(F.col("url"), F.lit("linkedin.com"))).select("url", F.col(value).alias("_first"))
    second = fallback.select("url", F.col(value).alias("_second"))
    return (urls.join(first, "url", "left").join(second, "url", "left")
            .withColumn(value, F.coalesce("_first", "_second")).drop("_first", "_second"))


def resolve_text(urls: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """S-05: posting text per URL, empty without one; whole texts go through the joins (`resolve` for what is read of them)."""
    return resolve(urls, primary, fallback, "text").withColumn("text", F.coalesce("text", F.lit("")))
