"""Experience totals of profiles."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import experience_bucket, role_months

YEARS = "decimal(12,2)"


def experience_by_title(roles: DataFrame, title_given: str | None = None) -> DataFrame:
    """A-01: years per profile and exact title, from role dates; whole months are added up first.

    `title_given` names a flag column that is false where the title field itself is missing; those
    rows count as `Unknown Role`, while a title that is given as null stays null.
    """
    title = F.col("title") if title_given is None else F.when(F.col(title_given), F.col("title")).otherwise("Unknown Role")
    months = role_months(F.col("start_date"), F.col("end_date")).cast("bigint")
    return (roles.groupBy("profile_id", title.alias("title")).agg(F.sum(months).alias("months"))
            .withColumn("years", F.round(F.col("months") / 12, 2).cast(YEARS)))


def total_experience(df: DataFrame, active: str | None = None) -> DataFrame:
    """A-02: sum of the rounded years of the active titles; profiles without any have 0."""
    years = F.col("years") if active is None else F.when(F.col(active), F.col("years"))
    total = F.coalesce(F.sum(years), F.lit(0)).cast(YEARS)
    return (df.groupBy("profile_id").agg(total.alias("total_years"))
            .withColumn("bucket", experience_bucket(F.col("total_years"))))


def bucket_histogram(totals: DataFrame) -> DataFrame:
    """A-03: number of profiles per bucket."""
    return totals.groupBy("bucket").agg(F.count("*").alias("profiles"))


def group_titles(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """F-17: title replaced by its track; `taxonomy` maps exact lower-cased titles to tracks."""
    lookup = taxonomy.select(F.lower("title").alias("_title"), "track").dropDuplicates(["_title"])
    return (df.withColumn("_title", F.lower("title")).join(lookup, "_title", "left")
            .withColumn("title", F.coalesce("track", "title")).drop("_title", "track"))
