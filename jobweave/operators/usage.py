"""Metering of service calls. `calls` has columns `call_id, ts, service, ok`."""
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed


def _limit(limits: dict[str, int], default: int) -> Column:
    chain = F.when(F.lit(False), F.lit(default))
    for service, limit in limits.items():
        chain = chain.when(F.col("service") == service, F.lit(limit))
    return chain.otherwise(F.lit(default))


def daily_usage(calls: DataFrame, limits: dict[str, int] = fixed.DAILY_LIMITS) -> DataFrame:
    """A-05: good calls per day and service; the known services show 0 on days with other calls."""
    used = (calls.filter("ok").groupBy(F.to_date("ts").alias("day"), "service").agg(F.count("*").alias("used")))
    zeros = used.select("day").distinct().select(
        "day", F.explode(F.array(*map(F.lit, limits))).alias("service"), F.lit(0).cast("bigint").alias("used"))
    return used.unionByName(zeros).groupBy("day", "service").agg(F.sum("used").alias("used"))


def usage_alerts(usage: DataFrame, limits: dict[str, int] = fixed.DAILY_LIMITS,
                 percent: float = fixed.ALERT_PERCENT) -> DataFrame:
    """A-06: known services at or above the alert percentage, with the alert text."""
    share = F.col("used") / F.col("limit") * 100
    text = F.format_string(fixed.ALERT_TEXT, F.upper("service"), F.col("used"), F.col("limit"), F.col("percent"))
    known = usage.filter(F.col("service").isin(*limits)).withColumn("limit", _limit(limits, 1))
    return known.withColumn("percent", share).filter(F.col("percent") >= percent).withColumn("alert", text)


def alert_report(alerts: DataFrame, limits: dict[str, int] = fixed.DAILY_LIMITS) -> DataFrame:
    """A-07: one text per day; a day has at most one alert per known service, in the order of the limits."""
    place = F.array_position(F.array(*map(F.lit, limits)), F.col("service"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), "alert")))
    body = F.array_join(F.transform(ordered, lambda a: a["alert"]), "\n\n")
    head = F.concat(F.lit(fixed.REPORT_HEAD), F.col("day").cast("string"), F.lit("\n\n"))
    return alerts.groupBy("day").agg(body.alias("body")).select("day", F.concat(head, "body").alias("report"))


def admit_calls(calls: DataFrame, limits: dict[str, int] = fixed.DAILY_LIMITS, share: float = fixed.STOP_SHARE,
                default_limit: int = fixed.DEFAULT_LIMIT, used: DataFrame | None = None) -> DataFrame:
    """N-02: flag `admitted`, true while the good calls before it stay below share of the daily limit.

    Usage only grows within a day, so the verdict flips once per (day, service): after the n-th good call that fills the
    share. Good calls are counted per second, a running sum over the at most 86,400 seconds of a day finds the one in
    which the n-th call lies, and only that second's calls are numbered. `used` gives good calls of (day, service) from
    before.
    """
    needed = _limit({s: _calls_to_stop(n, share) for s, n in limits.items()}, _calls_to_stop(default_limit, share))
    key, second = ["day", "service"], F.date_trunc("second", "ts")
    calls = calls.withColumn("day", F.to_date("ts"))
    good = calls.filter("ok").select(*key, "ts", "call_id", second.alias("second"))
    counts = good.groupBy(*key, "second").agg(F.count("*").alias("n"))
    left, open_days = needed, None
    if used is not None:
        before = used.select(*key, F.col("used").alias("_used"))
        counts = counts.join(before, key, "left")
        left = needed - F.coalesce("_used", F.lit(0))
        open_days = before.filter(needed <= F.col("_used")).select(*key, F.lit(True).alias("_full"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("second"))
    flip = (counts.withColumn("_upto", upto).filter((F.col("_upto") >= left) & (F.col("_upto") - F.col("n") < left))
            .select(*key, "second", (left - F.col("_upto") + F.col("n")).alias("_nth")))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("ts", "call_id"))
    last = (good.join(flip, [*key, "second"]).withColumn("_place", place).filter("_place = _nth")
            .select(*key, F.struct("ts", "call_id").alias("_last")))
    flagged = calls.join(last, key, "left")
    admitted = F.coalesce(F.struct("ts", "call_id") <= F.col("_last"), F.lit(True))
    if open_days is not None:
        flagged = flagged.join(open_days, key, "left")
        admitted = admitted & F.col("_full").isNull()
    return flagged.withColumn("admitted", admitted).drop("_last", "_full")


def _calls_to_stop(limit: int, share: float) -> int:
    """Smallest n with n / limit >= share, in the same arithmetic as the admission rule."""
    n = max(math.floor(limit * share) - 1, 0)
    while n / limit < share:
        n += 1
    return n


def pass_rate(df: DataFrame, flag: str, by: tuple = ()) -> DataFrame:
    """A-08: rows, valid rows and their share; an absent flag is not valid."""
    valid = F.count_if(F.col(flag).eqNullSafe(True))
    return df.groupBy(*by).agg(F.count("*").alias("total"), valid.alias("valid")).withColumn(
        "rate", F.col("valid") / F.col("total"))


def latest_feedback(votes: DataFrame) -> DataFrame:
    """A-10: the last vote per key, by time and then event id."""
    return votes.groupBy("profile_key").agg(F.max_by("vote", F.struct("ts", "event_id")).alias("vote"))


def feedback_tally(latest: DataFrame) -> DataFrame:
    """A-10: number of contacts by their last vote."""
    return latest.groupBy("vote").agg(F.count("*").alias("contacts"))
