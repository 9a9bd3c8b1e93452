"""Logs of model calls and of draft attempts."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions import call_outcome, clean_output, draft_body, draft_check, is_json


def parse_outputs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """F-14: cleaned output, whether it is JSON, and an error with the cleaned text where it is not."""
    out = df.withColumn("content", clean_output(F.col(raw))).withColumn("parsed", is_json(F.col("content")))
    return out.withColumn("error", F.when(~F.col("parsed"), "Failed to parse JSON"))


def classify_attempts(log: DataFrame) -> DataFrame:
    """F-19 for a log with columns `status, error, raw`."""
    return log.withColumn("outcome", call_outcome(F.col("status"), F.col("error"), F.col("raw")))


# What an attempt log can show that the retry rule does not allow, in the order in which it is listed.
VIOLATIONS = ["skipped model", "models mixed", "after limit", "after success", "no reason to retry", "not retried", "third attempt"]


def _per_model(log: DataFrame, seq: str | None) -> DataFrame:
    """What the rule needs to know of the attempts with one model, all of it sums and extremes, so it adds up on the map side."""
    order = F.struct("model_no", "attempt_no")
    tried = classify_attempts(log)
    good = F.col("outcome") == "ok"
    again = F.coalesce(F.col("status").isin(*fixed.RETRY_STATUS) | (F.col("outcome") == "request"), F.lit(False))
    place = F.col(seq) if seq else F.lit(None).cast("long")
    return tried.groupBy("request_id", "model_no").agg(
        F.count("*").alias("n"), F.min_by(again, "attempt_no").alias("first_again"), F.min_by(good, "attempt_no").alias("first_ok"),
        F.max(F.col("outcome") == "limit").alias("limited"), F.min(F.when(good, order)).alias("first_good"),
        F.min_by(F.when(good, clean_output(F.col("raw"))), F.when(good, order)).alias("payload"),
        F.max(order).alias("last"), F.max_by("outcome", order).alias("last_outcome"), F.min(place).alias("from_seq"), F.max(place).alias("to_seq"))


def _violations(per_model: DataFrame) -> DataFrame:
    """request_id and the broken rules of each request; models are few, so they meet in order."""
    before = Window.partitionBy("request_id").orderBy("model_no")
    mixed = F.coalesce(F.lag("to_seq").over(before) > F.col("from_seq"), F.lit(False))
    found = per_model.withColumn("mixed", mixed).groupBy("request_id").agg(
        F.when((F.min("model_no") != 0) | (F.max("model_no") + 1 != F.count("*")), VIOLATIONS[0]).alias("v0"),
        F.when(F.max("mixed"), VIOLATIONS[1]).alias("v1"),
        F.when(F.max("limited") & (F.sum("n") > 1), VIOLATIONS[2]).alias("v2"),
        F.when(F.min("first_good") < F.max("last"), VIOLATIONS[3]).alias("v3"),
        F.when(F.max((F.col("n") > 1) & ~F.col("first_again") & ~F.col("first_ok")), VIOLATIONS[4]).alias("v4"),
        F.when(F.max((F.col("n") == 1) & F.col("first_again")), VIOLATIONS[5]).alias("v5"),
        F.when(F.max(F.col("n") > 2), VIOLATIONS[6]).alias("v6"))
    return found.select("request_id", F.concat_ws(", ", *[f"v{i}" for i in range(len(VIOLATIONS))]).alias("violations"))


def attempt_violations(log: DataFrame, seq: str | None = None) -> DataFrame:
    """N-05: the rules that each request's log breaks, joined; empty for a legal log.

    Models are numbered from 0 and tried in that order, each at most twice, the second time if and only if the first failed
    with a status worth retrying or a generic error; nothing follows a success, and a paused service has one row only. With
    `seq`, a column that orders the log, models must not mix in it either.
    """
    return _violations(_per_model(log, seq))


def resolve_attempts(log: DataFrame, seq: str | None = None) -> DataFrame:
    """N-05: per request the first success by (model, attempt), else the outcome of the last attempt.

    `log_ok` tells whether the log itself keeps the retry rule (`attempt_violations`). `attempt_no` only has to rise within a
    model. Everything is an aggregate, so a request with very many attempts is combined before the shuffle.
    """
    per_model = _per_model(log, seq)
    resolved = per_model.groupBy("request_id").agg(
        F.min_by("payload", "first_good").alias("payload"),
        F.when(F.min("first_good").isNull(), F.max_by("last_outcome", "last")).alias("error"), F.sum("n").alias("attempts"))
    return resolved.join(_violations(per_model).select("request_id", (F.col("violations") == "").alias("log_ok")), "request_id")


def choose_draft(drafts: DataFrame) -> DataFrame:
    """N-06: attempt 1 where it has its intent line, else attempt 2 whatever it holds."""
    def of(n: int):
        return F.max(F.when(F.col("attempt") == n, F.struct(
            F.coalesce("has_intent_line", F.lit(False)).alias("has_intent_line"), "subject",
            draft_body(F.col("body"), F.col("email")).alias("body"), "critique_notes")))
    both = drafts.groupBy("request_id").agg(of(1).alias("first"), of(2).alias("second"))
    return (both.withColumn("chosen", F.when(F.col("first.has_intent_line"), F.col("first")).otherwise(F.col("second")))
            .select("request_id", *[F.coalesce(f"chosen.{c}", F.lit("")).alias(c)
                                    for c in ("subject", "body", "critique_notes")],
                    F.coalesce("chosen.has_intent_line", F.lit(False)).alias("has_intent_line")))


def check_drafts(drafts: DataFrame) -> DataFrame:
    """F-15: names of the broken rules per draft."""
    return drafts.withColumn("broken_rules", draft_check(F.col("body"), F.col("has_intent_line")))
