"""Matches and news to draft requests."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators.contacts import attach_news
from jobweave.operators.requests import profile_summary


def draft_requests(requests: DataFrame, news: DataFrame, as_of: str) -> DataFrame:
    """What a drafting model needs per request: summary, target and the newest headlines.

    `requests` has `request_id, job_title, actual_years_exp, skills, target_title, company, poc_name`.
    """
    return attach_news(requests, news, as_of).select(
        "request_id", "company", F.col("target_title").alias("job_title"),
        F.coalesce("poc_name", F.lit("Hiring Team")).alias("poc_name"),
        profile_summary(F.col("job_title"), F.col("actual_years_exp"), F.col("skills")).alias("profile_summary"),
        F.array_join("news", "\n").alias("news_snippet"))
