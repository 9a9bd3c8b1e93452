"""Filters over search results and postings."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave import fixed


def filter_source_urls(df: DataFrame) -> DataFrame:
    """P-01: rows whose URL fits the source that delivered it."""
    url = F.col("url")
    fits = (F.when(F.col("source") == "LinkedIn", F.contains(url, F.lit("linkedin.com/jobs")))
            .when(F.col("source") == "Naukri",
                  F.contains(url, F.lit("naukri.com")) & F.contains(url, F.lit("/job-listings-")))
            .otherwise(url != ""))
    return df.filter(fits)


def min_length(df: DataFrame, col: str, chars: int = fixed.MIN_POSTING_CHARS) -> DataFrame:
    """P-04: rows with enough text; a missing text is too short."""
    return df.filter(F.length(col) >= chars)


def filter_files(df: DataFrame, path: str, suffix: str = ".pdf") -> DataFrame:
    """S-03: rows whose file name has the suffix, in this very case."""
    return df.filter(F.col(path).endswith(suffix))


def profile_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """P-16: rows that link to a person's profile."""
    return df.filter(F.contains(F.col(url), F.lit("/in/")))


def verified(df: DataFrame, flag: str) -> DataFrame:
    """P-17: rows whose flag is true; a missing flag drops the row."""
    return df.filter(F.col(flag).eqNullSafe(True))


def active_roles(roles):
    """P-20: the active entries of an array of roles."""
    return F.filter(roles, lambda r: r["active"])
