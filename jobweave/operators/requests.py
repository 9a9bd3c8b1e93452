"""Requests, search texts, cards and drafts as text columns."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions import resolve_company


def _or_default(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def request_defaults(profiles: DataFrame, drafting: bool = False) -> DataFrame:
    """F-12: request fields of profiles (`target_roles, actual_years, industry, location, remote_only`)."""
    title = fixed.DEFAULT_DRAFT_TITLE if drafting else fixed.DEFAULT_TITLE
    years = F.coalesce("actual_years", F.lit(0))
    out = profiles.withColumn("job_title", _or_default(F.try_element_at("target_roles", F.lit(1)), title)).withColumn(
        "industry", _or_default(F.col("industry"), fixed.DEFAULT_INDUSTRY))
    if drafting:
        return out.withColumn("actual_years_exp", years)
    return (out.withColumn("actual_years_exp", F.floor(years + F.lit(0.5)).cast("int"))
            .withColumn("location", _or_default(F.col("location"), fixed.DEFAULT_LOCATION))
            .withColumn("remote_only", F.coalesce("remote_only", F.lit(False))))


def fill(template: str, **values: Column) -> Column:
    """The template with its named places replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def search_plan(requests: DataFrame) -> DataFrame:
    """F-16: one search text per request and source."""
    texts = F.array(*[F.struct(F.lit(s).alias("target"),
                               fill(t, title=F.col("job_title"), location=F.col("location")).alias("search"))
                      for s, t in fixed.SEARCH_TEXTS.items()])
    return requests.select("profile_id", F.explode(texts).alias("s")).select("profile_id", "s.*")


def company_searches(df: DataFrame) -> DataFrame:
    """F-16: contact, referral and news search texts for `company` and `team`."""
    company = F.col("company")
    team = F.when(F.coalesce("team", F.lit("")) != "", F.concat(F.lit('"'), "team", F.lit('"'))).otherwise("")
    return (df.withColumn("contact_search", fill(fixed.CONTACT_SEARCH, company=company, team=team))
            .withColumn("referral_search", fill(fixed.REFERRAL_SEARCH, company=company))
            .withColumn("news_search", fill(fixed.NEWS_SEARCH, company=company)))


def profile_summary(title: Column, years: Column, skills: Column) -> Column:
    """F-16: one line about a candidate."""
    return F.concat(title, F.lit(" with "), years.cast("string"), F.lit(" years exp. Skills: "), F.array_join(skills, ", "))


def draft_text(name: Column, company: Column, title: Column) -> Column:
    """F-16: the fixed draft."""
    return fill(fixed.DRAFT_TEXT, name=name, company=company, title=title)


def job_cards(df: DataFrame) -> DataFrame:
    """P-12: one card per match.

    Reads `company` (or else `company_found`), `url, source, job_title, team, required_text, reasoning_trace, confidence, contacts`.
    """
    trace = F.col("reasoning_trace")
    reason = F.concat(F.lit("Exp: "), F.coalesce(trace["experience_gate"], F.lit("")),
                      F.lit(" | Loc: "), F.coalesce(trace["location_gate"], F.lit("")))
    kept = [c for c in ("profile_id", "pos") if c in df.columns]
    return df.select(
        *kept, F.sha2("url", 256).alias("id"),
        (F.col("company") if "company" in df.columns else resolve_company(F.col("company_found"), F.col("url"), F.col("source"))).alias("company"),
        F.col("job_title"), F.col("url"), F.col("url").alias("linkedin"), F.col("team"),
        F.col("required_text").alias("required_experience"), reason.alias("reason"),
        F.col("confidence"), F.col("contacts").alias("poc_profiles"))
