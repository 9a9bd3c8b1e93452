"""Resume pages to profiles."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import experience_bucket, parse_role_date
from jobweave.operators.experience import YEARS, experience_by_title, total_experience
from jobweave.operators.resume import distinct_roles, resume_roles, resume_sections, resume_skills
from jobweave.session import written
from jobweave.sources.pages import page_lines


def dated_roles(roles: DataFrame, as_of) -> DataFrame:
    """Roles of a document with real dates; open ends and unreadable dates mean `as_of`."""
    return roles.select(
        F.col("doc_id").alias("profile_id"), "line_no", "company", "title",
        parse_role_date(F.col("start_date"), as_of).alias("start_date"),
        parse_role_date(F.col("end_date"), as_of).alias("end_date"))


def parse_lines(lines: DataFrame, as_of) -> DataFrame:
    """Experience total and bucket per resume, from its lines."""
    roles = distinct_roles(resume_roles(lines, resume_sections(lines)))
    return total_experience(experience_by_title(dated_roles(roles, as_of)))


def parse_resumes(pages: DataFrame, as_of) -> DataFrame:
    """Experience total and bucket per resume, from pages `doc_id, page_no, text`."""
    return parse_lines(page_lines(pages, "doc_id", "page_no", "text"), as_of)


def parse_profiles(pages: DataFrame, as_of) -> DataFrame:
    """The whole resume request, from pages: total and bucket, years by title and skills, one row per resume with text.

    Titles and skills of one resume meet in a row each; a resume without roles has 0 years.
    """
    lines = page_lines(pages, "doc_id", "page_no", "text")
    sections = written(resume_sections(lines), "resume-sections")
    years = written(experience_by_title(dated_roles(distinct_roles(resume_roles(sections, sections)), as_of)), "resume-years")
    titles = years.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("title", "years"))).alias("titles"))
    skills = resume_skills(sections).groupBy(F.col("doc_id").alias("profile_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "skill"))), lambda s: s["skill"]).alias("skills"))
    people = sections.select(F.col("doc_id").alias("profile_id")).distinct()
    rows = people.join(total_experience(years), "profile_id", "left").join(titles, "profile_id", "left").join(skills, "profile_id", "left")
    return rows.select(
        "profile_id", F.coalesce("total_years", F.lit(0)).cast(YEARS).alias("total_years"),
        F.coalesce("bucket", experience_bucket(F.lit(0))).alias("bucket"),
        F.coalesce("titles", F.array().cast(f"array<struct<title:string,years:{YEARS}>>")).alias("titles"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
