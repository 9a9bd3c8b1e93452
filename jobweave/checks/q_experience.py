"""Checks of resumes, experience totals and profile edits."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.checks import sql as o
from jobweave.checks.registry import query
from jobweave.functions import experience_bucket
from jobweave.operators.edits import apply_role_edits, apply_skill_edits
from jobweave.operators.experience import bucket_histogram, experience_by_title, group_titles, total_experience
from jobweave.operators.resume import distinct_roles, resume_roles, resume_sections, resume_skills
from jobweave.plans.resume import parse_lines, parse_profiles

AS_OF = "2024-02-01"

_ENDED = f"(SELECT *, coalesce(end_date, DATE '{AS_OF}') AS e FROM v_roles)"
_BY_TITLE = f"""o_titles AS (
  SELECT profile_id, title, CAST(sum({o.role_months('start_date', 'e')}) AS BIGINT) AS months,
         CAST(round(sum({o.role_months('start_date', 'e')}) / 12, 2) AS DECIMAL(12,2)) AS years
  FROM (SELECT profile_id, start_date, e, active, title FROM {_ENDED}) GROUP BY profile_id, title)"""


def _roles(view):
    return view("v_roles").withColumn("end_date", F.coalesce("end_date", F.to_date(F.lit(AS_OF))))


@query(o.ctes(_BY_TITLE, views=("v_roles",)) + "SELECT profile_id, title, months, CAST(years AS DOUBLE) AS years FROM o_titles")
def years_by_title(view, spark, sf_dir):
    """A-01, F-08"""
    return experience_by_title(_roles(view)).withColumn("years", F.col("years").cast("double"))


@query(o.ctes(_BY_TITLE.replace("start_date, e, active, title", "start_date, e, active, CASE WHEN role_id % 5 = 0 THEN 'Unknown Role' WHEN role_id % 7 <> 0 THEN title END AS title"),
              views=("v_roles",)) + "SELECT profile_id, title, months, CAST(years AS DOUBLE) AS years FROM o_titles")
def years_by_missing_title(view, spark, sf_dir):
    """A-01: missing titles become `Unknown Role`, null ones stay null."""
    roles = _roles(view).withColumn("given", F.col("role_id") % 5 != 0).withColumn(
        "title", F.when(F.col("role_id") % 7 != 0, F.col("title")))
    return experience_by_title(roles, "given").withColumn("years", F.col("years").cast("double"))


_ACTIVE = _BY_TITLE.replace(f"FROM {_ENDED})", f"FROM {_ENDED} WHERE active)")


@query(o.ctes(_ACTIVE, views=("v_roles",)) + f"""SELECT profile_id, CAST(t AS DOUBLE) AS total_years, {o.bucket('t')} AS bucket
FROM (SELECT profile_id, sum(years) AS t FROM o_titles GROUP BY profile_id)""")
def total_years(view, spark, sf_dir):
    """A-02, A-03, P-20"""
    return total_experience(experience_by_title(_roles(view).filter("active"))).withColumn(
        "total_years", F.col("total_years").cast("double"))


@query(o.ctes(_ACTIVE, views=("v_roles",)) + f"""SELECT {o.bucket('t')} AS bucket, count(*) AS profiles
FROM (SELECT profile_id, sum(years) AS t FROM o_titles GROUP BY profile_id) GROUP BY 1""")
def bucket_counts(view, spark, sf_dir):
    """A-03: histogram"""
    return bucket_histogram(total_experience(experience_by_title(_roles(view).filter("active"))))


@query(f"SELECT p_partkey, {o.bucket('p_size / 4.0', 'p_type')} AS bucket FROM part")
def kept_buckets(view, spark, sf_dir):
    """A-03: a given range is kept below one year."""
    return view("part").select("p_partkey", experience_bucket(F.col("p_size") / 4.0, F.col("p_type")).alias("bucket"))


@query(o.ctes(_BY_TITLE.replace("active, title FROM", "active, CASE WHEN title IN ('1-URGENT', '2-HIGH') THEN 'Product Manager' ELSE title END AS title FROM"),
              views=("v_roles",)) + "SELECT profile_id, title, CAST(years AS DOUBLE) AS years FROM o_titles")
def years_by_track(view, spark, sf_dir):
    """F-17"""
    taxonomy = view("orders").select(F.lower("o_orderpriority").alias("title")).distinct().filter(
        F.col("title").isin("1-urgent", "2-high")).withColumn("track", F.lit("Product Manager"))
    return experience_by_title(group_titles(_roles(view), taxonomy)).select(
        "profile_id", "title", F.col("years").cast("double").alias("years"))


_HEADING = "CASE " + " ".join(
    f"WHEN lower(trim(split_part(text, ':', 1))) = '{h}' THEN '{s}'" for h, s in fixed.HEADINGS.items()) + " END"
_SECTIONS = f"""o_sections AS (
  SELECT doc_id, line_no, text, heading, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM (SELECT *, {_HEADING} AS heading FROM v_resume_lines))"""
_ROLES = f"""{_SECTIONS}, o_roles AS (
  SELECT doc_id, line_no, title, company, regexp_extract(text, '{fixed.DATE_RANGE}', 1) AS start_date,
         regexp_extract(text, '{fixed.DATE_RANGE}', 2) AS end_date
  FROM (SELECT *, trim(lag(text, 1) OVER w) AS title, trim(lag(text, 2) OVER w) AS company FROM o_sections
        WHERE section = 'experience' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
  WHERE regexp_matches(text, '{fixed.DATE_RANGE}'))"""


@query(o.ctes(_SECTIONS, views=("v_resume_lines",)) + "SELECT doc_id, line_no, text, section FROM o_sections")
def resume_line_sections(view, spark, sf_dir):
    """N-03"""
    return resume_sections(view("v_resume_lines"))


@query(o.ctes(_ROLES, views=("v_resume_lines",)) + "SELECT * FROM o_roles")
def resume_line_roles(view, spark, sf_dir):
    """N-04"""
    return resume_roles(view("v_resume_lines"))


@query(o.ctes(_ROLES, views=("v_resume_lines",)) + """SELECT doc_id, company, title, min(line_no) AS line_no FROM o_roles GROUP BY ALL""")
def distinct_resume_roles(view, spark, sf_dir):
    """N-04: no company and title twice"""
    return distinct_roles(resume_roles(view("v_resume_lines"))).select("doc_id", "company", "title", "line_no")


@query(o.ctes(_SECTIONS, views=("v_resume_lines",)) + """SELECT doc_id, skill, min(line_no) AS line_no FROM (
SELECT doc_id, line_no, regexp_replace(trim(unnest(string_split(CASE WHEN heading IS NOT NULL THEN regexp_replace(text, '^[^:]*:?', '') ELSE text END, ','))), '\\.$', '') AS skill
FROM o_sections WHERE section = 'skills') WHERE skill <> '' GROUP BY ALL""")
def resume_skill_words(view, spark, sf_dir):
    """F-18"""
    return resume_skills(resume_sections(view("v_resume_lines"))).select("doc_id", "skill", "line_no")


def _month(x: str) -> str:
    def first(year: str, month: str) -> str:
        return f"make_date(TRY_CAST({year} AS INT), {month}, 1)"
    names = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
    return (f"CASE WHEN contains({x}, '/') THEN {first(f'split_part({x}, chr(47), 2)', f'TRY_CAST(split_part({x}, chr(47), 1) AS INT)')} "
            f"WHEN contains({x}, '-') THEN {first(f'split_part({x}, chr(45), 1)', f'TRY_CAST(split_part({x}, chr(45), 2) AS INT)')} "
            f"ELSE {first(f'right({x}, 4)', f'list_position({names}, left({x}, 3))')} END")


_SKILLS = """SELECT doc_id, skill, min(line_no) AS line_no FROM (
SELECT doc_id, line_no, regexp_replace(trim(unnest(string_split(CASE WHEN heading IS NOT NULL THEN regexp_replace(text, '^[^:]*:?', '') ELSE text END, ','))), '\\.$', '') AS skill
FROM o_sections WHERE section = 'skills') WHERE skill <> '' GROUP BY ALL"""

_MONTHS = f"""o_months AS (
  SELECT doc_id, title, CAST(round(sum({o.role_months('s', 'e')}) / 12, 2) AS DECIMAL(12,2)) AS years FROM (
    SELECT doc_id, title, {_month('start_date')} AS s, CASE WHEN end_date = 'present' THEN DATE '{AS_OF}' ELSE {_month('end_date')} END AS e
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, company, title ORDER BY line_no) AS n FROM o_roles) WHERE n = 1)
  GROUP BY doc_id, title)"""


@query(o.ctes(_ROLES, views=("v_resume_lines",)) + f""", {_MONTHS}, o_skills AS ({_SKILLS}),
o_people AS (SELECT DISTINCT doc_id FROM v_resume_lines),
o_totals AS (SELECT doc_id, sum(years) AS t, string_agg(title || '=' || years, ';' ORDER BY title) AS titles FROM o_months GROUP BY doc_id),
o_lists AS (SELECT doc_id, string_agg(skill, ';' ORDER BY skill) AS skills FROM o_skills GROUP BY doc_id)
SELECT p.doc_id AS profile_id, CAST(coalesce(t, 0) AS DOUBLE) AS total_years, {o.bucket('coalesce(t, 0)')} AS bucket,
       coalesce(titles, '') AS titles, coalesce(skills, '') AS skills
FROM o_people p LEFT JOIN o_totals x ON p.doc_id = x.doc_id LEFT JOIN o_lists y ON p.doc_id = y.doc_id""")
def parsed_profiles(view, spark, sf_dir):
    """The whole resume request, from pages of seven lines."""
    lines = view("v_resume_lines").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    pages = lines.groupBy("doc_id", F.floor(F.col("n") / 7).alias("page_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    titles = F.transform("titles", lambda t: F.concat(t["title"], F.lit("="), t["years"].cast("string")))
    return parse_profiles(pages, AS_OF).select(
        "profile_id", F.col("total_years").cast("double").alias("total_years"), "bucket",
        F.array_join(titles, ";").alias("titles"), F.array_join(F.array_sort("skills"), ";").alias("skills"))


@query(o.ctes(_ROLES, views=("v_resume_lines",)) + f""", o_months AS (
  SELECT doc_id, title, round(sum({o.role_months('s', 'e')}) / 12, 2) AS years FROM (
    SELECT doc_id, title, {_month('start_date')} AS s, CASE WHEN end_date = 'present' THEN DATE '{AS_OF}' ELSE {_month('end_date')} END AS e
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, company, title ORDER BY line_no) AS n FROM o_roles) WHERE n = 1)
  GROUP BY doc_id, title)
SELECT profile_id, CAST(t AS DOUBLE) AS total_years, {o.bucket('t')} AS bucket FROM (
  SELECT doc_id AS profile_id, sum(CAST(years AS DECIMAL(12,2))) AS t FROM o_months GROUP BY doc_id)""")
def parsed_resumes(view, spark, sf_dir):
    """The resume request: lines to experience totals."""
    return parse_lines(view("v_resume_lines"), AS_OF).withColumn("total_years", F.col("total_years").cast("double"))


@query(o.ctes(views=("v_skills", "v_skill_edits")) + f""", o_removed AS (
  SELECT profile_id, skill, max(edit_id) AS r FROM v_skill_edits WHERE op = 'remove' GROUP BY ALL),
o_all AS (SELECT profile_id, skill, 0 AS added, CAST(ord AS BIGINT) AS ord FROM v_skills UNION ALL
  SELECT profile_id, trim(skill), 1, edit_id FROM v_skill_edits WHERE op = 'add' AND trim(skill) <> '')
SELECT profile_id, skill, added, ord FROM (
  SELECT a.*, ROW_NUMBER() OVER (PARTITION BY a.profile_id, a.skill ORDER BY added, ord) AS n
  FROM o_all a LEFT JOIN o_removed r ON a.profile_id = r.profile_id AND a.skill = r.skill
  WHERE r IS NULL OR (added = 1 AND ord > r)) WHERE n = 1""")
def edited_skills(view, spark, sf_dir):
    """U-03"""
    return apply_skill_edits(view("v_skills"), view("v_skill_edits"))


_EDITED = """o_edited AS (
  SELECT b.profile_id, b.role_id, b.title, b.years, b.active <> (coalesce(e.toggles, 0) % 2 = 1) AS active
  FROM (SELECT profile_id, role_id, title, CAST(role_id % 9 AS DECIMAL(12,2)) AS years, active FROM v_roles
        UNION ALL SELECT profile_id, role_id, trim(title), 0, true FROM v_role_edits WHERE op = 'add') b
  LEFT JOIN (SELECT profile_id, role_id, count(*) FILTER (op = 'toggle') AS toggles, count(*) FILTER (op = 'remove') AS removes
             FROM v_role_edits GROUP BY ALL) e ON b.profile_id = e.profile_id AND b.role_id = e.role_id
  WHERE coalesce(removes, 0) = 0)"""


def _edited(view):
    roles = view("v_roles").select("profile_id", "role_id", "title", (F.col("role_id") % 9).alias("years"), "active")
    return apply_role_edits(roles, view("v_role_edits"))


@query(o.ctes(_EDITED, views=("v_roles", "v_role_edits")) + "SELECT profile_id, role_id, title, CAST(years AS DOUBLE) AS years, active FROM o_edited")
def edited_roles(view, spark, sf_dir):
    """U-04"""
    return _edited(view).withColumn("years", F.col("years").cast("double"))


@query(o.ctes(_EDITED, views=("v_roles", "v_role_edits")) + f"""SELECT profile_id, CAST(t AS DOUBLE) AS total_years, {o.bucket('t')} AS bucket FROM (
SELECT profile_id, coalesce(sum(years) FILTER (active), 0) AS t FROM o_edited GROUP BY profile_id)""")
def edited_totals(view, spark, sf_dir):
    """U-04 with A-02, A-03"""
    return total_experience(_edited(view), active="active").withColumn("total_years", F.col("total_years").cast("double"))
