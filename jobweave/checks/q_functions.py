"""Checks of scalar functions."""
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.checks import sql as o
from jobweave.checks.q_discovery import posting_texts
from jobweave.checks.registry import query
from jobweave.functions import (
    company_domain, company_from_url, confidence_label, confidence_tier, experience_mismatch, parse_role_date, parse_years, py_title, referrer_name, resolve_company, role_months,
    skill_overlap, too_senior, truncate, with_protocol, word_count,
)
from jobweave.operators.gates import Places
from jobweave.operators.matching import read_texts
from jobweave.operators.requests import company_searches, draft_text, profile_summary, request_defaults, search_plan
from jobweave.operators.scoring import score_batches

AS_OF = "2024-02-01"


@query(o.ctes(views=("v_search_results",)) + f"""SELECT DISTINCT url, source, {o.company_from_url('url', 'source')} AS company FROM v_search_results""")
def company_names(view, spark, sf_dir):
    """F-01"""
    return view("v_search_results").select("url", "source").distinct().withColumn(
        "company", company_from_url(F.col("url"), F.col("source")))


@query(f"SELECT doc_id, {o.py_title('text')} AS title FROM documents")
def title_case(view, spark, sf_dir):
    """F-02"""
    return view("documents").select("doc_id", py_title(F.col("text")).alias("title"))


@query(o.ctes(views=("v_postings",)) + f"SELECT url, required_text, {o.parse_years('required_text')} AS min_required FROM v_postings")
def required_years(view, spark, sf_dir):
    """F-03"""
    return view("v_postings").select("url", "required_text", parse_years(F.col("required_text")).alias("min_required"))


@query(o.ctes(views=("v_postings",)) + f"""SELECT url, {o.requirement('text')} AS required,
nullif(regexp_extract(text, '{fixed.COMPANY}', 1), '') AS company, nullif(regexp_extract(text, '{fixed.TEAM}', 1), '') AS team FROM v_postings""")
def posting_extracts(view, spark, sf_dir):
    """F-04, F-05"""
    known = Places(view("v_places"))
    return read_texts(posting_texts(view, known).drop("required_text"), known).select(
        "url", F.col("required_text").alias("required"), F.col("company_found").alias("company"), "team")


@query("SELECT doc_id, substr(text, 1, 4000) AS kept, substr(substr(text, 1, 4000), 1, 3000) AS evaluated FROM documents")
def truncated_texts(view, spark, sf_dir):
    """F-06: the cut itself is the feature; no other query reads cut texts."""
    kept = truncate(F.col("text"), fixed.POSTING_CHARS)
    return view("documents").select("doc_id", kept.alias("kept"), truncate(kept, fixed.EVALUATION_CHARS).alias("evaluated"))


@query(o.ctes(views=("v_date_texts",)) + f"""SELECT role_id, date_text, CAST(CASE role_id % 24
WHEN 3 THEN make_date(year(d), 1, 1) WHEN 4 THEN DATE '{AS_OF}' WHEN 6 THEN DATE '{AS_OF}' WHEN 7 THEN DATE '{AS_OF}'
WHEN 10 THEN d WHEN 11 THEN make_date(year(d), month(d), 3) WHEN 12 THEN make_date(2000, month(d), 1)
WHEN 13 THEN CASE WHEN year(d) % 100 > 31 THEN date_trunc('month', d) WHEN year(d) % 100 = 0 THEN DATE '{AS_OF}' ELSE make_date(2000, month(d), year(d) % 100) END WHEN 14 THEN d WHEN 15 THEN d
WHEN 17 THEN CASE WHEN day(d) > 12 THEN d ELSE make_date(year(d), day(d), month(d)) END WHEN 18 THEN make_date(2000, 1, month(d))
WHEN 19 THEN d WHEN 20 THEN d WHEN 22 THEN d WHEN 23 THEN DATE '{AS_OF}'
ELSE date_trunc('month', d) END AS DATE)::VARCHAR AS role_date FROM v_date_texts""")
def role_dates(view, spark, sf_dir):
    """F-07: two dozen layouts, and texts that are no dates."""
    return view("v_date_texts").select("role_id", "date_text",
                                       parse_role_date(F.col("date_text"), AS_OF).cast("string").alias("role_date"))


@query(o.ctes(views=("v_roles",)) + f"""SELECT role_id, CAST({o.role_months('start_date', 'e')} AS INT) AS months
FROM (SELECT *, coalesce(end_date, DATE '{AS_OF}') AS e FROM v_roles)""")
def role_durations(view, spark, sf_dir):
    """F-08"""
    end = F.coalesce("end_date", F.to_date(F.lit(AS_OF)))
    return view("v_roles").select("role_id", role_months(F.col("start_date"), end).alias("months"))


_LINKS = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN substr(url, 9) ELSE concat('http', url) END AS link FROM pages"


@query(f"SELECT page_id, CASE WHEN link LIKE 'http://%' OR link LIKE 'https://%' THEN link ELSE 'https://' || link END AS link FROM ({_LINKS})")
def protocol_prefix(view, spark, sf_dir):
    """F-09"""
    view("pages")
    return spark.sql(_LINKS).withColumn("link", with_protocol(F.col("link")))


@query(f"""SELECT c_custkey, trim(split_part(coalesce(CASE WHEN c_custkey % 8 <> 0 THEN concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN ' - x - y'
ELSE '' END) END, 'LinkedIn Member'), '-', 1)) AS name FROM customer""")
def referrer_names(view, spark, sf_dir):
    """F-10"""
    title = F.expr("CASE WHEN c_custkey % 8 <> 0 THEN concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN ' - x - y' ELSE '' END) END")
    return view("customer").select("c_custkey", referrer_name(title).alias("name"))


@query(f"SELECT doc_id, CAST({o.words('text')} AS INT) AS words FROM documents")
def word_counts(view, spark, sf_dir):
    """F-11"""
    return view("documents").select("doc_id", word_count(F.col("text")).alias("words"))


_REQUESTS = """SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 4 = 0 THEN array() ELSE array(CASE WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END, 'Other') END AS target_roles,
CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 / 4.0 END AS actual_years, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE '' END AS industry,
CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS location, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 = 1 END AS remote_only
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

_REQUEST_SQL = """o_requests AS (
SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 4 < 2 THEN 'Product Manager' ELSE c_mktsegment END AS job_title,
CAST(floor(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 / 4.0 ELSE 0 END + 0.5) AS INT) AS actual_years_exp,
CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE 'General' END AS industry,
CASE WHEN c_custkey % 7 <> 0 THEN n_name ELSE 'India' END AS location, c_custkey % 3 = 1 AS remote_only
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("WITH " + _REQUEST_SQL + " SELECT * FROM o_requests")
def filled_requests(view, spark, sf_dir):
    """F-12"""
    view("customer")
    return request_defaults(spark.sql(_REQUESTS)).select(
        "profile_id", "job_title", "actual_years_exp", "industry", "location", "remote_only")


@query("WITH " + _REQUEST_SQL + " " + " UNION ALL ".join(
    f"SELECT profile_id, '{s}' AS target, replace(replace({o.quoted(t)}, '{{title}}', job_title), '{{location}}', location) AS search FROM o_requests"
    for s, t in fixed.SEARCH_TEXTS.items()))
def search_texts(view, spark, sf_dir):
    """F-16: search plan of every profile."""
    view("customer")
    return search_plan(request_defaults(spark.sql(_REQUESTS)))


@query(o.ctes(views=("v_companies",)) + f"""SELECT company_id, replace(replace({o.quoted(fixed.CONTACT_SEARCH)}, '{{company}}', company), '{{team}}',
CASE WHEN team IS NULL THEN '' ELSE '"' || team || '"' END) AS contact_search,
replace({o.quoted(fixed.REFERRAL_SEARCH)}, '{{company}}', company) AS referral_search, company || ' news' AS news_search FROM v_companies""")
def company_search_texts(view, spark, sf_dir):
    """F-16: searches about companies."""
    return company_searches(view("v_companies")).drop("company", "team")


@query(f"""SELECT p_partkey, p_brand || ' with ' || p_size || ' years exp. Skills: ' || array_to_string(string_split(p_name, ' '), ', ') AS summary,
replace(replace(replace({o.quoted(fixed.DRAFT_TEXT)}, '{{name}}', p_name), '{{company}}', p_brand), '{{title}}', p_type) AS draft FROM part""")
def profile_texts(view, spark, sf_dir):
    """F-16: summary line and fixed draft."""
    name, brand = F.col("p_name"), F.col("p_brand")
    return view("part").select("p_partkey", profile_summary(brand, F.col("p_size"), F.split(name, " ")).alias("summary"),
                               draft_text(name, brand, F.col("p_type")).alias("draft"))


_SKILLED = """SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 11 = 0 THEN array() ELSE
concat(split(p.p_name, ' '), array('The', 'de', 'und', 'mail', 'License', p.p_brand)) END AS skills
FROM documents d JOIN part p ON d.doc_id = p.p_partkey"""

_SKILLED_SQL = """SELECT d.doc_id, CASE WHEN d.doc_id % 11 <> 0 THEN
len(list_filter(s.skills, lambda x: contains(lower(d.text), lower(x)))) / len(s.skills) END AS score
FROM documents d JOIN (SELECT p_partkey, list_concat(string_split(p_name, ' '), ['The', 'de', 'und', 'mail', 'License', p_brand]) AS skills FROM part) s
ON d.doc_id = s.p_partkey"""


@query(_SKILLED_SQL)
def skill_scores(view, spark, sf_dir):
    """F-13"""
    view("part")
    return spark.sql(_SKILLED).select("doc_id", skill_overlap(F.col("skills"), F.col("text")).alias("score"))


@query(_SKILLED_SQL)
def plugged_scorer(view, spark, sf_dir):
    """Scorer hook: the same score from a function over Arrow batches."""
    view("part")

    most = fixed.MAX_SKILLS

    def score(batch):
        low = batch["text"].str.lower()
        shares = [sum(s.lower() in t for s in skills[:most]) / len(skills[:most]) if len(skills) else None
                  for t, skills in zip(low, batch["skills"])]
        return batch[["doc_id"]].assign(score=shares)

    return score_batches(spark.sql(_SKILLED), score, "doc_id bigint, score double")


@query(o.ctes(views=("v_search_results",)) + f"""SELECT query_id, rank, source, url, query_id % 9 < 5 AND {o.senior_title('title', 'url')} AS too_senior FROM v_search_results""")
def senior_titles(view, spark, sf_dir):
    """P-03: with query_id % 9 as years of experience."""
    return view("v_search_results").select("query_id", "rank", "source", "url", too_senior(
        F.col("title"), F.col("url"), F.col("query_id") % 9).alias("too_senior"))


@query(o.ctes(views=("v_postings",)) + f"""SELECT url, coalesce({o.parse_years('required_text')} > length(url) % 7 + 1.5, false) AS mismatch FROM v_postings""")
def experience_mismatches(view, spark, sf_dir):
    """P-05"""
    return view("v_postings").select("url", experience_mismatch(F.col("required_text"), F.length("url") % 7).alias("mismatch"))


@query(o.ctes(views=("v_search_results",)) + f"""SELECT DISTINCT url, source, coalesce(nullif(found, ''), {o.company_from_url('url', 'source')}) AS company
FROM (SELECT *, CASE length(url) % 3 WHEN 0 THEN 'Found Inc' WHEN 1 THEN '' END AS found FROM v_search_results)""")
def resolved_companies(view, spark, sf_dir):
    """P-11"""
    found = F.expr("CASE length(url) % 3 WHEN 0 THEN 'Found Inc' WHEN 1 THEN '' END")
    return view("v_search_results").select("url", "source").distinct().withColumn(
        "company", resolve_company(found, F.col("url"), F.col("source")))


_CONFIDENCE = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 0.0 ELSE (event_id % 201) / 200 END AS confidence FROM events"


@query(f"""SELECT event_id, CASE WHEN confidence IS NULL OR confidence = 0 THEN 'none' WHEN confidence >= 0.85 THEN 'high' ELSE 'medium' END AS tier,
CASE WHEN confidence <> 0 THEN CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '% fit' END AS label
FROM (SELECT event_id, CAST(confidence AS DOUBLE) AS confidence FROM ({_CONFIDENCE}))""")
def confidence_badges(view, spark, sf_dir):
    """P-19"""
    view("events")
    c = F.col("confidence").cast("double")
    return spark.sql(_CONFIDENCE).select("event_id", confidence_tier(c).alias("tier"), confidence_label(c).alias("label"))


@query("SELECT DISTINCT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '.com' AS domain FROM part")
def company_domains(view, spark, sf_dir):
    """J-07"""
    return view("part").select("p_name", company_domain(F.col("p_name")).alias("domain")).distinct()
