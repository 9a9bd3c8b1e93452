"""Checks of contacts, referrers, e-mails and news."""
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.checks import sql as o
from jobweave.checks.registry import in_parts, query
from jobweave.functions import company_domain
from jobweave.operators.contacts import (
    attach_email, attach_news, attach_news_at, contact_cards, current_employee, department_rank, name_collision, parse_contacts, recent_news,
    referrals, top_contacts,
)
from jobweave.operators.filters import verified
from jobweave.operators.ordered import top_k
from jobweave.plans.outreach import draft_requests
from jobweave.session import work_folder
from jobweave.streaming.news import newest_of, stream_news

AS_OF = "2000-06-30"

_FLAGS_ALL = o.CURRENT.replace(" WHERE result <= 10),", "),")


@query(o.ctes(_FLAGS_ALL, views=("v_contacts",)) + "SELECT rank, works_there, collides FROM o_flags")
def employment_flags(view, spark, sf_dir):
    """P-13, P-14"""
    name, snippet, company = F.col("name"), F.col("snippet"), F.col("company")
    return view("v_contacts").select("rank", current_employee(snippet, company).alias("works_there"),
                                     name_collision(name, snippet, company).alias("collides"))


@query(o.ctes(views=("v_contacts",)) + f"""SELECT rank, coalesce({o.department_rank('role', "CASE rank % 3 WHEN 0 THEN 'Growth' WHEN 1 THEN 'Product' END")}, -1) AS dept FROM v_contacts""")
def department_ranks(view, spark, sf_dir):
    """P-15: -1 where the role does not fit."""
    team = F.expr("CASE rank % 3 WHEN 0 THEN 'Growth' WHEN 1 THEN 'Product' END")
    return view("v_contacts").select("rank", F.coalesce(department_rank(F.col("role"), team), F.lit(-1)).alias("dept"))


@query(o.ctes(o.CURRENT, views=("v_contacts",)) + "SELECT company, result, name, url FROM o_current")
def current_contacts(view, spark, sf_dir):
    """T-02, P-16, P-17"""
    return parse_contacts(view("v_contacts")).select("company", F.col("result").cast("bigint").alias("result"), "name", "url")


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 4 <> 0 THEN event_type <> 'error' END")
def verified_rows(view, spark, sf_dir):
    """P-17"""
    flagged = view("events").withColumn("flag", F.expr("CASE WHEN event_id % 4 <> 0 THEN event_type <> 'error' END"))
    return verified(flagged, "flag").select("event_id")


@query(o.ctes(views=("v_contacts",)) + """SELECT rank, CASE WHEN rank % 10 = 0 THEN 'Unknown' ELSE name END AS name, role AS current_role, url AS linkedin_url FROM v_contacts""")
def contact_card_rows(view, spark, sf_dir):
    """P-18"""
    one = F.array(F.struct(F.expr("CASE WHEN rank % 10 <> 0 THEN name END").alias("name"), "role", "url"))
    cards = view("v_contacts").select("rank", contact_cards(one).alias("cards"))
    return cards.select("rank", F.inline("cards"))


@query(o.ctes(o.best_contacts("v_companies"), views=("v_contacts", "v_companies")) + "SELECT company, team, pos, name, url FROM o_best")
def best_contacts(view, spark, sf_dir):
    """T-03"""
    return top_contacts(parse_contacts(view("v_contacts")), view("v_companies")).select(
        "company", "team", F.col("pos").cast("bigint").alias("pos"), "name", "url")


_FITS = f"regexp_matches({o.token_text('role')}, ' ({'|'.join(fixed.REFERRER_WORDS)})s? ')"


@query(o.ctes(views=("v_contacts", "v_companies")) + f"""SELECT trim(split_part(title, '-', 1)) AS name, url AS linkedin, company, pos FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY company ORDER BY rank, url) AS pos FROM v_contacts WHERE {_FITS}
AND company IN (SELECT company FROM v_companies)) WHERE pos <= 5""")
def company_referrers(view, spark, sf_dir):
    """J-05, T-05: for all companies."""
    return referrals(view("v_companies"), view("v_contacts")).withColumn("pos", F.col("pos").cast("bigint"))


@query("""SELECT c_custkey, c_name, d.s_name AS email FROM (SELECT *, split_part(c_name, '#', 1) AS f, split_part(c_name, '#', 2) AS l,
CASE WHEN c_custkey % 5 <> 0 THEN 'nation' || c_nationkey || '.com' END AS dom FROM customer) c
LEFT JOIN (SELECT 'Customer' AS f, lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0') AS l, 'nation' || (s_suppkey * 7 % 25) || '.com' AS dom, s_name FROM supplier) d
ON c.f = d.f AND c.l = d.l AND c.dom = d.dom""")
def contact_emails(view, spark, sf_dir):
    """J-06: names and domains of customers looked up in a directory built from suppliers."""
    people = view("customer").select(
        "c_custkey", "c_name", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.expr("CASE WHEN c_custkey % 5 <> 0 THEN concat('Nation ', c_nationkey) END").alias("company"))
    key = F.col("s_suppkey") * 7
    directory = view("supplier").select(
        F.lit("Customer").alias("first_name"), F.lpad(key.cast("string"), 9, "0").alias("last_name"),
        company_domain(F.concat(F.lit("Nation "), key % 25)).alias("domain"), F.col("s_name").alias("email"))
    return attach_email(people, directory).select("c_custkey", "c_name", "email")


_RECENT = f"""o_recent AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company ORDER BY published_at DESC, news_id) AS pos FROM v_news
WHERE published_at > DATE '{AS_OF}' - INTERVAL 6 MONTH AND published_at <= DATE '{AS_OF}') WHERE pos <= 3)"""


@query(o.ctes(_RECENT, views=("v_news",)) + "SELECT company, pos, title, published_at::VARCHAR AS published_at FROM o_recent")
def newest_news(view, spark, sf_dir):
    """T-04"""
    return recent_news(view("v_news"), AS_OF).select(
        "company", F.col("pos").cast("bigint").alias("pos"), "title", F.col("published_at").cast("string").alias("published_at"))


@query(o.ctes(_RECENT, views=("v_news", "v_companies")) + """SELECT c.company_id, coalesce(n.titles, '') AS titles FROM v_companies c
LEFT JOIN (SELECT company, string_agg(title, '; ' ORDER BY pos) AS titles FROM o_recent GROUP BY company) n ON c.company = n.company""")
def news_of_companies(view, spark, sf_dir):
    """J-04"""
    return attach_news(view("v_companies"), view("v_news"), AS_OF).select("company_id", F.array_join("news", "; ").alias("titles"))


_RECENT_AT = """o_recent_at AS (
  SELECT * FROM (SELECT a.request_id, n.news_id, n.title, n.published_at, ROW_NUMBER() OVER (PARTITION BY a.request_id ORDER BY n.published_at DESC, n.news_id) AS pos
    FROM v_asked a JOIN v_news n ON a.company = n.company AND n.published_at > a.asked_on - INTERVAL 6 MONTH AND n.published_at <= a.asked_on) WHERE pos <= 3)"""


@query(o.ctes(_RECENT_AT, views=("v_asked", "v_news")) + """SELECT a.request_id, coalesce(string_agg(r.title, '; ' ORDER BY r.pos), '') AS titles
FROM v_asked a LEFT JOIN o_recent_at r ON a.request_id = r.request_id GROUP BY a.request_id""")
def news_at_request_time(view, spark, sf_dir):
    """J-04: each request looks back from its own day."""
    return attach_news_at(view("v_asked"), view("v_news")).select("request_id", F.array_join("news", "; ").alias("titles"))


@query(o.ctes(_RECENT_AT, views=("v_asked", "v_news")) + "SELECT request_id, news_id, pos FROM o_recent_at")
def news_stream(view, spark, sf_dir):
    """J-04 on streams: requests and news arrive in two batches each, by time; the delay spans the table."""
    folder = work_folder(spark, "news")
    asked = view("v_asked").withColumn("asked_at", F.col("asked_on").cast("timestamp")).drop("asked_on")
    items = view("v_news").withColumn("published_at", F.col("published_at").cast("timestamp"))
    stream_news(in_parts(asked, f"{folder}/asked", "asked_at", 2), in_parts(items, f"{folder}/news", "published_at", 2), folder, delay="4000 days").awaitTermination()
    return newest_of(spark, folder).select("request_id", "news_id", F.col("pos").cast("bigint").alias("pos"))


@query(o.ctes(_RECENT, views=("v_news",)) + """SELECT c_custkey AS request_id, 'Acme Labs ' || (c_custkey % (SELECT count(*) FROM supplier)) AS company, c_mktsegment AS job_title,
CASE WHEN c_custkey % 3 = 0 THEN 'Hiring Team' ELSE c_name END AS poc_name,
'Engineer with ' || (c_custkey % 12) || ' years exp. Skills: SQL, Figma' AS profile_summary, coalesce(n.titles, '') AS news_snippet
FROM customer LEFT JOIN (SELECT company, string_agg(title, chr(10) ORDER BY pos) AS titles FROM o_recent GROUP BY company) n
ON n.company = 'Acme Labs ' || (c_custkey % (SELECT count(*) FROM supplier))""")
def draft_request_rows(view, spark, sf_dir):
    """Drafting request: J-04 with F-16."""
    requests = view("customer").select(
        F.col("c_custkey").alias("request_id"), F.lit("Engineer").alias("job_title"), (F.col("c_custkey") % 12).alias("actual_years_exp"),
        F.array(F.lit("SQL"), F.lit("Figma")).alias("skills"), F.col("c_mktsegment").alias("target_title"),
        F.concat(F.lit("Acme Labs "), F.col("c_custkey") % view("supplier").count()).alias("company"),
        F.expr("CASE WHEN c_custkey % 3 <> 0 THEN c_name END").alias("poc_name"))
    return draft_requests(requests, view("v_news"), AS_OF)


@query(o.ctes(views=("v_contacts",)) + """SELECT company, rank, pos FROM (SELECT company, rank, ROW_NUMBER() OVER (PARTITION BY company ORDER BY rank) AS pos
FROM v_contacts) WHERE pos <= 10""")
def top_results(view, spark, sf_dir):
    """T-02 alone: the top-k operator."""
    return top_k(view("v_contacts"), ["company"], ["rank"], fixed.MAX_SNIPPETS, ["rank"]).select(
        "company", "rank", F.col("pos").cast("bigint").alias("pos"))


@query("""SELECT doc_id, array_to_string(list_slice(w, 1, 15), ',') AS skills FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def first_skills(view, spark, sf_dir):
    """T-06"""
    return view("documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, fixed.MAX_SKILLS), ",").alias("skills"))
