"""Input views over the driver's tables, as SQL that Spark and DuckDB both run.

Every view reads its tables whole. Modulo is used to vary values, never to leave rows out.
"""
from pyspark.sql import DataFrame, SparkSession

from jobweave.session import configure

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "v_search_results": """
SELECT l.l_orderkey % 50 AS query_id,
       CASE l.l_linenumber % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Naukri' ELSE 'Board' END AS source,
       l.l_orderkey * 8 + l.l_linenumber AS rank,
       CASE l.l_partkey % 6
         WHEN 0 THEN CONCAT('https://boards.greenhouse.io/acme-labs-', l.l_suppkey, '/jobs/', l.l_partkey)
         WHEN 1 THEN CONCAT('https://jobs.lever.co/3m-north-', l.l_suppkey, '/', l.l_partkey)
         WHEN 2 THEN CONCAT('https://south', l.l_suppkey, '.wd1.myworkdayjobs.com/x/', l.l_partkey)
         WHEN 3 THEN CONCAT('https://www.linkedin.com/jobs/view/analyst-at-west-co-', l.l_partkey, '?ref=x')
         WHEN 4 THEN CONCAT('https://www.naukri.com/job-listings-', l.l_partkey)
         ELSE CONCAT('https://jobs.ashbyhq.com/east-', l.l_suppkey, '/', l.l_partkey) END AS url,
       CASE p.p_size % 4 WHEN 0 THEN CONCAT('Senior ', p.p_name) WHEN 1 THEN CONCAT('Staffing ', p.p_name)
         WHEN 2 THEN CONCAT(p.p_name, ' in NATION_', l.l_partkey % 25) ELSE p.p_name END AS title
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_postings": """
SELECT u.url,
       CASE WHEN u.k % 4 = 0 THEN d.text
            ELSE CONCAT('About Acme Labs ', u.k % (SELECT COUNT(*) FROM supplier), CHR(10),
              CASE u.k % 3 WHEN 0 THEN 'Team: Growth' WHEN 1 THEN 'Team: Product' ELSE 'All teams' END, CHR(10),
              'Experience: ', u.required, CHR(10),
              CASE u.k % 7 WHEN 1 THEN CONCAT('Office hours as in NATION_', (u.k + u.k % 2) % 25) WHEN 2 THEN 'Fully remote, work from anywhere'
                WHEN 3 THEN CONCAT('Based in the United Lands of Region ', u.k % 5, ' North.')
                WHEN 4 THEN CONCAT('New NATION_', u.k % 25, ', new NATION_', u.k % 25, ' and more') ELSE 'On site' END, CHR(10), d.text) END AS text,
       u.required AS required_text,
       CASE WHEN u.k % 3 = 0 THEN 'Remote' WHEN u.k % 3 = 1 THEN CONCAT('Office in NATION_', u.k % 25) ELSE NULL END AS location
FROM (SELECT w.url, w.k,
             CASE w.k % 5 WHEN 0 THEN CONCAT(w.k % 9, '+ years') WHEN 1 THEN CONCAT(w.k % 6, ' - ', w.k % 6 + 3, ' years')
               WHEN 2 THEN CONCAT(w.k % 8, ' years') WHEN 3 THEN 'Not specified'
               ELSE CONCAT(w.k % 9, '+ years (', w.k % 4, '-', w.k % 4 + 2, ' in product)') END AS required
      FROM (SELECT url, LENGTH(url) * 7 + MIN(rank) AS k FROM v_search_results GROUP BY url) w) u
JOIN documents d ON d.doc_id = u.k % (SELECT COUNT(*) FROM documents)""",
    "v_profiles": """
SELECT c.c_custkey AS profile_id, c.c_custkey % 50 AS query_id,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL WHEN c.c_custkey % 7 = 0 THEN CAST(c.c_custkey % 12 + 0.67 AS DOUBLE)
         ELSE CAST(c.c_custkey % 12 AS DOUBLE) END AS years,
       CASE c.c_custkey % 8 WHEN 0 THEN LOWER(n.n_name) WHEN 1 THEN CONCAT('City ', c.c_custkey % 9, ', ', n.n_name)
         WHEN 2 THEN CONCAT(n.n_name, ' or NATION_', c.c_custkey % 25) WHEN 3 THEN CASE WHEN c.c_custkey % 3 = 0 THEN 'Nowhere' END
         WHEN 4 THEN CONCAT('united lands of region ', c.c_custkey % 5, ' north') ELSE n.n_name END AS location,
       c.c_custkey % 5 = 0 AS remote_only, c.c_mktsegment AS industry,
       CONCAT(c.c_mktsegment, ' analyst') AS job_title
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_places": """
SELECT n_name AS place, n_name AS country FROM nation
UNION ALL SELECT CONCAT('United Lands of Region ', r_regionkey, ' North'), CONCAT('NATION_', r_regionkey * 5) FROM region
UNION ALL SELECT CONCAT('New ', n_name), CONCAT('NATION_', (n_nationkey + 1) % 25) FROM nation WHERE n_nationkey % 3 = 0""",
    "v_roles": """
SELECT o.o_custkey AS profile_id, o.o_orderkey AS role_id, o.o_orderpriority AS title,
       CAST(o.o_orderdate AS DATE) AS start_date, CAST(s.ship AS DATE) AS end_date, o.o_orderstatus <> 'F' AS active
FROM orders o LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) s
  ON o.o_orderkey = s.l_orderkey""",
    "v_date_texts": """
SELECT role_id, CAST(start_date AS DATE) AS d,
       CASE role_id % 24
         WHEN 0 THEN CONCAT(LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'), '/', YEAR(start_date))
         WHEN 1 THEN CONCAT(MONTH(start_date), '/', YEAR(start_date))
         WHEN 2 THEN CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * MONTH(start_date) - 2, 3), ' ', YEAR(start_date))
         WHEN 3 THEN CAST(YEAR(start_date) AS STRING)
         WHEN 4 THEN 'Present'
         WHEN 5 THEN CONCAT(YEAR(start_date), '-', LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'))
         WHEN 6 THEN 'no date'
         WHEN 7 THEN NULL
         WHEN 8 THEN CONCAT(' present ', MONTH(start_date), '/', YEAR(start_date), ' ')
         WHEN 9 THEN CONCAT(YEAR(start_date), ' ', SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * MONTH(start_date) - 2, 3))
         WHEN 10 THEN CONCAT(DAY(start_date), ' ', SPLIT_PART('January,February,March,April,May,June,July,August,September,October,November,December', ',', MONTH(start_date)), ', ', YEAR(start_date))
         WHEN 11 THEN CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * MONTH(start_date) - 2, 3), ' 3rd ', YEAR(start_date))
         WHEN 12 THEN SPLIT_PART('January,February,March,April,May,June,July,August,September,October,November,December', ',', MONTH(start_date))
         WHEN 13 THEN CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * MONTH(start_date) - 2, 3), ' ''', SUBSTR(CAST(YEAR(start_date) AS STRING), 3, 2))
         WHEN 14 THEN CONCAT(YEAR(start_date), LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'), LPAD(CAST(DAY(start_date) AS STRING), 2, '0'))
         WHEN 15 THEN CONCAT(YEAR(start_date), '-', LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'), '-', LPAD(CAST(DAY(start_date) AS STRING), 2, '0'), 'T00:00:00')
         WHEN 16 THEN CONCAT(LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'), '-', YEAR(start_date))
         WHEN 17 THEN CONCAT(LPAD(CAST(DAY(start_date) AS STRING), 2, '0'), '/', LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'), '/', YEAR(start_date))
         WHEN 18 THEN CONCAT(LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'), '.', YEAR(start_date))
         WHEN 19 THEN CONCAT('Tuesday, ', SPLIT_PART('January,February,March,April,May,June,July,August,September,October,November,December', ',', MONTH(start_date)), ' ', DAY(start_date), ', ', YEAR(start_date))
         WHEN 20 THEN CONCAT(YEAR(start_date), '-', LPAD(CAST(MONTH(start_date) AS STRING), 2, '0'), '-', LPAD(CAST(DAY(start_date) AS STRING), 2, '0'), ' 10:30 PM')
         WHEN 21 THEN CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * MONTH(start_date) - 2, 3), '-', YEAR(start_date))
         WHEN 22 THEN CONCAT(DAY(start_date), ' ', SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * MONTH(start_date) - 2, 3), ' ', SUBSTR(CAST(YEAR(start_date) AS STRING), 3, 2))
         WHEN 23 THEN CONCAT('Smarch ', YEAR(start_date)) END AS date_text
FROM v_roles""",
    "v_resume_lines": """
SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS line_no, c_name AS text FROM customer
UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), 'Summary' FROM customer
UNION ALL SELECT c_custkey, CAST(2 AS BIGINT), '01/1990 - 01/2024' FROM customer
UNION ALL SELECT c_custkey, CAST(3 AS BIGINT), CONCAT('Skills: ', c_mktsegment, ', SQL, Figma, SQL, Skill ', c_custkey % 7, '.') FROM customer
UNION ALL SELECT c_custkey, CAST(4 AS BIGINT), 'Experience' FROM customer
UNION ALL SELECT o_custkey, 5 + 3 * o_orderkey, CONCAT('Acme Labs ', o_orderkey % 13) FROM orders
UNION ALL SELECT o_custkey, 6 + 3 * o_orderkey, o_orderpriority FROM orders
UNION ALL SELECT o_custkey, 7 + 3 * o_orderkey,
                 CONCAT(CASE o_orderkey % 3 WHEN 0 THEN CONCAT(LPAD(CAST(MONTH(o_orderdate) AS STRING), 2, '0'), '/', YEAR(o_orderdate)) WHEN 1 THEN CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * (MONTH(o_orderdate)) - 2, 3), ' ', YEAR(o_orderdate)) ELSE CONCAT(YEAR(o_orderdate), '-', LPAD(CAST(MONTH(o_orderdate) AS STRING), 2, '0')) END, CASE o_orderkey % 2 WHEN 0 THEN ' - ' ELSE ' – ' END,
                        CASE o_orderkey % 4 WHEN 0 THEN 'present' ELSE CASE o_orderkey % 3 WHEN 0 THEN CONCAT(LPAD(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0'), '/', YEAR(o_orderdate) + 1) WHEN 1 THEN CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * (o_orderkey % 12 + 1) - 2, 3), ' ', YEAR(o_orderdate) + 1) ELSE CONCAT(YEAR(o_orderdate) + 1, '-', LPAD(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0')) END END) FROM orders""",
    "v_api_calls": """
SELECT event_id AS call_id, ts, CASE event_type WHEN 'click' THEN 'serper' WHEN 'view' THEN 'groq' WHEN 'purchase' THEN 'hunter'
         WHEN 'signup' THEN 'hunter' ELSE 'other' END AS service,
       event_id % 7 <> 0 AS ok FROM events""",
    "v_feedback": """
SELECT event_id, ts, CONCAT('job-', user_id, '-poc-', event_id % 2) AS profile_key,
       CASE event_type WHEN 'error' THEN 'down' ELSE 'up' END AS vote FROM events""",
    "v_attempts": """
SELECT user_id * 1000 + CAST(FLOOR(event_id / 40) AS BIGINT) % 40 AS request_id, event_id % 4 AS model_no,
       event_id,
       CASE event_id % 5 WHEN 0 THEN CONCAT('<think>a', CHR(10), 'b</think>```json', CHR(10), props, CHR(10), '```')
         WHEN 1 THEN CONCAT('```', CHR(10), props, CHR(10), '```') WHEN 2 THEN props
         WHEN 3 THEN CONCAT('  ', props, '  ') ELSE 'no json here' END AS raw,
       CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'purchase' THEN NULL ELSE 200 END AS status,
       CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'API Timeout' WHEN 1 THEN 'Request Error'
         ELSE 'API limit reached' END END AS error
FROM events""",
    "v_attempt_logs": """
SELECT o_orderkey AS request_id, x.model_no, x.attempt_no, o_orderkey * 10 + x.place AS seq,
       CASE WHEN x.kind = 'ok' THEN '{"a": 1}' WHEN x.kind = 'bad' THEN 'no json' END AS raw,
       CASE x.kind WHEN 'ok' THEN 200 WHEN 'bad' THEN 200 WHEN 'busy' THEN 503 WHEN 'gone' THEN 404 END AS status,
       CASE x.kind WHEN 'slow' THEN 'API Timeout' WHEN 'odd' THEN 'Request Error' WHEN 'stop' THEN 'API limit reached' END AS error
FROM orders JOIN (
  SELECT 0 AS variant, 0 AS model_no, 1 AS attempt_no, 0 AS place, 'ok' AS kind
  UNION ALL SELECT 1, 0, 1, 0, 'busy' UNION ALL SELECT 1, 0, 2, 1, 'ok'
  UNION ALL SELECT 2, 0, 1, 0, 'bad' UNION ALL SELECT 2, 1, 1, 1, 'ok'
  UNION ALL SELECT 3, 0, 1, 0, 'odd' UNION ALL SELECT 3, 0, 2, 1, 'slow' UNION ALL SELECT 3, 1, 1, 2, 'gone' UNION ALL SELECT 3, 2, 1, 3, 'ok'
  UNION ALL SELECT 4, 0, 1, 0, 'stop'
  UNION ALL SELECT 5, 0, 1, 0, 'ok' UNION ALL SELECT 5, 1, 1, 1, 'ok'
  UNION ALL SELECT 6, 0, 1, 0, 'bad' UNION ALL SELECT 6, 2, 1, 1, 'ok'
  UNION ALL SELECT 7, 0, 1, 0, 'gone' UNION ALL SELECT 7, 0, 2, 1, 'ok'
  UNION ALL SELECT 8, 0, 1, 0, 'busy' UNION ALL SELECT 8, 0, 2, 1, 'busy' UNION ALL SELECT 8, 0, 3, 2, 'busy'
  UNION ALL SELECT 9, 0, 1, 0, 'busy' UNION ALL SELECT 9, 1, 1, 1, 'ok'
  UNION ALL SELECT 10, 0, 1, 0, 'stop' UNION ALL SELECT 10, 1, 1, 1, 'ok'
  UNION ALL SELECT 11, 0, 1, 1, 'bad' UNION ALL SELECT 11, 1, 1, 0, 'ok'
  UNION ALL SELECT 12, 1, 1, 0, 'slow' UNION ALL SELECT 12, 1, 2, 1, 'slow' UNION ALL SELECT 12, 3, 1, 2, 'odd') x
  ON o_orderkey % 13 = x.variant""",
    "v_drafts": """
SELECT CAST(FLOOR(event_id / 2) AS BIGINT) AS request_id, event_id % 2 + 1 AS attempt, event_type <> 'error' AS has_intent_line,
       CONCAT('Subject ', event_id) AS subject,
       CASE event_id % 3 WHEN 0 THEN CONCAT('I am writing to you about ', event_type)
         WHEN 1 THEN CONCAT('Given your news, ', REPEAT('word ', CAST(event_id % 120 AS INT))) ELSE NULL END AS body,
       CASE WHEN event_id % 2 = 0 THEN CONCAT('Mail about ', event_type) END AS email,
       CONCAT('notes ', props) AS critique_notes
FROM events""",
    "v_sse_lines": """
SELECT user_id AS session_id, event_id AS line_no, ts,
       CASE event_type WHEN 'signup' THEN CONCAT('data: {"id": "', event_id, '", "company": "c', user_id, '"}')
         WHEN 'error' THEN 'data: {"error": "boom"}' WHEN 'view' THEN 'data: {"status": "s"}'
         WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'data: {}' WHEN 1 THEN 'data: {"id": 0}' ELSE 'data: {broken' END
         ELSE CASE WHEN event_id % 20 = 0 THEN 'event: close' ELSE '' END END AS line
FROM events""",
    "v_contacts": """
SELECT CONCAT('Acme Labs ', c_custkey % (SELECT COUNT(*) FROM supplier)) AS company,
       CASE WHEN c_custkey % 7 = 0 THEN CONCAT('Acme Labs ', c_custkey) ELSE c_name END AS name,
       CASE c_custkey % 4 WHEN 0 THEN 'Product Manager' WHEN 1 THEN 'Recruiter' WHEN 2 THEN 'Growth Operations' ELSE 'Analyst' END AS role,
       CONCAT('https://www.linkedin.com/', CASE WHEN c_custkey % 6 = 0 THEN 'company/' ELSE 'in/' END, c_custkey) AS url,
       CASE WHEN c_custkey % 9 = 0 THEN CONCAT('Acme Labs ', c_custkey, ' of the city college')
            WHEN c_custkey % 5 = 4 THEN CONCAT('Acme Labs ', c_custkey % (SELECT COUNT(*) FROM supplier), ' | Analyst')
            ELSE CONCAT(CASE c_custkey % 5 WHEN 0 THEN 'Ex-' WHEN 1 THEN 'Former ' ELSE '' END, 'Manager at Acme Labs ',
              c_custkey % (SELECT COUNT(*) FROM supplier)) END AS snippet,
       CONCAT(c_name, ' - Manager - Acme') AS title,
       c_custkey AS rank
FROM customer""",
    "v_companies": """
SELECT s_suppkey AS company_id, CONCAT('Acme Labs ', s_suppkey) AS company,
       CASE s_suppkey % 3 WHEN 0 THEN 'Growth' WHEN 1 THEN 'Product' ELSE NULL END AS team FROM supplier""",
    "v_news": """
SELECT CONCAT('Acme Labs ', o_custkey % (SELECT COUNT(*) FROM supplier)) AS company, CONCAT('News ', o_orderkey) AS title,
       o_orderkey AS news_id, CAST(o_orderdate AS DATE) AS published_at FROM orders""",
    "v_asked": """
SELECT l_orderkey * 8 + l_linenumber AS request_id, CONCAT('Acme Labs ', MIN(l_suppkey)) AS company, CAST(MIN(l_shipdate) AS DATE) AS asked_on
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_skills": """
SELECT p_partkey AS profile_id, 0 AS ord, p_brand AS skill FROM part
UNION ALL SELECT p_partkey, 1, p_type FROM part""",
    "v_skill_edits": """
SELECT l_partkey AS profile_id, l_orderkey * 100 + l_linenumber AS edit_id,
       CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS op,
       CASE l_linenumber % 3 WHEN 0 THEN p.p_brand WHEN 1 THEN CASE WHEN l_returnflag = 'R' THEN p.p_type ELSE CONCAT(' ', p.p_type, ' ') END
         ELSE CONCAT('skill ', l_suppkey % 3) END AS skill
FROM lineitem JOIN part p ON l_partkey = p.p_partkey""",
    "v_role_edits": """
SELECT o_custkey AS profile_id, l_orderkey * 100 + l_linenumber AS edit_id,
       CASE WHEN l_linenumber = 7 THEN 'add' WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'remove' ELSE 'toggle' END AS op,
       CASE WHEN l_linenumber = 7 THEN -1 - l_orderkey ELSE l_orderkey END AS role_id,
       CASE WHEN l_linenumber = 7 THEN CONCAT(' New ', l_orderkey % 4, ' ') END AS title
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey""",
    "v_responses": """
SELECT o_orderkey AS response_id,
       CASE WHEN o_orderkey % 10 = 0 THEN '{"news": []}'
            ELSE CONCAT('{"organic": [{"title": "', o_orderpriority, '", "link": "https://x.example/', o_custkey, '"}, ',
                        '{"link": "https://y.example/', o_orderkey, '", "snippet": "', o_orderstatus, '"}]}') END AS body
FROM orders""",
}

def _parts(sql: str) -> str:
    """The SQL of the postings with a text's head, and in place of the text behind it what was read of its document."""
    for whole, part in ((" THEN d.text", " THEN ''"), (", CHR(10), d.text) END AS text", ", CHR(10)) END AS head, d.body"), ("JOIN documents d", "JOIN {bodies} d")):
        assert sql.count(whole) == 1
        sql = sql.replace(whole, part)
    return sql


_NEEDS = {name: [v for v in VIEWS if v != name and v in sql] for name, sql in VIEWS.items()}


def with_views(*names: str) -> str:
    """A WITH clause (without the closing comma) that defines the views and what they are built on."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)


_KNOWN: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Make the driver's tables known by name; once for the same session and folder in a row."""
    configure(spark)
    session = f"{spark.sparkContext.applicationId}/{id(spark)}"
    if _KNOWN.get(session) == sf_dir:
        return
    _KNOWN[session] = sf_dir
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, name: str) -> DataFrame:
    """A view or table as a DataFrame."""
    return spark.sql(f"{with_views(name)} SELECT * FROM {name}") if name in VIEWS else spark.table(name)


def posting_parts(spark: SparkSession, bodies: DataFrame) -> DataFrame:
    """The rows of `v_postings` with `head` and `body` instead of the text, from `doc_id, body` of all documents."""
    return spark.sql(f"{with_views('v_search_results')} {_parts(VIEWS['v_postings'])}", bodies=bodies)
