"""Checks of usage metering, attempts and drafts."""
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.checks import sql as o
from jobweave.checks.registry import query
from jobweave.operators.attempts import attempt_violations, check_drafts, choose_draft, classify_attempts, parse_outputs, resolve_attempts
from jobweave.operators.usage import admit_calls, alert_report, daily_usage, feedback_tally, latest_feedback, usage_alerts

# Limits small enough for the tables' traffic to reach them.
LIMITS = {"serper": 50, "hunter": 25, "groq": 40}
DEFAULT = 60

LIMIT = f"CASE service {' '.join(f'WHEN {o.quoted(s)} THEN {n}' for s, n in LIMITS.items())} ELSE {DEFAULT} END"

USAGE = f"""o_usage AS (
  SELECT day, service, CAST(sum(used) AS BIGINT) AS used FROM (
    SELECT CAST(ts AS DATE) AS day, service, count(*) AS used FROM v_api_calls WHERE ok GROUP BY ALL
    UNION ALL SELECT d.day, s.service, 0 FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM v_api_calls WHERE ok) d,
      (VALUES {', '.join(f"('{s}')" for s in LIMITS)}) s(service)) GROUP BY ALL)"""

ALERTS = f"""{USAGE}, o_alerts AS (
  SELECT day, service, used, used / {LIMIT} * 100 AS percent,
         printf('> [!WARNING]' || chr(10) || '> **%s** usage: %d/%d (%.1f%%). Limit alert triggered!', upper(service), used, {LIMIT}, used / {LIMIT} * 100) AS alert
  FROM o_usage WHERE service IN ({', '.join(map(o.quoted, LIMITS))}) AND used / {LIMIT} * 100 >= 60)"""

ADMITTED = f"""o_admitted AS (
  SELECT call_id, service, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY CAST(ts AS DATE), service ORDER BY ts, call_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {LIMIT} < 0.6 AS admitted FROM v_api_calls)"""


@query(o.ctes(USAGE, views=("v_api_calls",)) + "SELECT day::VARCHAR AS day, service, used FROM o_usage")
def usage_per_day(view, spark, sf_dir):
    """A-05"""
    return daily_usage(view("v_api_calls"), LIMITS).withColumn("day", F.col("day").cast("string"))


@query(o.ctes(ALERTS, views=("v_api_calls",)) + "SELECT day::VARCHAR AS day, service, used, round(percent, 6) AS percent, alert FROM o_alerts")
def usage_warnings(view, spark, sf_dir):
    """A-06"""
    return usage_alerts(daily_usage(view("v_api_calls"), LIMITS), LIMITS).select(
        F.col("day").cast("string").alias("day"), "service", "used", F.round("percent", 6).alias("percent"), "alert")


@query(o.ctes(ALERTS, views=("v_api_calls",)) + f"""SELECT day::VARCHAR AS day, '# API Usage Alerts - ' || day::VARCHAR || chr(10) || chr(10)
|| string_agg(alert, chr(10) || chr(10) ORDER BY list_position([{', '.join(map(o.quoted, LIMITS))}], service)) AS report FROM o_alerts GROUP BY day""")
def usage_report(view, spark, sf_dir):
    """A-07"""
    alerts = usage_alerts(daily_usage(view("v_api_calls"), LIMITS), LIMITS)
    return alert_report(alerts, LIMITS).withColumn("day", F.col("day").cast("string"))


@query(o.ctes(ADMITTED, views=("v_api_calls",)) + "SELECT call_id, service, admitted FROM o_admitted")
def admitted_calls(view, spark, sf_dir):
    """N-02"""
    return admit_calls(view("v_api_calls"), LIMITS, default_limit=DEFAULT).select("call_id", "service", "admitted")


@query(o.ctes(views=("v_feedback",)) + "SELECT profile_key, arg_max(vote, (ts, event_id)) AS vote FROM v_feedback GROUP BY profile_key")
def last_votes(view, spark, sf_dir):
    """A-10"""
    return latest_feedback(view("v_feedback"))


@query(o.ctes(views=("v_feedback",)) + """SELECT vote, count(*) AS contacts FROM (
SELECT profile_key, arg_max(vote, (ts, event_id)) AS vote FROM v_feedback GROUP BY profile_key) GROUP BY vote""")
def vote_tally(view, spark, sf_dir):
    """A-10: tally"""
    return feedback_tally(latest_feedback(view("v_feedback")))


@query(o.ctes(views=("v_attempts",)) + f"""SELECT event_id, content, json_valid(content) AS parsed,
CASE WHEN NOT json_valid(content) THEN 'Failed to parse JSON' END AS error FROM (SELECT event_id, {o.clean_output('raw')} AS content FROM v_attempts)""")
def cleaned_outputs(view, spark, sf_dir):
    """F-14"""
    return parse_outputs(view("v_attempts")).select("event_id", "content", "parsed", "error")


OUTCOME = f"""o_tried AS (
  SELECT *, {o.clean_output('raw')} AS content,
         CASE WHEN contains(lower(coalesce(error, '')), 'limit reached') THEN 'limit' WHEN contains(lower(coalesce(error, '')), 'timeout') THEN 'timeout'
              WHEN status >= 400 THEN 'http' WHEN coalesce(error, '') <> '' OR status IS NULL THEN 'request'
              WHEN raw IS NULL THEN 'bad format' WHEN NOT json_valid({o.clean_output('raw')}) THEN 'bad json' ELSE 'ok' END AS outcome
  FROM v_attempts)"""


@query(o.ctes(OUTCOME, views=("v_attempts",)) + "SELECT event_id, outcome FROM o_tried")
def call_outcomes(view, spark, sf_dir):
    """F-19"""
    return classify_attempts(view("v_attempts")).select("event_id", "outcome")


def _legal_sql(order: str, seq: str = "NULL::BIGINT") -> str:
    """Broken rules per request of o_tried, by looking at each attempt and those around it in order."""
    return f"""o_numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id, model_no ORDER BY {order}) AS attempt, {seq} AS place,
         coalesce(status IN (500, 503, 429), false) OR outcome = 'request' AS again FROM o_tried),
o_around AS (
  SELECT *, lag(model_no) OVER w AS model_before, lag(again) OVER w AS again_before, lag(outcome) OVER w AS outcome_before,
         lead(model_no) OVER w AS model_after, coalesce(bool_or(outcome = 'ok') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS good_before,
         count(*) OVER (PARTITION BY request_id) AS attempts,
         max(place) OVER (PARTITION BY request_id ORDER BY model_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place_before
  FROM o_numbered WINDOW w AS (PARTITION BY request_id ORDER BY model_no, attempt)),
o_legal AS (
  SELECT request_id, CAST(count(*) AS BIGINT) AS attempts, concat_ws(', ',
    CASE WHEN bool_or(attempt = 1 AND model_no <> coalesce(model_before + 1, 0)) THEN 'skipped model' END,
    CASE WHEN bool_or(place < place_before) THEN 'models mixed' END,
    CASE WHEN bool_or(outcome = 'limit' AND attempts > 1) THEN 'after limit' END, CASE WHEN bool_or(good_before) THEN 'after success' END,
    CASE WHEN bool_or(attempt = 2 AND NOT again_before AND outcome_before <> 'ok') THEN 'no reason to retry' END,
    CASE WHEN bool_or(attempt = 1 AND again AND model_no IS DISTINCT FROM model_after) THEN 'not retried' END,
    CASE WHEN bool_or(attempt > 2) THEN 'third attempt' END) AS violations
  FROM o_around GROUP BY request_id)"""


@query(o.ctes(OUTCOME, _legal_sql("event_id"), views=("v_attempts",)) + """,
o_good AS (SELECT request_id, arg_min(content, (model_no, attempt)) AS payload FROM o_numbered WHERE outcome = 'ok' GROUP BY ALL),
o_last AS (SELECT request_id, arg_max(outcome, (model_no, attempt)) AS outcome FROM o_numbered GROUP BY ALL)
SELECT l.request_id, g.payload, CASE WHEN g.request_id IS NULL THEN l.outcome END AS error, e.attempts, e.violations = '' AS log_ok
FROM o_last l JOIN o_legal e ON l.request_id = e.request_id LEFT JOIN o_good g ON l.request_id = g.request_id""")
def resolved_attempts(view, spark, sf_dir):
    """N-05: attempts in the order of their events."""
    return resolve_attempts(view("v_attempts").withColumn("attempt_no", F.col("event_id")))


@query(o.ctes(OUTCOME.replace("v_attempts", "v_attempt_logs"), _legal_sql("attempt_no", "seq"), views=("v_attempt_logs",))
       + "SELECT request_id, violations FROM o_legal")
def illegal_attempts(view, spark, sf_dir):
    """N-05: logs with every kind of violation, and legal ones."""
    return attempt_violations(view("v_attempt_logs"), "seq")


@query(o.ctes(views=("v_drafts",)) + """SELECT request_id, coalesce(subject, '') AS subject, coalesce(b, '') AS body, coalesce(critique_notes, '') AS critique_notes,
coalesce(has_intent_line, false) AS has_intent_line FROM (
  SELECT r.request_id, d.subject, d.critique_notes, d.has_intent_line, coalesce(d.body, d.email, '') AS b
  FROM (SELECT request_id, coalesce(bool_or(attempt = 1 AND has_intent_line), false) AS first_ok FROM v_drafts GROUP BY ALL) r
  LEFT JOIN v_drafts d ON d.request_id = r.request_id AND d.attempt = CASE WHEN first_ok THEN 1 ELSE 2 END)""")
def chosen_drafts(view, spark, sf_dir):
    """N-06"""
    return choose_draft(view("v_drafts"))


@query(o.ctes(views=("v_drafts",)) + f"""SELECT request_id, attempt, concat_ws(',', CASE WHEN {o.words('b')} > 100 THEN 'too long' END,
CASE WHEN regexp_matches(b, '(?i)^\\s*(?:{'|'.join(fixed.BANNED_OPENERS)})') THEN 'banned opener' END,
CASE WHEN NOT coalesce(has_intent_line, false) THEN 'no intent line' END) AS broken_rules
FROM (SELECT *, coalesce(body, email, '') AS b FROM v_drafts)""")
def draft_rules(view, spark, sf_dir):
    """F-15"""
    drafts = view("v_drafts").withColumn("body", F.coalesce("body", "email", F.lit("")))
    return check_drafts(drafts).select("request_id", "attempt", "broken_rules")
