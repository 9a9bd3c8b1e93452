"""Pieces of DuckDB SQL shared by the checking queries."""
from jobweave import fixed
from jobweave.checks.views import with_views


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{fixed.PY_SPACE}+|{fixed.PY_SPACE}+\\z', '', 'g')"


def py_title(x: str) -> str:
    runs = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '{runs}'), "
            "lambda w: CASE WHEN starts_with(w, 'ß') THEN 'Ss' ELSE upper(substr(w, 1, 1)) END || substr(w, 2)), '')")


def token_text(x: str) -> str:
    return f"(' ' || trim(regexp_replace(replace(lower({x}), '|', ' | '), '[^\\p{{L}}\\p{{N}}|]+', ' ', 'g')) || ' ')"


def company_from_url(url: str, source: str) -> str:
    def piece(host):
        return py_title(f"replace(split_part(split_part({url}, '{host}', 2), '/', 1), '-', ' ')")
    slug = f"split_part(split_part({url}, '/jobs/view/', 2), '?', 1)"
    employer = f"replace(regexp_replace(split_part({slug}, '-at-', 2), '-[^-]*$', ''), '-', ' ')"
    bare = f"replace(replace(split_part({url}, '.', 1), 'https://', ''), 'http://', '')"
    name = f"""CASE WHEN contains({url}, 'greenhouse.io/') THEN {piece('greenhouse.io/')}
      WHEN contains({url}, 'lever.co/') THEN {piece('lever.co/')}
      WHEN contains({url}, 'ashbyhq.com/') THEN {piece('ashbyhq.com/')}
      WHEN contains({url}, 'myworkdayjobs.com') THEN {py_title(bare)}
      WHEN contains({url}, 'smartrecruiters.com/') THEN {piece('smartrecruiters.com/')}
      WHEN contains({url}, 'linkedin.com') AND contains({slug}, '-at-') THEN {py_title(employer)}
      ELSE 'Unknown' END"""
    cut = py_strip(f"split_part(split_part({name}, ' Careers', 1), ' Jobs', 1)")
    return f"CASE WHEN {cut} IN ('', 'Unknown') AND coalesce({source}, '') <> '' THEN {source} ELSE {cut} END"


def parse_years(x: str) -> str:
    sp = fixed.PY_SPACE
    return f"""CASE WHEN {x} NOT IN ('Unknown', 'Not specified') THEN coalesce(
      TRY_CAST(nullif(regexp_extract({x}, '([0-9]+){sp}*[-–]{sp}*[0-9]+', 1), '') AS DOUBLE),
      TRY_CAST(nullif(regexp_extract({x}, '([0-9]+){sp}*\\+', 1), '') AS DOUBLE),
      TRY_CAST(nullif(regexp_extract({x}, '([0-9]+)', 1), '') AS DOUBLE)) END"""


def requirement(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '{fixed.REQUIREMENT}', 1), ''), 'Not specified')"


def senior_title(title: str, url: str) -> str:
    text = f"lower({title} || ' ' || {url})"
    return "(" + " OR ".join(f"contains({text}, {quoted(k)})" for k in fixed.SENIOR_KEYWORDS) + ")"


def gate_senior(title: str) -> str:
    words = "|".join(fixed.GATE_SENIOR_WORDS)
    return f"regexp_matches(lower({title}), '(^|[^a-z])(sr\\.|({words})([^a-z]|$))')"


def remote(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{fixed.REMOTE}'), false)"


LABEL = """CASE WHEN source = 'Board' THEN CASE WHEN contains(url, 'greenhouse') THEN 'Greenhouse' WHEN contains(url, 'lever') THEN 'Lever'
  WHEN contains(url, 'workday') THEN 'Workday' ELSE 'JobBoard' END ELSE source END"""

SOURCE_ORDER = "CASE source WHEN 'LinkedIn' THEN 0 WHEN 'Naukri' THEN 1 ELSE 2 END"

FITS = """CASE source WHEN 'LinkedIn' THEN contains(url, 'linkedin.com/jobs')
  WHEN 'Naukri' THEN contains(url, 'naukri.com') AND contains(url, '/job-listings-') ELSE url <> '' END"""

# First occurrence of every (query_id, url) among valid results.
UNIQUE = f"""o_unique AS (
  SELECT * EXCLUDE (rn, source_order) FROM (
    SELECT *, {SOURCE_ORDER} AS source_order,
           ROW_NUMBER() OVER (PARTITION BY query_id, url ORDER BY {SOURCE_ORDER}, rank, title) AS rn
    FROM v_search_results WHERE {FITS}) WHERE rn = 1)"""

WHOLE = "concat_ws(chr(10), location, text)"

def place_text(x: str) -> str:
    """Words with a blank on either side each, so that neighbours can be cut out one by one."""
    return f"(' ' || replace(trim({token_text(x)}), ' ', '  ') || ' ')"


def named(rows: str, key: str, text: str) -> str:
    """The one country that `text` names, per key; a place inside a longer one at the same spot does not count."""
    return f"""SELECT {key}, min(country) AS country FROM (SELECT {key}, {place_text(text)} AS tokens FROM {rows}) JOIN o_named_places
  ON contains(tokens, place) AND (len(longer) = 0 OR contains(list_reduce(list_prepend(tokens, longer), lambda t, q: replace(t, q, ' # ')), place))
  GROUP BY {key} HAVING count(DISTINCT country) = 1"""


def stated(*found: str) -> str:
    return f"nullif(array_to_string(list_sort(list_distinct(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))), ' / '), '')"


# Country named by location and by text of each posting; and by the location of each profile, whose years are rounded.
PLACES_OF = f"""o_place_words AS MATERIALIZED (SELECT DISTINCT country, {place_text('place')} AS place FROM v_places),
o_named_places AS MATERIALIZED (SELECT country, place, coalesce((
  SELECT list(DISTINCT o.place) FROM o_place_words o WHERE contains(o.place, p.place) AND o.place <> p.place), []) AS longer FROM o_place_words p),
o_in_body AS MATERIALIZED ({named("v_postings WHERE length(text) >= 100", "url", "text")}),
o_in_location AS MATERIALIZED ({named("v_postings WHERE length(text) >= 100 AND location IS NOT NULL", "url", "location")}),
o_places AS (
  SELECT v.url, l.country AS location_country, b.country AS body_country
  FROM (SELECT url FROM v_postings WHERE length(text) >= 100) v LEFT JOIN o_in_body b ON v.url = b.url LEFT JOIN o_in_location l ON v.url = l.url)"""

PROFILES = f"""o_profiles AS (
  SELECT p.* EXCLUDE (years, location), CAST(floor(coalesce(years, 0) + 0.5) AS INTEGER) AS years, c.country
  FROM v_profiles p LEFT JOIN ({named("v_profiles WHERE location IS NOT NULL", "profile_id", "location")}) c ON p.profile_id = c.profile_id)"""

# What the gates read of each posting with enough text.
FACTS = f"""{PLACES_OF}, o_facts AS (
  SELECT v.url, {requirement('text')} AS required_text, {parse_years(requirement('text'))} AS min_required,
         nullif(regexp_extract(text, '{fixed.COMPANY}', 1), '') AS company_found,
         nullif(regexp_extract(text, '{fixed.TEAM}', 1), '') AS team,
         {remote(WHOLE)} AS is_remote, location_country, body_country
  FROM v_postings v LEFT JOIN o_places p ON v.url = p.url WHERE length(text) >= 100)"""

# Search results with those facts.
JOBS = f"""{UNIQUE}, {FACTS}, o_in_title AS MATERIALIZED ({named('(SELECT DISTINCT title FROM v_search_results)', 'title', 'title')}),
o_jobs AS (
  SELECT u.query_id, u.source, u.rank, u.url, u.title, f.url IS NOT NULL AS has_text, f.required_text, f.min_required,
         f.company_found, f.team, t.country AS title_country, location_country, body_country,
         {stated('t.country', 'location_country', 'body_country')} AS job_country, coalesce(f.is_remote, false) AS is_remote,
         {SOURCE_ORDER} AS source_order, {senior_title('u.title', 'u.url')} AS title_senior,
         {gate_senior('u.title')} AS gate_senior
  FROM o_unique u LEFT JOIN o_facts f ON u.url = f.url LEFT JOIN o_in_title t ON u.title = t.title)"""


def stages(experience_gate: bool = True, tolerance: float = fixed.POST_TOLERANCE, on: str = "p.query_id = j.query_id") -> str:
    """Every (profile, result) with its stage, by brute force."""
    gate = "true"
    if experience_gate:
        gate = ("NOT (gate_senior AND years < 5) "
                f"AND coalesce(min_required <= years + {fixed.GATE_TOLERANCE}, true)")
    return f"""{JOBS}, {PROFILES}, o_stages AS (
  SELECT p.profile_id, p.years, p.country, j.*,
         CASE WHEN title_senior AND years < 5 THEN 'pre_filtered'
              WHEN NOT has_text THEN 'no_text'
              WHEN NOT ((NOT remote_only OR is_remote) AND coalesce(job_country = p.country, true) AND {gate}) THEN 'rejected'
              WHEN coalesce(min_required > years + {tolerance}, false) THEN 'post_filtered'
              ELSE 'matched' END AS stage
  FROM o_profiles p JOIN o_jobs j ON {on})"""


MATCHES = f"""{stages()}, o_matches AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY profile_id ORDER BY source_order, rank, url) AS pos
                 FROM o_stages WHERE stage = 'matched') WHERE pos <= 10)"""

# Current employees among the first ten results of each company.
CURRENT = f"""o_contacts AS (
  SELECT *, {token_text('snippet')} AS t, {token_text('company')} AS c, {token_text('name')} AS n
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company ORDER BY rank, url) AS result FROM v_contacts) WHERE result <= 10),
o_flags AS (
  SELECT *, (contains(t, ' at' || c) OR contains(t, c || '|'))
            AND NOT regexp_matches(CASE WHEN contains(t, c) THEN split_part(t, c, 1) ELSE t END || ' ', ' ({'|'.join(fixed.PAST_JOB)}) ')
            AS works_there,
         list_has_any(list_filter(string_split(trim(c), ' '), lambda w: w NOT IN ({', '.join(map(quoted, fixed.LEGAL_FORMS))})), string_split(trim(n), ' '))
         AND NOT list_has_any(list_filter(string_split(trim(c), ' '), lambda w: w NOT IN ({', '.join(map(quoted, fixed.LEGAL_FORMS))})),
                              string_split(trim(replace(t, n, ' ')), ' ')) AS collides
  FROM o_contacts),
o_current AS (SELECT * FROM o_flags WHERE contains(url, '/in/') AND works_there AND NOT collides)"""


def department_rank(role: str, team: str) -> str:
    words = "|".join(fixed.LEADERSHIP)
    return (f"CASE WHEN coalesce({team}, '') = '' THEN 0 WHEN contains({token_text(role)}, {token_text(team)}) THEN 0 "
            f"WHEN regexp_matches({token_text(role)}, ' ({words})s? ') THEN 1 END")


def best_contacts(targets: str) -> str:
    """The two best contacts of each (company, team) in `targets`."""
    return f"""{CURRENT}, o_best AS (
  SELECT * FROM (
    SELECT w.company, w.team, o.name, o.role, o.url, r.dept,
           ROW_NUMBER() OVER (PARTITION BY w.company, w.team ORDER BY r.dept, o.rank, o.url) AS pos
    FROM (SELECT DISTINCT company, team FROM {targets}) w JOIN o_current o ON o.company = w.company,
         LATERAL (SELECT {department_rank('o.role', 'w.team')} AS dept) r
    WHERE r.dept IS NOT NULL) WHERE pos <= 2)"""


def role_months(start: str, end: str) -> str:
    span = f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"
    whole = f"({span} - CASE WHEN {start} + to_months({span}) > {end} THEN 1 ELSE 0 END)"
    return f"CASE WHEN {whole} <= 0 AND {span} <> 0 THEN 1 ELSE greatest({whole}, 0) END"


def bucket(x: str, given: str | None = None) -> str:
    *upper, (_, lowest) = fixed.BUCKETS
    cases = " ".join(f"WHEN {x} >= {low} THEN '{label}'" for low, label in upper)
    return f"CASE {cases} ELSE {given or quoted(lowest)} END"


def clean_output(x: str) -> str:
    text = py_strip(f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")
    def inner(n):
        return py_strip(f"substr({text}, {n + 1}, greatest(length({text}) - {n + 3}, 0))")
    return f"CASE WHEN starts_with({text}, '```json') THEN {inner(7)} WHEN starts_with({text}, '```') THEN {inner(3)} ELSE {text} END"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{fixed.JS_SPACE}+'), lambda w: w <> ''))"


def ctes(*parts: str, views: tuple = ()) -> str:
    """WITH clause from views and named parts."""
    return with_views(*views) + "".join(",\n" + p for p in parts) + "\n"
