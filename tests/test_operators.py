"""Operators against brute force, hot groups included."""
import calendar
import datetime
import random

import pytest
from pyspark.sql import functions as F

from jobweave import functions as fn
from jobweave.operators import matching
from jobweave.operators.contacts import attach_contacts, attach_news_at, current_employee, department_rank, name_collision
from jobweave.operators.edits import apply_skill_edits
from jobweave.operators.experience import experience_by_title, total_experience
from jobweave.operators.ordered import dedupe_first, top_k
from jobweave.operators.resume import resume_roles, resume_sections, resume_skills
from jobweave.operators.usage import _calls_to_stop, admit_calls, alert_report, daily_usage, usage_alerts
from jobweave.operators.gates import Places, detect_places, stated_country
from jobweave.plans.resume import dated_roles, parse_resumes
from jobweave.sources.files import append_calls, read_call_lines, read_calls, write_results
from jobweave.sources.pages import assemble_pages, page_lines
from jobweave.sources.search import explode_results, resolve, resolve_text


def test_dedupe_and_top_k_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(40), rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, u int, r int, id int").repartition(6)
    best = {}
    for g, u, r, i in rows:
        best[g, u] = min(best.get((g, u), (r, i)), (r, i))
    assert {(x.g, x.u): (x.r, x.id) for x in dedupe_first(df, ["g", "u"], ["r", "id"]).collect()} == best
    want = {(g, p, row[3]) for g in range(5) for p, row in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[3]))[:7], 1)}
    for spread in (["id"], None):
        got = {(x.g, x.pos, x.id) for x in top_k(df, ["g"], ["r", "id"], 7, spread).collect()}
        assert got == want


def _random_world(seed):
    """Profiles and results of which one search and one country hold most."""
    rng = random.Random(seed)
    countries = ["A", "A", "A", "B", "C"]
    profiles = [(i, 0 if rng.random() < 0.5 else rng.randrange(4), rng.randrange(9), rng.choice(countries), rng.random() < 0.3)
                for i in range(60)]
    jobs = []
    for i in range(700):
        jobs.append((0 if rng.random() < 0.5 else rng.randrange(4), rng.randrange(3), rng.randrange(200), f"u{i:04d}",
                     rng.random() < 0.2, rng.random() < 0.1, rng.choice([None, 0.0, 1.0, 3.0, 5.0, 8.0]),
                     rng.choice([None, *countries]), rng.random() < 0.4, rng.random() < 0.9))
    return profiles, jobs


def _stage(p, j, gate=True, tolerance=1.5):
    _, _, years, country, remote_only = p
    *_, senior, gsenior, req, where, remote, has_text = j
    if senior and years < 5:
        return "pre_filtered"
    if not has_text:
        return None
    if remote_only and not remote or where not in (None, country):
        return None
    if gate and (gsenior and years < 5 or req is not None and req > years + 1):
        return None
    return "post_filtered" if req is not None and req > years + tolerance else "matched"


P_SCHEMA = "profile_id int, query_id int, years int, country string, remote_only boolean"
J_SCHEMA = ("query_id int, source_order int, rank int, url string, title_senior boolean, gate_senior boolean, "
            "min_required double, job_country string, is_remote boolean, has_text boolean")


@pytest.mark.parametrize("seed, gate", [(1, True), (2, False)])
def test_match_and_funnel_equal_the_loop(spark, seed, gate):
    profiles, jobs = _random_world(seed)
    pdf, jdf = spark.createDataFrame(profiles, P_SCHEMA), spark.createDataFrame(jobs, J_SCHEMA).repartition(5)
    matches, counts = set(), {}
    for p in profiles:
        tally = dict(matched=0, pre_filtered=0, post_filtered=0)
        for j in sorted((j for j in jobs if j[0] == p[1]), key=lambda j: j[1:4]):
            if tally["matched"] >= 10:
                break
            stage = _stage(p, j, gate)
            if stage:
                tally[stage] += 1
                if stage == "matched":
                    matches.add((p[0], tally["matched"], j[3]))
        counts[p[0]] = tuple(tally.values())
    got = matching.match(pdf, jdf, experience_gate=gate)
    assert {(r.profile_id, r.pos, r.url) for r in got.collect()} == matches
    fun = matching.funnel(pdf, jdf, experience_gate=gate).collect()
    assert {r.profile_id: (r.matched, r.pre_filtered, r.post_filtered) for r in fun} == counts
    n = matching.match_count(pdf, jdf, experience_gate=gate).collect()
    assert {r.profile_id: r.matches for r in n} == {k: v[0] for k, v in counts.items()}


def test_funnel_of_one_hot_search_by_source_with_years_in_parts(spark, monkeypatch):
    """All results in one search, years that are not whole, blocks of a few positions, a group without a name."""
    monkeypatch.setattr(matching, "BLOCK", 7)
    monkeypatch.setattr(matching, "NEEDS", 4)
    profiles, jobs = _random_world(5)
    profiles = [(i, 0, i * 0.17, country, remote) for i, _, _, country, remote in profiles]
    jobs = [(0, *j[1:]) for j in jobs]
    name = {j[3]: [None, "x", "y"][n % 3] for n, j in enumerate(jobs)}
    want = {}
    for p in profiles:
        found = 0
        for j in sorted(jobs, key=lambda j: j[1:4]):
            stage = found < 10 and _stage(p, j, gate=False)
            if stage:
                found += stage == "matched"
                row = want.setdefault((p[0], name[j[3]]), dict(matched=0, pre_filtered=0, post_filtered=0))
                row[stage] += 1
    pdf = spark.createDataFrame(profiles, P_SCHEMA.replace("years int", "years double"))
    jdf = spark.createDataFrame([(*j, name[j[3]]) for j in jobs], J_SCHEMA + ", label string")
    got = matching.funnel(pdf, jdf, by=("label",)).collect()
    assert {(r.profile_id, r.label): (r.matched, r.pre_filtered, r.post_filtered) for r in got} == {k: tuple(v.values()) for k, v in want.items()}


def test_what_is_told_of_a_posting_is_told_before_profiles_join(spark):
    profiles, jobs = (spark.createDataFrame(rows, schema) for rows, schema in zip(_random_world(5), (P_SCHEMA, J_SCHEMA)))
    told = {"told": F.regexp_extract("url", "([0-9]+)", 1)}
    got = matching.match(profiles, jobs, told=told)
    want = matching.match(profiles, jobs).withColumns(told)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 0
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert lines[0].startswith("Project") and "regexp_extract" not in lines[0] and any("regexp_extract" in line for line in lines[1:])


def test_match_plan_has_no_pairwise_join(spark):
    profiles, jobs = _random_world(3)
    df = matching.match(spark.createDataFrame(profiles, P_SCHEMA), spark.createDataFrame(jobs, J_SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_expected_experience(spark):
    """Three active roles of 5, 8 and 7 months under two titles."""
    d = datetime.date
    roles = spark.createDataFrame([
        (1, "Product Manager", d(2025, 4, 1), d(2025, 9, 1)), (1, "Associate Product Manager", d(2023, 9, 1), d(2024, 5, 1)),
        (1, "Associate Product Manager", d(2023, 1, 1), d(2023, 8, 1))],
        "profile_id int, title string, start_date date, end_date date")
    by_title = experience_by_title(roles)
    assert {r.title: float(r.years) for r in by_title.collect()} == {"Product Manager": 0.42, "Associate Product Manager": 1.25}
    total = total_experience(by_title).collect()[0]
    assert (float(total.total_years), total.bucket) == (1.67, "1-3 years")


RESUME = """Ann Example
Summary
Product person, 01/2010 - 01/2020 elsewhere
01/2010 - 01/2020

Skills: Prototyping, SQL, Figma, SQL.

Experience
Blue Labs
Product Manager
04/2025 - 09/2025

Green Works
Associate Product Manager
09/2023 - 05/2024

Grey Works
Associate Product Manager
01/2023 – 08/2023
Education
01/2001 - 01/2005"""


def test_roles_of_several_date_layouts(spark):
    ranges = {"Jan 2019 - Present": ("Jan 2019", "Present"), "2012-01 - 2013-02": ("2012-01", "2013-02"), "2015–2017": ("2015", "2017"),
              "3 March 2015 to Sept. 2017": ("3 March 2015", "Sept. 2017"), "MAY '19 — now": ("MAY '19", "now"), "04/2025-09/2025": ("04/2025", "09/2025"),
              "2019 was a year": None, "since 2019 - 2020": None, "Maytag 2019 x - 2020": None}
    lines = [(1, 0, "Experience")]
    for i, r in enumerate(ranges):
        lines += [(1, 3 * i + 1, f"Company {i}"), (1, 3 * i + 2, f"Title {i}"), (1, 3 * i + 3, r)]
    roles = resume_roles(spark.createDataFrame(lines, "doc_id int, line_no int, text string"))
    got = {r.title: (r.company, r.start_date, r.end_date) for r in roles.collect()}
    assert got == {f"Title {i}": (f"Company {i}", *ends) for i, ends in enumerate(ranges.values()) if ends}
    dated = {r.title: (str(r.start_date), str(r.end_date)) for r in dated_roles(roles, "2024-02-01").collect()}
    assert dated["Title 0"] == ("2019-01-01", "2024-02-01") and dated["Title 3"] == ("2015-03-03", "2017-09-01") and dated["Title 2"] == ("2015-01-01", "2017-01-01")


def test_roles_at_the_edges_of_blocks_and_of_repeated_lines(spark):
    rng = random.Random(3)
    lines = [(d, 0, "Experience") for d in range(3)]
    for d in range(3):
        for n in [*range(1010, 1040), *range(2040, 2060)]:
            lines += [(d, n, rng.choice([f"Text {n} {i} ", "2012-01 - 2013-02", "03/2015 - now", None])) for i in range(rng.choice([0, 1, 1, 1, 2]))]
    lines += [(0, None, "2012-01 - 2013-02"), (None, 7, "x")]
    df = spark.createDataFrame(lines, "doc_id int, line_no bigint, text string").withColumn("section", F.lit("experience"))
    texts, want = {}, {}
    for d, n, text in lines:
        if text is not None and n is not None:
            texts.setdefault((d, n), []).append(text)
    for (d, n), found in texts.items():
        dates = [x for x in found if " - " in x]
        if dates:
            title, company = (max(texts[d, n - i]).strip() if (d, n - i) in texts else None for i in (1, 2))
            want[d, n] = (title, company, *max(dates).split(" - "))
    roles = resume_roles(df, df)
    got = [((r.doc_id, r.line_no), (r.title, r.company, r.start_date, r.end_date)) for r in roles.where("line_no is not null").collect()]
    assert len(got) == len(want) and dict(got) == want
    assert [tuple(r)[2:] for r in roles.where("line_no is null").collect()] == [("2012-01 - 2013-02", "2012-01 - 2013-02", "2012-01", "2013-02")]
    # one sort holds a line once: no line is sent to several positions and sorted again there
    plan = roles._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("+- Sort ") == 1


def test_resume_pages_to_totals(spark):
    lines = RESUME.split("\n")
    pages = [(7, 0, "\n".join(lines[:9])), (7, 1, ""), (7, 2, "\n".join(lines[9:]))]
    df = spark.createDataFrame(pages, "doc_id int, page_no int, text string")
    text = assemble_pages(df, "doc_id", "page_no", "text")
    assert text.collect()[0].text == RESUME + "\n"
    rows = page_lines(df, "doc_id", "page_no", "text")
    assert [r.text for r in rows.orderBy("line_no").collect()] == lines
    assert [r.line_no for r in rows.orderBy("line_no").collect()] == list(range(len(lines)))
    sections = resume_sections(rows)
    roles = resume_roles(rows, sections).orderBy("line_no")
    assert [(r.title, r.company, r.start_date) for r in roles.collect()] == [
        ("Product Manager", "Blue Labs", "04/2025"), ("Associate Product Manager", "Green Works", "09/2023"),
        ("Associate Product Manager", "Grey Works", "01/2023")]
    assert [r.skill for r in resume_skills(sections).orderBy("line_no", "pos").collect()] == ["Prototyping", "SQL", "Figma"]
    total = parse_resumes(df, "2026-01-01").collect()[0]
    assert (float(total.total_years), total.bucket) == (1.67, "1-3 years")
    assert dated_roles(roles, "2026-01-01").count() == 3


def test_sections_of_a_long_document(spark):
    lines = [(1, n, "Skills" if n == 10 else "Experience" if n == 2500 else f"line {n}") for n in range(5000)]
    got = resume_sections(spark.createDataFrame(lines, "doc_id int, line_no bigint, text string")).groupBy("section").count()
    assert {r.section: r["count"] for r in got.collect()} == {None: 10, "skills": 2490, "experience": 2500}


@pytest.mark.parametrize("cut", range(1, 12))
def test_roles_across_every_page_seam(spark, cut):
    lines = RESUME.split("\n")
    whole = spark.createDataFrame([(7, 0, RESUME)], "doc_id int, page_no int, text string")
    parts = spark.createDataFrame([(7, 9_998, "\n".join(lines[:cut])), (7, 10_001, "\n".join(lines[cut:]))], "doc_id int, page_no int, text string")
    def roles(pages):
        rows = page_lines(pages, "doc_id", "page_no", "text")
        return [tuple(r) for r in resume_roles(rows, resume_sections(rows)).orderBy("line_no").collect()]
    assert roles(parts) == roles(whole)


def test_quota_above_a_thousand(spark):
    t0 = datetime.datetime(2024, 1, 1, 8)
    calls = spark.range(6000).selectExpr("id AS call_id", f"timestamp'{t0}' + make_interval(0, 0, 0, 0, 0, 0, int(id / 700)) AS ts", "'groq' AS service", "id % 3 <> 0 AS ok")
    got = admit_calls(calls, {"groq": 4000}, share=0.6)
    assert got.filter("admitted").agg({"call_id": "max"}).first()[0] == 3599  # the 2400th good call
    assert got.filter("admitted").count() == 3600


def test_long_inputs_take_linear_time(spark):
    n = 300_000
    texts = ["at " + "Aa " * n, "a@" + "b." * n + "com", "x" * n + "@", "a." * n, "+1" * n, "<nav>" * 20_000, "&amp;" * n, "About " + "A" * n]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    t = F.col("t")
    got = df.select(F.length(fn.extract_company(t)), F.size(fn.extract_emails(t)), F.length(fn.redact(t)), fn.extract_team(t), fn.extract_requirement(t))
    assert len(got.collect()) == len(texts)


def test_quota_admits_the_first_fifteen_of_twenty_five(spark):
    t0 = datetime.datetime(2024, 1, 1, 8)
    calls = [(i, t0 + datetime.timedelta(minutes=i), "hunter", True) for i in range(20)]
    calls += [(100 + i, t0 + datetime.timedelta(minutes=i, seconds=30), "hunter", False) for i in range(20)]
    calls += [(200, t0 + datetime.timedelta(days=1), "hunter", True)]
    df = spark.createDataFrame(calls, "call_id int, ts timestamp, service string, ok boolean")
    admitted = {r.call_id for r in admit_calls(df).filter("admitted").collect()}
    assert admitted == set(range(15)) | {100 + i for i in range(14)} | {200}


def test_quota_equals_the_loop(spark):
    rng = random.Random(5)
    t0 = datetime.datetime(2024, 1, 1)
    calls = [(i, t0 + datetime.timedelta(minutes=rng.randrange(3000)), rng.choice("aaaabc"), rng.random() < 0.8) for i in range(900)]
    limits, used, expected = {"a": 100, "b": 7}, {}, {}
    for i, ts, s, ok in sorted(calls, key=lambda c: (c[1], c[0])):
        day = (ts.date(), s)
        expected[i] = used.get(day, 0) / limits.get(s, 50) < 0.6
        used[day] = used.get(day, 0) + ok
    df = spark.createDataFrame(calls, "call_id int, ts timestamp, service string, ok boolean")
    assert {r.call_id: r.admitted for r in admit_calls(df, limits, default_limit=50).collect()} == expected


def test_calls_to_stop():
    for limit in range(1, 400):
        n = _calls_to_stop(limit, 0.6)
        assert n / limit >= 0.6 and (n - 1) / limit < 0.6


def test_usage_report(spark):
    day = datetime.datetime(2024, 1, 1)
    calls = [(i, day, "hunter", True) for i in range(15)] + [(99, day, "other", True)]
    usage = daily_usage(spark.createDataFrame(calls, "call_id int, ts timestamp, service string, ok boolean"))
    assert {r.service: r.used for r in usage.collect()} == {"hunter": 15, "other": 1, "serper": 0, "groq": 0}
    report = alert_report(usage_alerts(usage)).collect()[0].report
    assert report == ("# API Usage Alerts - 2024-01-01\n\n> [!WARNING]\n> **HUNTER** usage: 15/25 (60.0%). Limit alert triggered!")


def test_skill_edits(spark):
    skills = spark.createDataFrame([(1, "SQL", 0), (1, "Go", 1)], "profile_id int, skill string, ord int")
    edits = spark.createDataFrame([
        (1, 1, "add", " SQL "), (1, 2, "remove", "Go"), (1, 3, "add", "Rust"), (1, 4, "add", "Go"), (1, 5, "add", " "),
        (1, 6, "remove", "Rust")], "profile_id int, edit_id int, op string, skill string")
    got = apply_skill_edits(skills, edits).orderBy("added", "ord").collect()
    assert [r.skill for r in got] == ["SQL", "Go"]


def test_contact_rules(column):
    rows = [("PM at Acme Labs 1", "Acme Labs 1"), ("PM at Acme Labs 12", "Acme Labs 1"), ("Ex-PM at Acme", "Acme"), ("Acme | PM", "Acme"),
            ("Worked at Acme", "Acme"), ("PM at Acme. Former Blue", "Acme"), ("Studied Acme", "Acme"), (None, "Acme"), ("at", "")]
    assert column(current_employee, rows, "s string, c string") == [True, False, False, True, False, True, False, False, False]
    rows = [("Fam Singh", "Fam Singh, analyst", "Fam Inc"), ("Fam Singh", "PM at Fam Inc", "Fam Inc"), ("Ann", "PM at Fam", "Fam")]
    assert column(name_collision, rows, "n string, s string, c string") == [True, False, False]
    rows = [("Growth Analyst", "Growth"), ("Recruiter", "Growth"), ("Sales Operations", "Growth"), ("Sales Operations", None)]
    assert column(department_rank, rows, "r string, d string") == [0, 1, None, 0]


def test_matches_without_contacts_stay(spark):
    matches = spark.createDataFrame([(1, "Acme", None), (2, "Blue", "Growth")], "profile_id int, company string, team string")
    contacts = spark.createDataFrame([("Acme", None, "Lead", "https://x/in/1", "Lead at Acme", 1)],
                                     "company string, name string, role string, url string, snippet string, rank int")
    got = {r.profile_id: [tuple(c) for c in r.contacts] for r in attach_contacts(matches, contacts).collect()}
    assert got == {1: [("Unknown", "Lead", "https://x/in/1")], 2: []}


def test_places(spark):
    places = spark.createDataFrame([("New Delhi", "India"), ("India", "India"), ("Spain", "Spain"), ("United Lands of the Far North", "North")], "place string, country string")
    df = spark.createDataFrame([("New Delhi, India",), ("Spain or India",), ("Remote",), (None,), ("off the united lands of the far north, remote",),
                                ("united lands of the far",)], "location string")
    assert {r.location: r.country for r in detect_places(df, "location", "location", places).collect()} == {
        "New Delhi, India": "India", "off the united lands of the far north, remote": "North"}


def test_places_by_field_and_longest_first(spark):
    places = spark.createDataFrame([("Guinea", "Guinea"), ("Papua New Guinea", "PNG"), ("Guinea Bissau", "Bissau"), ("New Delhi", "India"), ("India", "India"),
                                    ("Paris", "France"), ("Paris", "USA"), ("", "None"), (None, "None"), ("Texas", "USA")], "place string, country string")
    texts = [("Papua New Guinea", "office in Guinea", None), ("guinea bissau", "Guinea-Bissau, GUINEA BISSAU!", ""), ("Paris", "Paris, Texas", "New Delhi india"),
             ("Papua New Guinea Bissau", "new guinea guinea bissau", "nowhere"), (None, None, None)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, a string, b string, c string")
    want = {0: ("PNG", "Guinea", None), 1: ("Bissau", "Bissau", None), 2: (None, None, "India"), 3: ("PNG", None, None)}
    for most in (10_000, 2):  # by a list of first words, and by a join on every word
        known = Places(places, most)
        begun = df.select("id", *[known.begins(F.col(c)).alias(c) for c in "abc"])
        got = known.countries(begun, ["id"], {"x": "a", "y": "b", "z": "c"}).collect()
        assert {r.id: (r.x, r.y, r.z) for r in got} == want
    both = df.select(stated_country(F.lit("B"), F.lit(None).cast("string"), F.lit("A")).alias("two"), stated_country(F.lit("A"), F.lit("A")).alias("one"),
                     stated_country(F.lit(None).cast("string")).alias("none")).first()
    assert tuple(both) == ("A / B", "A", None)


def test_news_of_each_requests_own_day(spark):
    rng, day = random.Random(11), datetime.date(2024, 1, 31)
    news = [(f"c{0 if rng.random() < .6 else rng.randrange(4)}", f"t{i}", i, None if i == 5 else day + datetime.timedelta(rng.randrange(-300, 300))) for i in range(400)]
    asked = [(i, f"c{0 if rng.random() < .6 else rng.randrange(5)}", None if i == 3 else day + datetime.timedelta(rng.randrange(-100, 250))) for i in range(150)]
    ndf = spark.createDataFrame(news, "company string, title string, news_id int, published_at date")
    adf = spark.createDataFrame(asked, "request_id int, company string, asked_on date")

    def months_before(d, n):
        y, m = divmod(d.year * 12 + d.month - 1 - n, 12)
        return datetime.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))

    want = {i: [x[1] for x in sorted((x for x in news if x[0] == c and d and x[3] and months_before(d, 6) < x[3] <= d), key=lambda x: (-x[3].toordinal(), x[2]))[:3]]
            for i, c, d in asked}
    assert {r.request_id: r.news for r in attach_news_at(adf, ndf).collect()} == want
    # no pairs of requests and items, and no requests repeated by month
    plan = attach_news_at(adf, ndf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_search_sources(spark):
    body = '{"organic": [{"title": "A", "link": "l1"}, {"link": "l2", "snippet": "s"}]}'
    df = spark.createDataFrame([(1, body), (2, "{}"), (3, "broken")], "q int, body string")
    assert [(r.q, r["rank"], r.url, r.title) for r in explode_results(df, "body").orderBy("rank").collect()] == [(1, 0, "l1", "A"), (1, 1, "l2", "")]
    news = spark.createDataFrame([(1, '{"news": [{"title": "N", "link": "l", "date": "1 day"}]}')], "q int, body string")
    assert explode_results(news, "body", "news").collect()[0].date == "1 day"
    urls = spark.createDataFrame([("https://linkedin.com/1",), ("b",), ("c",), ("d",)], "url string")
    primary = spark.createDataFrame([("https://linkedin.com/1", "p"), ("b", "p")], "url string, text string")
    fallback = spark.createDataFrame([("https://linkedin.com/1", "f"), ("c", "f")], "url string, text string")
    assert {r.url: r.text for r in resolve_text(urls, primary, fallback).collect()} == {
        "https://linkedin.com/1": "f", "b": "p", "c": "f", "d": ""}


def test_usage_files(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_calls(spark, path).count() == 0
    calls = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "groq", True)], "call_id bigint, ts timestamp, service string, ok boolean")
    append_calls(calls, path, 0)
    append_calls(calls, path, 1)
    append_calls(calls, path, 1)  # the same batch once more
    assert read_calls(spark, path).count() == 2 and read_calls(spark, path).columns == ["call_id", "ts", "service", "ok", "day"]
    append_calls(calls, path, "late")
    (tmp_path / "log" / "batch=late" / "_SUCCESS").unlink()  # as a writer that died midway leaves it
    assert read_calls(spark, path).count() == 2
    append_calls(calls, path, "late")
    assert read_calls(spark, path).count() == 3
    lines = tmp_path / "lines.json"
    lines.write_text('{"call_id": 1, "ts": "2024-01-01T00:00:00", "service": "groq", "ok": true}\nnot json\n')
    assert [r.service for r in read_call_lines(spark, str(lines)).collect()] == ["groq"]
    write_results(calls, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_postings_in_two_parts_have_the_facts_of_the_whole_text(spark):
    """What begins in the head may reach into the body; every pair must give what the whole text gives, by pattern and by join."""
    places = spark.createDataFrame(
        [(f"NATION_{i}", f"N{i}") for i in range(1, 5)] + [("New NATION_3", "N9"), ("United Lands of Region 0 North", "N1"), ("NATION_4", "N5")],
        "place string, country string")
    heads = ["", "Needs 5\n", "work at\n", "Team:\n", "Based in New\n", "New NATION_1\nin united\n", "remote\n", "About Acme\n3 -\n", "in nation\n"]
    bodies = ["years of work", "4 Yrs at Blue Co", "Acme Labs rules", "Growth", "Nation 3 is big, nation 3 too", "3 or nation 2", "", None,
              "lands of region 0 north, nation 1", "Remote for nation 1|nation_2", "12+ years\nTeam: Core"]
    filler = " and so on" * 12
    rows = [(f"{i}/{j}", h, None if b is None else b + filler * (j % 4 != 3), (None, "Nation 2", "WFH")[(i + j) % 3], j)
            for i, h in enumerate(heads) for j, b in enumerate(bodies)]
    parts = spark.createDataFrame(rows, "url string, head string, text string, location string, doc_id int")
    whole = parts.select("url", F.concat("head", "text").alias("text"), "location")
    known = Places(places)
    shared = matching.read_bodies(parts.select("doc_id", "text").distinct(), known)
    split = parts.select("url", "head", "location", "doc_id").join(shared, "doc_id")
    columns = ["url", "required_text", "min_required", "company_found", "team", "is_remote", "location_country", "body_country"]

    def facts(postings, known):
        return sorted(map(tuple, matching.posting_facts(postings, known).select(columns).collect()), key=str)

    got = facts(split, known)
    assert got == facts(whole, known) == facts(whole, Places(places, 0)) and len(got) > 60
    by_url = {r[0]: dict(zip(columns, r)) for r in got}
    assert by_url["1/0"]["required_text"] == "5\nyears" and by_url["2/2"]["company_found"] == "Acme Labs"
    assert by_url["4/4"]["body_country"] is None and by_url["8/5"]["body_country"] is None and by_url["5/8"]["body_country"] == "N1"


def test_parts_are_read_for_results_only_and_give_what_whole_texts_give(spark):
    """Results without a posting, with a short one, and with several of one URL; postings that no result has."""
    places = spark.createDataFrame([(f"NATION_{i}", f"N{i}") for i in range(1, 4)], "place string, country string")
    texts = [(0, "long enough in nation 2" + " and so on" * 12), (1, "short"), (2, None), (3, "4 years at Blue Co" + " and so on" * 12)]
    heads = [("a", "Needs 5 years\n", "Nation 1", 0), ("a", "", None, 1), ("b", "remote\n", None, 1), ("c", "", "WFH", 2), ("d", "", "WFH", 3),
             ("d", "About Acme\nin nation 3\n", None, 3), ("unfound", "Needs 9 years\n", None, 0), (None, "", None, 0)]
    results = [(1, "a", "Board", 1, "Senior in nation 2"), (2, "a", "LinkedIn", 2, None), (1, "b", "Board", 3, "b"), (1, "c", "Naukri", 4, "c"),
               (1, "d", "Board", 5, "d"), (1, "none", "Board", 6, "e"), (1, None, "Board", 7, "f")]
    results = spark.createDataFrame(results, "query_id int, url string, source string, rank int, title string")
    parts = spark.createDataFrame(heads, "url string, head string, location string, doc_id int")
    docs, known = spark.createDataFrame(texts, "doc_id int, text string"), Places(places)
    split = parts.join(matching.read_bodies(docs, known), "doc_id")
    whole = parts.join(docs, "doc_id").select("url", F.concat("head", "text").alias("text"), "location")
    got = matching.with_title(matching.parts_of_results(results, split, known), known)
    want = matching.with_text(results, matching.posting_facts(whole, known), known)

    def rows(df):
        return sorted((tuple(r) for r in df.select(sorted(want.columns)).collect()), key=str)

    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert {r.url: r.has_text for r in got.collect()} == {"a": True, "b": False, "c": False, "d": True, "none": False, None: False}
    with pytest.raises(Exception, match="a head must end with its line"):
        odd = split.withColumn("head", F.lit("no line end"))
        matching.parts_of_results(results, odd, known).collect()


def test_resolve_takes_what_was_made_of_the_text_that_counts(spark):
    value = F.when(F.col("text").isNotNull(), F.struct(F.length("text").alias("chars"), F.nullif("text", F.lit("aa")).alias("kept"))).alias("value")
    primary = spark.createDataFrame([("a", "aa"), ("b", None), ("linkedin.com/c", "cc")], "url string, text string").select("url", value)
    fallback = spark.createDataFrame([("a", "longer"), ("b", "bbb"), ("linkedin.com/c", "cccc")], "url string, text string").select("url", value)
    urls = spark.createDataFrame([("a",), ("b",), ("linkedin.com/c",), ("d",)], "url string")
    got = {r.url: r.value and tuple(r.value) for r in resolve(urls, primary, fallback, "value").collect()}
    assert got == {"a": (2, None), "b": (3, "bbb"), "linkedin.com/c": (4, "cccc"), "d": None}
