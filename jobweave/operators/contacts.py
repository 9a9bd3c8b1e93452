"""Contacts, referrers and news of companies."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions import company_domain, referrer_name, token_text
from jobweave.operators.filters import profile_urls, verified
from jobweave.operators.ordered import top_k


def current_employee(snippet: Column, company: Column) -> Column:
    """P-13: `at <company>` or `<company> |` occurs, and no word for a past job stands before the company."""
    text, name = token_text(snippet), token_text(company)
    now = F.contains(text, F.concat(F.lit(" at"), name)) | F.contains(text, F.concat(name, F.lit("|")))
    before = F.split_part(text, name, F.lit(1))
    past = F.concat(before, F.lit(" ")).rlike(rf" ({'|'.join(fixed.PAST_JOB)}) ")
    return F.coalesce((name != "  ") & now & ~past, F.lit(False))


def name_collision(name: Column, snippet: Column, company: Column) -> Column:
    """P-14: the company's words occur in the person's name only."""
    person = token_text(name)
    rest = F.replace(token_text(snippet), person, F.lit(" "))
    core = F.array_except(F.split(F.trim(token_text(company)), " "), F.array(*map(F.lit, fixed.LEGAL_FORMS)))
    return F.coalesce(F.arrays_overlap(core, F.split(F.trim(person), " "))
                      & ~F.arrays_overlap(core, F.split(F.trim(rest), " ")), F.lit(False))


def department_rank(role: Column, department: Column) -> Column:
    """P-15: 0 for the wanted department, 1 for people who lead or recruit, null for others."""
    text = token_text(role)
    leads = text.rlike(rf" ({'|'.join(fixed.LEADERSHIP)})s? ")
    return (F.when(F.coalesce(department, F.lit("")) == "", 0)
            .when(F.contains(text, token_text(department)), 0)
            .when(leads, 1))


def parse_contacts(contacts: DataFrame, k: int = fixed.MAX_SNIPPETS) -> DataFrame:
    """T-02, P-13, P-14, P-16, P-17: current employees among the first k results of each company."""
    firsts = top_k(contacts, ["company"], ["rank", "url"], k, ["url"], pos="result")
    name, snippet, company = F.col("name"), F.col("snippet"), F.col("company")
    flagged = profile_urls(firsts).withColumn(
        "is_current_employee", current_employee(snippet, company) & ~name_collision(name, snippet, company))
    return verified(flagged, "is_current_employee")


def top_contacts(contacts: DataFrame, targets: DataFrame, k: int = fixed.MAX_CONTACTS) -> DataFrame:
    """T-03: the k best contacts for each wanted (company, team), team members first."""
    wanted = targets.select("company", "team").distinct()
    ranked = (contacts.join(wanted, "company")
              .withColumn("department_rank", department_rank(F.col("role"), F.col("team")))
              .filter(F.col("department_rank").isNotNull()))
    return top_k(ranked, ["company", "team"], ["department_rank", "rank", "url"], k, ["url"])


def contact_cards(contacts: Column) -> Column:
    """P-18: an array of contacts as cards; a missing name becomes `Unknown`."""
    return F.transform(contacts, lambda c: F.struct(
        F.coalesce(c["name"], F.lit("Unknown")).alias("name"),
        c["role"].alias("current_role"), c["url"].alias("linkedin_url")))


def attach_contacts(matches: DataFrame, contacts: DataFrame, k: int = fixed.MAX_CONTACTS) -> DataFrame:
    """J-03: matches (with `company` and `team`) and their contacts; without any, an empty array."""
    best = top_contacts(parse_contacts(contacts), matches, k)
    cards = best.groupBy("company", F.coalesce("team", F.lit("")).alias("_team")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "name", "role", "url"))).alias("contacts"))
    cards = cards.withColumn("contacts", contact_cards(F.col("contacts")))
    none = F.array().cast(cards.schema["contacts"].dataType)
    return (matches.withColumn("_team", F.coalesce("team", F.lit("")))
            .join(cards, ["company", "_team"], "left").drop("_team")
            .withColumn("contacts", F.coalesce("contacts", none)))


def contacts_of_matches(contacts: DataFrame, matches: DataFrame) -> DataFrame:
    """J-08: contacts of companies that have a match."""
    return contacts.join(matches.select("company").distinct(), "company", "left_semi")


def referrals(companies: DataFrame, people: DataFrame, k: int = fixed.MAX_REFERRERS) -> DataFrame:
    """J-05: the first k recruiters, leads and managers of each company."""
    fit = people.filter(token_text(F.col("role")).rlike(rf" ({'|'.join(fixed.REFERRER_WORDS)})s? "))
    wanted = companies.select("company").distinct()
    firsts = top_k(fit.join(wanted, "company", "left_semi"), ["company"], ["rank", "url"], k, ["url"])
    return firsts.select(referrer_name(F.col("title")).alias("name"), F.col("url").alias("linkedin"), "company", "pos")


def attach_email(contacts: DataFrame, directory: DataFrame) -> DataFrame:
    """J-06: e-mail by (first name, last name, domain); no domain or no entry gives null, of several entries the least counts."""
    keys = ["first_name", "last_name", "domain"]
    once = directory.groupBy(*keys).agg(*[F.min(c).alias(c) for c in directory.columns if c not in keys])
    return contacts.withColumn("domain", company_domain(F.col("company"))).join(once, keys, "left")


def recent_news(news: DataFrame, as_of: str, months: int = 6, k: int = fixed.MAX_NEWS) -> DataFrame:
    """T-04: the k newest items of each company within the last months before `as_of`."""
    day = F.to_date(F.lit(as_of))
    recent = news.filter((F.col("published_at") > F.add_months(day, -months)) & (F.col("published_at") <= day))
    return top_k(recent, ["company"], [F.desc("published_at"), F.asc("news_id")], k, ["news_id"])


def attach_news(matches: DataFrame, news: DataFrame, as_of: str, months: int = 6, k: int = fixed.MAX_NEWS) -> DataFrame:
    """J-04: matches with the titles of their companies' newest items; without any, an empty array."""
    titles = recent_news(news, as_of, months, k).groupBy("company").agg(
        F.sort_array(F.collect_list(F.struct("pos", "title"))).getField("title").alias("news"))
    empty = F.array().cast("array<string>")
    return matches.join(titles, "company", "left").withColumn("news", F.coalesce("news", empty))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def newest_before(asked: DataFrame, news: DataFrame, months: int = 6, k: int = fixed.MAX_NEWS) -> DataFrame:
    """Rows of `asked` (`company, asked_at`) with `news`: the k newest items of the months before, newest day first, then by `news_id`.

    No pairs are built. Items and requests are merged by company and month in order of time, and each request takes the last
    items that a running window has seen; k items that earlier months ended with are put before each month. So a company's
    rows are spread over its months, and work follows the rows, not what meets. Where times are timestamps, an item of
    the request's own day counts only if it came before the request, so days are merged up to the day before, and the items
    of the day itself (the k first of each time) stand before its requests in the same order, so that requests are shuffled once.
    Items are structs of all columns of `news` but the company.
    """
    timed = news.schema["published_at"].dataType.typeName() != "date"
    rest = [c for c in news.columns if c != "company"]
    firsts = top_k(news.filter("published_at is not null and company is not null"), ["company", "published_at"], ["news_id"], k).drop("pos")
    items = firsts.select("company", F.to_date("published_at").alias("_day"), F.struct("news_id", *[c for c in rest if c != "news_id"]).alias("_item"))
    items = items.withColumn("_month", _month(F.col("_day")))
    in_order = Window.partitionBy("company", "_month").orderBy("_day", F.desc("_item.news_id"))
    recent = (items.withColumn("_at", F.row_number().over(in_order))
              .withColumn("_recent", F.reverse(F.collect_list("_item").over(in_order.rowsBetween(1 - k, 0)))))
    ends = (recent.groupBy("company", "_month").agg(F.max_by("_recent", "_at").alias("_recent"))
            .withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(months))))
            .groupBy("company", (F.col("_month") + F.col("_back")).alias("_month"))
            .agg(F.slice(F.flatten(F.array_sort(F.collect_list(F.struct("_back", "_recent")))["_recent"]), 1, k).alias("_ends")))

    day = F.to_date("asked_at")
    turn = {"end": 0, "request": 1 if timed else 2, "item": 2 if timed else 1}
    request = F.struct(*asked.columns).alias("_request")
    rows = (asked.select("company", _month(day).alias("_month"), day.alias("_day"), F.lit(turn["request"]).alias("_turn"), request)
            .unionByName(recent.select("company", "_month", "_day", F.lit(turn["item"]).alias("_turn"), "_at", "_recent"), allowMissingColumns=True)
            .unionByName(ends.select("company", "_month", F.lit(turn["end"]).alias("_turn"), "_ends"), allowMissingColumns=True))
    if timed:
        today = items.groupBy("company", "_month", "_day").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        rows = rows.unionByName(today.select("company", "_month", "_day", F.lit(turn["end"]).alias("_turn"), F.struct("_day", "_items").alias("_today")),
                                allowMissingColumns=True)
    seen = Window.partitionBy("company", "_month").orderBy(F.asc_nulls_first("_day"), "_turn", "_at").rowsBetween(Window.unboundedPreceding, 0)
    none = F.array().cast(recent.schema["_recent"].dataType)
    last = {c: F.last(c, ignorenulls=True).over(seen) for c in ("_recent", "_ends", "_today") if c in rows.columns}
    met = [F.coalesce("_recent", none), F.coalesce("_ends", none)]
    if timed:
        same = F.when(F.col("_today._day") == F.col("_day"), F.col("_today._items"))
        met.insert(0, F.coalesce(F.filter(same, lambda x: x["published_at"] <= F.col("_request.asked_at")), none))
    found = rows.withColumns(last).filter("_request is not null").select("_request", "_day", F.concat(*met).alias("_found"))
    first = F.add_months("_day", -months)
    near = F.filter(F.slice("_found", 1, k), lambda x: F.to_date(x["published_at"]) > first)
    return found.select("_request.*", F.coalesce(near, none).alias("news"))


def attach_news_at(requests: DataFrame, news: DataFrame, months: int = 6, k: int = fixed.MAX_NEWS) -> DataFrame:
    """J-04: requests, each with its own day `asked_on`, and the titles of their companies' newest items before it."""
    found = newest_before(requests.withColumn("asked_at", F.col("asked_on")), news.select("company", "title", "news_id", "published_at"), months, k)
    return found.withColumn("news", F.col("news")["title"]).drop("asked_at")
