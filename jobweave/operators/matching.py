"""Profiles x postings without building their pairs.

A verdict depends on few facts only: for a posting on (senior title, requirement, country, remote),
for a profile on (years, country, remote only). Postings of one search with equal facts pass or fail
together, so the first k of each such class hold every row any profile's first k can need. The join
then runs between classes, and its size follows the number of distinct facts, not of rows.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions import extract_company, extract_requirement, extract_team, parse_years
from jobweave.functions.experience import first_requirement, senior_title
from jobweave.functions.text import token_text
from jobweave.operators.filters import min_length
from jobweave.operators.gates import Places, as_places, gate_senior, stated_country
from jobweave.operators.ordered import dedupe_first, top_k
from jobweave.session import written

SEQ = ["source_order", "rank", "url"]
PROFILE_CLASS = ["query_id", "years", "country", "remote_only"]
# Country of a profile whose location names none, or several.
ANYWHERE = "*"
JOB_CLASS = ["title_senior", "gate_senior", "min_required", "job_country", "is_remote"]
# What the gates see of a profile's years: below the senior threshold or not, and the largest requirements that pass.
LEVEL = ["junior", "cap", "post_cap", "remote_only"]
# Requirements from here on share one bucket of the join.
NEEDS = 40
# The begin of a text that a requirement, company or team from before it may take, where it stands behind a line end.
LEADS = [r"^[\s\d+–-]*+(?:(?i)years?|yrs?)?", r"^\s*+(?:[A-Z0-9][A-Za-z0-9&-]*+(?: [A-Z0-9][A-Za-z0-9&-]*+)*+)?", r"^\s*+[A-Za-z]*+"]
# What is found in a posting's text.
FOUND = ["chars", "required_text", "company_found", "team", "is_remote", "body_country"]
# Positions of a source that are counted together when results are placed among the cuts of their search.
BLOCK = 1000


def source_order(source: Column) -> Column:
    """Position of a source in the concatenation of all results."""
    chain = F.when(F.lit(False), F.lit(0))
    for name, n in fixed.SOURCE_ORDER.items():
        chain = chain.when(source == name, F.lit(n))
    return chain.otherwise(F.lit(fixed.SOURCE_ORDER["Board"]))


def _remote(text: Column) -> Column:
    """A text that offers remote work; only one with a word of the pattern is searched for it."""
    low = F.lower(text)
    named = F.contains(low, F.lit("remote")) | F.contains(low, F.lit("wfh")) | F.contains(low, F.lit("work from anywhere"))
    return F.coalesce(named & text.rlike(fixed.REMOTE), F.lit(False))


def read_bodies(bodies: DataFrame, places: Places, text: str = "text") -> DataFrame:
    """`text` replaced by a struct `body` with all that `posting_facts` needs of it, for texts that many postings end with.

    `lead` is as much of the text as a requirement, company or team that begins before it may reach into.
    """
    rest = [c for c in bodies.columns if c != text]
    body = F.col(text)
    lead = F.greatest(*[F.length(F.regexp_extract(body, p, 0)) for p in LEADS])
    found = [F.length(body).alias("chars"), first_requirement(body).alias("required"), extract_company(body).alias("company"),
             extract_team(body).alias("team"), _remote(body).alias("is_remote"), F.left(body, lead).alias("lead"),
             places.opening(body).alias("opening"), F.when(places.mentions(body), token_text(body)).alias("tokens")]
    kept = ["chars", "required", "company", "team", "is_remote", "lead", "opening"]
    read = bodies.select(*rest, *found).withColumn("names", places.after_words(F.col("tokens")))
    bounds = [places.bounds(F.get("names", F.lit(n))) for n in range(places.longest)]
    return read.select(*rest, F.struct(*kept, F.when(F.col("names").isNotNull(), F.array(*bounds)).alias("places")).alias("body"))


def facts_of_parts(parts: DataFrame, places: Places) -> DataFrame:
    """The columns FOUND instead of a text that is given in two parts; `chars` is null where there is no text.

    `parts` has `head`, whole lines or nothing, and `body` of `read_bodies`. What begins in the head is sought in the head and
    the lead of the body; what begins in the body was found there once, however many postings share it.
    """
    return _facts_of_lines(parts.withColumn("head", _lines()), places)


def _lines() -> Column:
    """The head, if it holds whole lines or nothing; an error otherwise."""
    whole = (F.col("head") == "") | F.endswith("head", F.lit("\n"))
    return F.when(whole, F.col("head")).otherwise(F.raise_error(F.lit("a head must end with its line")))


def _facts_of_lines(parts: DataFrame, places: Places) -> DataFrame:
    """`facts_of_parts` for heads that are known to hold whole lines, or are null."""
    rest = [c for c in parts.columns if c not in ("head", "body")]
    headed = parts.withColumn("_start", F.when(F.col("head") != "", F.concat("head", F.col("body.lead"))))
    headed = headed.withColumn("_before", places.names_before(F.col("head"), F.col("body.opening")))
    headed = headed.withColumn("_own", places.own_names(F.col("_before"))).withColumn("_taken", places.taken(F.col("_before")))
    headed = headed.withColumn("_own", places.bounds(F.col("_own"))).withColumn("_rest", F.get("body.places", F.col("_taken")))
    start, low, high = F.col("_start"), F.least("_own.low", "_rest.low"), F.greatest("_own.high", "_rest.high")
    found = (
        (F.length("head") + F.col("body.chars")).alias("chars"),
        F.coalesce(first_requirement(start), F.col("body.required"), F.lit("Not specified")).alias("required_text"),
        F.coalesce(extract_company(start), F.col("body.company")).alias("company_found"),
        F.coalesce(extract_team(start), F.col("body.team")).alias("team"),
        (F.col("body.is_remote") | _remote(F.col("head"))).alias("is_remote"), F.when(low == high, low).alias("body_country"))
    return headed.select(*rest, *found)


def facts_of_texts(postings: DataFrame, places: Places) -> DataFrame:
    """The columns FOUND instead of whole texts; `chars` is null where there is no text.

    Countries are told where the table of places is one pattern.
    """
    rest = [c for c in postings.columns if c != "text"]
    body = F.col("text")
    read = places.with_country(postings, "_country", "text") if places.pattern else postings.withColumn("_country", F.lit(None).cast("string"))
    return read.select(
        *rest, F.length(body).alias("chars"), extract_requirement(body).alias("required_text"), extract_company(body).alias("company_found"),
        extract_team(body).alias("team"), _remote(body).alias("is_remote"),
        F.col("_country").alias("body_country"))


def read_texts(postings: DataFrame, places: Places) -> DataFrame:
    """Facts of texts, given whole or in two parts."""
    return (facts_of_parts if "body" in postings.columns else facts_of_texts)(postings, places)


def with_location(found: DataFrame, places: Places) -> DataFrame:
    """Facts of postings with enough text, of rows with FOUND and `location`."""
    enough = places.with_country(found.filter(F.col("chars") >= fixed.MIN_POSTING_CHARS), "location_country", "location")
    return (enough.withColumn("is_remote", F.col("is_remote") | _remote(F.col("location")))
            .withColumn("min_required", parse_years(F.col("required_text"))).drop("chars", "location"))


def posting_facts(postings: DataFrame, places: DataFrame | Places) -> DataFrame:
    """What the gates need to know of each posting with enough text, without the text itself.

    `location_country` and `body_country` are the one country that field names. Postings have `url, location` and either
    `text`, or `head` and `body` (`facts_of_parts`), which needs a table of places that is one pattern. With a larger table,
    texts are read once: everything found in them, and where they may name places, is written as a table of one short row
    per posting.
    """
    known = as_places(places)
    if known.pattern:
        parts = ["head", "body"] if "body" in postings.columns else ["text"]
        return with_location(read_texts(postings.select("url", "location", *parts), known), known)
    facts = written(min_length(postings, "text").select(
        "url", extract_requirement(F.col("text")).alias("required_text"),
        extract_company(F.col("text")).alias("company_found"), extract_team(F.col("text")).alias("team"),
        _remote(F.concat_ws("\n", "location", "text")).alias("is_remote"),
        known.begins(F.col("location")).alias("_location"), known.begins(F.col("text")).alias("_body")), "facts")
    where = known.countries(facts, ["url"], {"location_country": "_location", "body_country": "_body"})
    return facts.drop("_location", "_body").withColumn("min_required", parse_years(F.col("required_text"))).join(where, "url", "left")


def parts_of_results(results: DataFrame, postings: DataFrame, places: Places) -> DataFrame:
    """Every search result with `has_text` and the facts of its posting, which is given in two parts; null facts without one.

    Equals a left join of `posting_facts`, but parts are joined first, so only those of a result are read.
    """
    # the filter stands before the check of the head, as Spark would move it there and copy what makes the head into it
    parts = postings.filter(F.length("head") + F.col("body.chars") >= fixed.MIN_POSTING_CHARS).select("url", "location", _lines().alias("head"), "body")
    read = _facts_of_lines(results.join(parts, "url", "left"), places).withColumn("has_text", F.col("chars").isNotNull())
    located = places.with_country(read.withColumn("required_text", F.when(F.col("has_text"), F.col("required_text"))), "location_country", "location")
    return (located.withColumn("is_remote", F.col("is_remote") | _remote(F.col("location")))
            .withColumn("min_required", parse_years(F.col("required_text"))).drop("chars", "location"))


def with_text(results: DataFrame, facts: DataFrame, places: DataFrame | Places) -> DataFrame:
    """J-02: every search result with the facts of its posting; `has_text` is false without one.

    `job_country` is what title, location and text agree on (`stated_country`); results are unique by query_id and url.
    """
    known = as_places(places)
    joined = results.join(facts.withColumn("has_text", F.lit(True)), "url", "left")
    if known.pattern:
        return with_title(joined, known)
    titled = known.countries(results.select("query_id", "url", known.begins(F.col("title")).alias("_title")), ["query_id", "url"], {"title_country": "_title"})
    joined = joined.join(titled.where("title_country is not null"), ["query_id", "url"], "left")
    return _judged(joined)


def with_title(joined: DataFrame, places: Places) -> DataFrame:
    """`with_text` of results that have their facts, for a table of places that is one pattern."""
    return _judged(places.with_country(joined, "title_country", "title"))


def _judged(joined: DataFrame) -> DataFrame:
    fields = [F.col(c) for c in ("title_country", "location_country", "body_country")]
    return (joined.withColumn("has_text", F.coalesce("has_text", F.lit(False)))
            .withColumn("job_country", stated_country(*fields))
            .withColumn("is_remote", F.coalesce("is_remote", F.lit(False)))
            .withColumn("source_order", source_order(F.col("source")))
            .withColumn("title_senior", senior_title(F.col("title"), F.col("url")))
            .withColumn("gate_senior", F.coalesce(gate_senior(F.col("title")), F.lit(False))))


def _one_search(profiles: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as if all results came from one search; a URL found by several counts once."""
    once = dedupe_first(jobs, ["url"], ["source_order", "rank", "query_id"])
    return profiles.withColumn("query_id", F.lit(0)), once.withColumn("query_id", F.lit(0))


def _buckets(df: DataFrame) -> DataFrame:
    """Postings a profile may see: those of its own country and those without one; all, for a profile of no known country."""
    own = F.when(F.col("country") == ANYWHERE, F.array(F.lit(ANYWHERE))).otherwise(F.array_distinct(F.array("country", F.lit(""))))
    return df.withColumn("bucket", F.explode(own))


def _in_buckets(jobs: DataFrame) -> DataFrame:
    """Postings by the buckets they are seen in: that of their country, and the one of all."""
    return jobs.withColumn("bucket", F.explode(F.array(F.coalesce("job_country", F.lit("")), F.lit(ANYWHERE))))


def _levels(profiles: DataFrame, tolerance: float, experience_gate: bool) -> DataFrame:
    """Profiles with their LEVEL. Requirements are whole numbers (F-03), so years count only up to the next whole number."""
    years = F.col("years").cast("double")
    post = F.floor(years + F.lit(float(tolerance))).cast("double")
    gate = F.least(post, F.floor(years + F.lit(float(fixed.GATE_TOLERANCE))).cast("double")) if experience_gate else post
    return (profiles.withColumn("junior", F.col("years") < fixed.SENIOR_YEARS)
            .withColumn("cap", gate).withColumn("post_cap", post))


def _open(experience_gate: bool) -> Column:
    """All rules but the requirement."""
    ok = F.col("has_text") & (~F.col("remote_only") | F.col("is_remote")) & ~(F.col("title_senior") & F.col("junior"))
    return ok & ~(F.col("gate_senior") & F.col("junior")) if experience_gate else ok


def class_matches(profiles: DataFrame, jobs: DataFrame, k: int = fixed.MAX_MATCHES,
                  tolerance: float = fixed.POST_TOLERANCE, experience_gate: bool = True) -> DataFrame:
    """The first k postings for each class of profiles, numbered in `pos`.

    A range join by buckets: a posting stands in the bucket of its requirement, one without a requirement in bucket -1, and
    a class looks into the buckets up to the largest requirement it may meet. Search, country and requirement are the join
    key, so it stays spread where all results are one search, and the first k of a bucket are all that is read of it.
    """
    firsts = top_k(jobs.filter("has_text"), ["query_id", *JOB_CLASS], SEQ, k, ["url"]).drop("pos")
    # never null as Spark sees it: else it filters by what makes the number, and reads each text several times for that
    bucket = F.least(F.coalesce("min_required", F.lit(-1.0)), F.lit(float(NEEDS))).cast("int")
    firsts = firsts.withColumn("need", F.coalesce(bucket, F.lit(-1)))
    classes = _levels(_buckets(profiles.select(*PROFILE_CLASS).distinct()), tolerance, experience_gate)
    seen_by = ["query_id", "bucket", *LEVEL]
    highest = F.least(F.greatest("cap", F.lit(-1.0)), F.lit(float(NEEDS))).cast("int")
    passed = (classes.select(*seen_by).distinct().filter("cap is not null")
              .withColumn("need", F.explode(F.sequence(F.lit(-1), highest)))
              .join(_in_buckets(firsts), ["query_id", "bucket", "need"])
              .filter(_open(experience_gate) & (F.col("min_required").isNull() | (F.col("min_required") <= F.col("cap")))))
    per_bucket = top_k(passed.drop("need"), seen_by, SEQ, k).drop("pos")
    return top_k(classes.join(per_bucket, seen_by).drop("bucket", "junior", "cap", "post_cap"), PROFILE_CLASS, SEQ, k)


def match(profiles: DataFrame, jobs: DataFrame, on_query: bool = True, tolerance: float = fixed.POST_TOLERANCE,
          k: int = fixed.MAX_MATCHES, experience_gate: bool = True, keep: tuple = (), told: dict[str, Column] | None = None) -> DataFrame:
    """J-01 with T-01: the first k postings each profile passes all gates for, in order of arrival.

    `on_query` restricts a profile to the results of its own search; else it sees all results.
    `keep` names more columns of the profiles to carry along; `told` adds columns made of the postings' own, once per class.
    """
    if not on_query:
        profiles, jobs = _one_search(profiles, jobs)
    picked = class_matches(profiles, jobs, k, tolerance, experience_gate).withColumns(told or {})
    return profiles.select("profile_id", *keep, *PROFILE_CLASS).join(picked, PROFILE_CLASS)


def match_count(profiles: DataFrame, jobs: DataFrame, **options) -> DataFrame:
    """A-09: number of matches of every profile, zero included; counted per class."""
    counts = class_matches(profiles, jobs, **options).groupBy(*PROFILE_CLASS).agg(F.count("*").alias("matches"))
    return (profiles.select("profile_id", *PROFILE_CLASS).join(counts, PROFILE_CLASS, "left")
            .select("profile_id", F.coalesce("matches", F.lit(0)).alias("matches")))


def _placed(jobs: DataFrame, cuts: DataFrame, carry: list[str]) -> DataFrame:
    """Rows of `jobs` with `segment`, the number of their search's cuts that lie before them, and the cuts (`is_cut`) with theirs.

    Prefix sums in two steps: inside blocks of BLOCK positions of a source, and over the blocks of a search. Rows after the
    last cut of their search are not sorted at all.
    """
    ends = written(cuts.groupBy("query_id").agg(F.max(F.struct(*SEQ)).alias("end"), F.count("*").alias("cuts")), "funnel-ends")
    marked = jobs.join(ends, "query_id", "left")
    near = F.coalesce(F.struct(*SEQ) <= F.col("end"), F.lit(False))
    after = marked.filter(~near).select("query_id", "url", *carry, F.coalesce("cuts", F.lit(0)).alias("segment"), F.lit(0).alias("is_cut"))

    rows = marked.filter(near).select("query_id", *SEQ, *carry, F.lit(0).alias("is_cut"))
    rows = rows.unionByName(cuts.select("query_id", *SEQ, F.lit(1).alias("is_cut")), allowMissingColumns=True)
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("rank") / BLOCK), F.lit(-1)))
    block = ["query_id", "source_order", "block"]
    inside = F.sum("is_cut").over(Window.partitionBy(*block).orderBy("rank", "url", "is_cut").rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.sum("n").over(Window.partitionBy("query_id").orderBy("source_order", "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*block).agg(F.sum("is_cut").alias("n")).select(*block, F.coalesce(earlier, F.lit(0)).alias("earlier"))
    within = rows.withColumn("inside", inside).join(blocks, block)
    within = within.select("query_id", "url", *carry, (F.col("earlier") + F.col("inside") - F.col("is_cut")).alias("segment"), "is_cut")
    return written(within.unionByName(after), "funnel-segments")


def _up_to(counts: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """For each (key, last) asked: the sum of `n` over the counts of the same key whose segment is `last` at most.

    Counts and questions are merged in order of segment and a running sum goes over both, so no question meets each count.
    """
    rows = counts.select(*key, "segment", "n", F.lit(0).alias("ask")).unionByName(
        asked.select(*key, F.col("last").alias("segment"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("ask")).distinct())
    running = F.sum("n").over(Window.partitionBy(*key).orderBy("segment", "ask").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("n", running).filter("ask = 1").select(*key, F.col("segment").alias("last"), "n")


def funnel(profiles: DataFrame, jobs: DataFrame, k: int = fixed.MAX_MATCHES, tolerance: float = fixed.POST_TOLERANCE,
           experience_gate: bool = False, by: tuple = ()) -> DataFrame:
    """A-04: matched, pre-filtered and post-filtered results per profile (and per `by` columns of the jobs).

    Results after the k-th match do not count. The k-th matches of a search cut its order into segments; results are counted
    per segment and facts, and a class takes the running sums at its own cut. All joins are on equal keys; a class meets the
    distinct facts of its search, never its results or segments. Results are unique by query_id and url.
    """
    by = list(by)
    group = F.struct(*by) if by else F.lit(0)
    facts = [*JOB_CLASS, "has_text", "_by"]
    jobs = written(jobs.withColumn("_by", group).select("query_id", *SEQ, *facts), "funnel-jobs")
    picked = class_matches(profiles, jobs, k, tolerance, experience_gate)
    picked = written(picked.select(*PROFILE_CLASS, "pos", *SEQ, "_by"), "funnel-matches")
    cut = picked.filter(F.col("pos") == k).select(*PROFILE_CLASS, *SEQ)
    placed = _placed(jobs, cut.select("query_id", *SEQ).distinct(), facts)
    counted = placed.filter("is_cut = 0").groupBy("query_id", "segment", *facts).agg(F.count("*").alias("n"))
    numbered = placed.filter("is_cut = 1").select("query_id", "url", F.col("segment").alias("last"))
    whole = F.lit(2 ** 62)  # a class with fewer than k matches sees all segments
    classes = (profiles.select(*PROFILE_CLASS).distinct()
               .join(cut.join(numbered, ["query_id", "url"]).select(*PROFILE_CLASS, "last"), PROFILE_CLASS, "left")
               .withColumn("last", F.coalesce("last", whole)))
    classes = written(_levels(classes, tolerance, experience_gate), "funnel-classes")

    key = ["query_id", "_by"]
    senior = counted.filter("title_senior").groupBy(*key, "segment").agg(F.sum("n").alias("n"))
    asked = classes.filter("junior").select("query_id", "last").distinct().join(senior.select(*key).distinct(), "query_id")
    pre = (classes.filter("junior").join(_up_to(senior, asked, key), ["query_id", "last"])
           .select(*PROFILE_CLASS, "_by", "n", F.lit("pre_filtered").alias("stage")))

    key = ["query_id", "bucket", "title_senior", "gate_senior", "min_required", "is_remote", "has_text", "_by"]
    level = ["query_id", "country", *LEVEL, "last"]
    asking = counted.filter("has_text and min_required is not null")
    asking = _in_buckets(asking).groupBy(*key, "segment").agg(F.sum("n").alias("n"))
    within_gate = F.col("min_required") <= F.col("cap") if experience_gate else F.lit(True)
    pairs = (_buckets(classes.select(*level).distinct()).join(asking.select(*key).distinct(), ["query_id", "bucket"])
             .filter(_open(experience_gate) & within_gate & (F.col("min_required") > F.col("post_cap"))))
    sums = (pairs.join(_up_to(asking, pairs.select(*key, "last"), key), [*key, "last"])
            .groupBy(*level, "_by").agg(F.sum("n").alias("n")))
    post = classes.join(sums, level).select(*PROFILE_CLASS, "_by", "n", F.lit("post_filtered").alias("stage"))

    matched = picked.groupBy(*PROFILE_CLASS, "_by").agg(F.count("*").alias("n")).withColumn("stage", F.lit("matched"))
    names = ["matched", "pre_filtered", "post_filtered"]
    table = (matched.unionByName(pre).unionByName(post).filter("n > 0")
             .groupBy(*PROFILE_CLASS, "_by").pivot("stage", names).agg(F.sum("n")))
    how = "inner" if by else "left"
    return (profiles.select("profile_id", *PROFILE_CLASS).join(table, PROFILE_CLASS, how)
            .select("profile_id", *[F.col("_by")[c].alias(c) for c in by], *[F.coalesce(c, F.lit(0)).alias(c) for c in names]))


def unmatched(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """J-09: postings no profile matched."""
    return jobs.join(matches.select("url").distinct(), "url", "left_anti")
