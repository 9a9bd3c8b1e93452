"""Search results and postings to job cards."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions import resolve_company
from jobweave.functions.company import board_source
from jobweave.operators.contacts import attach_contacts
from jobweave.operators.filters import filter_source_urls
from jobweave.operators.gates import Places, as_places, evaluate_gates, place_countries
from jobweave.operators.matching import ANYWHERE, FOUND, match, parts_of_results, posting_facts, read_texts, source_order, with_location, with_text, with_title
from jobweave.operators.ordered import dedupe_first
from jobweave.operators.requests import job_cards
from jobweave.session import written
from jobweave.sources.search import explode_results, resolve, resolve_text


def unique_results(results: DataFrame) -> DataFrame:
    """P-01 and N-01: valid URLs, each once per search, from the first source that has it."""
    ordered = filter_source_urls(results).withColumn("source_order", source_order(F.col("source")))
    return dedupe_first(ordered, ["query_id", "url"], ["source_order", "rank", "title"]).drop("source_order")


def jobs_of(results: DataFrame, postings: DataFrame, places: DataFrame | Places) -> DataFrame:
    """Unique search results with the facts of their postings.

    Whole texts are read where they lie, so that none goes through the join. Parts are short: they are brought to the results, and
    those of no result are not read.
    """
    known, found = as_places(places), unique_results(results)
    if known.pattern and "body" in postings.columns:
        return with_title(parts_of_results(found, postings, known), known)
    return with_text(found, posting_facts(postings, known), known)


def candidates(profiles: DataFrame, places: DataFrame | Places) -> DataFrame:
    """Profiles ready for matching: defaults filled in, years rounded half up, the country that the location names.

    A location that names no known place, or places of several countries, rules no posting out. Whole years also keep the
    classes of profiles few.
    """
    filled = profiles.withColumn("location", F.coalesce(F.nullif("location", F.lit("")), F.lit(fixed.DEFAULT_LOCATION)))
    where = place_countries(filled.select("location").distinct(), "location", "location", places)
    return (filled.join(where, "location", "left").withColumn("country", F.coalesce("country", F.lit(ANYWHERE)))
            .withColumn("years", F.floor(F.coalesce("years", F.lit(0)) + 0.5).cast("int"))
            .withColumn("remote_only", F.coalesce("remote_only", F.lit(False))))


def source_label(url: Column, source: Column) -> Column:
    """A board result goes by the name of its board."""
    return F.when(source == "Board", board_source(url)).otherwise(source)


def company_told() -> dict[str, Column]:
    """For `match`: the company of a posting, told once for all profiles that match it alike."""
    return {"company": resolve_company(F.col("company_found"), F.col("url"), source_label(F.col("url"), F.col("source")))}


def discover(profiles: DataFrame, results: DataFrame, postings: DataFrame, places: DataFrame | Places, **options) -> DataFrame:
    """At most ten matches per profile, in order of arrival; `options` are those of `match`."""
    return match(candidates(profiles, places), jobs_of(results, postings, places), **options)


def discover_responses(profiles: DataFrame, responses: DataFrame, primary: DataFrame, fallback: DataFrame, places: DataFrame | Places,
                       locations: DataFrame | None = None) -> DataFrame:
    """The discovery request from raw tables: at most ten matches per profile.

    `responses` has `query_id, source, first_rank, body`, a search response as it came; `primary` and `fallback` have the texts
    that two ways of fetching gave for a `url`, as `text` or in two parts (`facts_of_parts`); `locations` may name a place for it.
    """
    found = explode_results(responses, "body").withColumn("rank", F.col("first_rank") + F.col("rank"))
    results = unique_results(found.select("query_id", "source", "rank", "url", "title"))
    urls, known = results.select("url").distinct(), as_places(places)

    def located(rows: DataFrame) -> DataFrame:
        return rows.join(locations, "url", "left") if locations is not None else rows.withColumn("location", F.lit(None).cast("string"))

    if known.pattern:  # texts are read where they lie; only their facts go through the joins
        found = F.when(F.col("chars").isNotNull(), F.struct(*FOUND)).alias("found")
        read = [read_texts(texts, known).select("url", found) for texts in (primary, fallback)]
        facts = with_location(located(resolve(urls, *read, "found").select("url", "found.*")), known)
    else:
        facts = posting_facts(located(resolve_text(urls, primary, fallback)), known)
    return match(candidates(profiles, known), with_text(results, facts, known))


def discover_with_contacts(profiles: DataFrame, results: DataFrame, postings: DataFrame, places: DataFrame | Places,
                           contacts: DataFrame) -> DataFrame:
    """Matches with their company and its contacts; matches are written once and read twice."""
    named = discover(profiles, results, postings, places, told=company_told())
    return attach_contacts(written(named, "matches"), contacts)


def discover_cards(profiles: DataFrame, results: DataFrame, postings: DataFrame, places: DataFrame | Places,
                   contacts: DataFrame) -> DataFrame:
    """P-12 for every match, with the trace of its gates and its contacts; profiles have a `job_title`."""
    found = match(candidates(profiles, places), jobs_of(results, postings, places), keep=("job_title",), told=company_told())
    judged = evaluate_gates(
        found.withColumn("wanted_country", F.nullif(F.col("country"), F.lit(ANYWHERE))).withColumn("country", F.col("job_country"))
        .withColumn("location", F.when(F.col("is_remote"), "Remote")))
    carded = attach_contacts(written(judged, "matches"), contacts)
    return job_cards(carded.withColumn("confidence", F.lit(None).cast("double")))
