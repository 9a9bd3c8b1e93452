"""Years of experience: requirements, role dates, durations and buckets."""
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import fixed


# The pattern of `fixed` for the JVM: each run of digits is tried once, from its begin, and repeats are possessive, so long
# texts take linear time.
REQUIREMENT = r"(?i)(?<!\d)(\d++\s*+(?:[-–]\s*+\d++|\+)?+\s*+(?:years?|yrs?))"


def parse_years(req: Column) -> Column:
    """F-03: the least number of years a requirement text asks for, null when it names none."""
    sp = fixed.PY_SPACE
    patterns = [rf"([0-9]+){sp}*[-–]{sp}*[0-9]+", rf"([0-9]+){sp}*\+", r"([0-9]+)"]
    known = F.when(~req.isin("Unknown", "Not specified"), req)
    # null without a match: no `nullif` inside a condition, as Spark would run its pattern twice, and no cast of an empty
    # text, as each one throws and catches an error
    return F.coalesce(*[F.get(F.regexp_extract_all(known, F.lit(p), F.lit(1)), F.lit(0)).try_cast("double") for p in patterns])


def first_requirement(text: Column) -> Column:
    """The first phrase such as `3-5 years`, null when there is none."""
    low = F.lower(text)
    named = F.when(F.contains(low, F.lit("year")) | F.contains(low, F.lit("yr")), text)
    return F.nullif(F.regexp_extract(named, REQUIREMENT, 1), F.lit(""))


def extract_requirement(text: Column) -> Column:
    """F-04: the first phrase such as `3-5 years`, else `Not specified`."""
    return F.coalesce(first_requirement(text), F.lit("Not specified"))


def experience_mismatch(req: Column, years: Column, tolerance: float = fixed.POST_TOLERANCE) -> Column:
    """P-05: the requirement exceeds the candidate's years by more than the tolerance."""
    return F.coalesce(parse_years(req) > years + F.lit(tolerance), F.lit(False))


def senior_title(title: Column, url: Column, keywords=None) -> Column:
    """The keyword part of P-03; plain substrings of the lower-cased title and URL."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), url))
    return reduce(or_, [F.contains(text, F.lit(k)) for k in keywords or fixed.SENIOR_KEYWORDS])


def too_senior(title: Column, url: Column, years: Column, keywords=None) -> Column:
    """P-03: a senior title for a candidate below the senior threshold."""
    return (years < fixed.SENIOR_YEARS) & senior_title(title, url, keywords)


def role_months(start: Column, end: Column) -> Column:
    """F-08: whole months with month ends clipped; never below 0, and 1 when only the month differs."""
    span = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    whole = span - F.when(F.add_months(start, span) > end, 1).otherwise(0)
    return F.when((whole <= 0) & (span != 0), 1).otherwise(F.greatest(whole, F.lit(0)))


def experience_bucket(years: Column, given: Column | None = None) -> Column:
    """A-03: label of the bucket; with `given`, that label is kept below one year."""
    *upper, (_, lowest) = fixed.BUCKETS
    chain = reduce(lambda c, b: c.when(years >= b[0], F.lit(b[1])), upper, F.when(F.lit(False), F.lit(lowest)))
    return chain.otherwise(F.lit(lowest) if given is None else given)
