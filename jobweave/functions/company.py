"""Company names from URLs."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions.text import py_strip, py_title


def board_source(url: Column) -> Column:
    """P-02: name of the job board, by the first substring that occurs."""
    start = F.when(F.lit(False), F.lit(None).cast("string"))
    return reduce(lambda c, b: c.when(F.contains(url, F.lit(b[0])), F.lit(b[1])), fixed.BOARDS, start).otherwise(
        F.lit(fixed.OTHER_BOARD))


def _spaced(piece: Column) -> Column:
    return py_title(F.replace(piece, F.lit("-"), F.lit(" ")))


def _path_piece(url: Column, host: str) -> Column:
    return _spaced(F.split_part(F.split_part(url, F.lit(host), F.lit(2)), F.lit("/"), F.lit(1)))


def company_from_url(url: Column, source: Column) -> Column:
    """F-01: company named by a job-board URL, else the source, else `Unknown`."""
    unknown = F.lit("Unknown")
    hosted = F.when(F.lit(False), unknown)
    for host in ("greenhouse.io/", "lever.co/", "ashbyhq.com/"):
        hosted = hosted.when(F.contains(url, F.lit(host)), _path_piece(url, host))
    first_label = F.split_part(url, F.lit("."), F.lit(1))
    bare = F.replace(F.replace(first_label, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    slug = F.split_part(F.split_part(url, F.lit("/jobs/view/"), F.lit(2)), F.lit("?"), F.lit(1))
    employer = F.regexp_replace(F.split_part(slug, F.lit("-at-"), F.lit(2)), r"(?s)-[^-]*\z", "")
    name = (hosted
            .when(F.contains(url, F.lit("myworkdayjobs.com")), py_title(bare))
            .when(F.contains(url, F.lit("smartrecruiters.com/")), _path_piece(url, "smartrecruiters.com/"))
            .when(F.contains(url, F.lit("linkedin.com")) & F.contains(slug, F.lit("-at-")), _spaced(employer))
            .otherwise(unknown))
    name = F.split_part(F.split_part(name, F.lit(" Careers"), F.lit(1)), F.lit(" Jobs"), F.lit(1))
    name = F.coalesce(py_strip(name), unknown)
    has_source = F.coalesce(source != "", F.lit(False))
    return F.when(name.isin("", "Unknown") & has_source, source).otherwise(name)


def resolve_company(extracted: Column, url: Column, source: Column) -> Column:
    """P-11: the name found in the posting if there is one, else the name in the URL."""
    return F.coalesce(F.nullif(extracted, F.lit("")), company_from_url(url, source))


def company_domain(company: Column) -> Column:
    """J-07: guessed web domain; null when no letter or digit is left."""
    core = F.regexp_replace(F.lower(company), "[^a-z0-9]", "")
    return F.when(core != "", F.concat(core, F.lit(".com")))
