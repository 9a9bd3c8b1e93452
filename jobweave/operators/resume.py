"""Resume lines to sections, roles and skills. `lines` has columns `doc_id, line_no, text`.

A document is handled in blocks of consecutive lines, so even a very long one is spread over tasks.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed

BLOCK = 1024


def heading(text: Column) -> Column:
    """Section opened by a line: a heading alone or before a colon; null for other lines."""
    label = F.lower(F.trim(F.split_part(text, F.lit(":"), F.lit(1))))
    chain = F.when(F.lit(False), F.lit(""))
    for name, section in fixed.HEADINGS.items():
        chain = chain.when(label == name, F.lit(section))
    return chain


def resume_sections(lines: DataFrame) -> DataFrame:
    """N-03: the section each line belongs to; null before the first heading.

    The section a block starts in is put before its lines as one more row, so a window within the
    block carries it on.
    """
    blocks = (lines.select("doc_id", "line_no", "text").withColumn("block", F.floor(F.col("line_no") / BLOCK))
              .withColumn("heading", heading(F.col("text"))).withColumn("given", F.lit(True)))
    last_heading = F.max(F.when(F.col("heading").isNotNull(), F.struct("line_no", "heading")))["heading"]
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("doc_id", "block").agg(last_heading.alias("heading")).select(
        "doc_id", (F.col("block") * BLOCK - 1).alias("line_no"), F.lit(None).cast("string").alias("text"), "block",
        F.last("heading", ignorenulls=True).over(earlier).alias("heading"), F.lit(False).alias("given"))
    inside = Window.partitionBy("doc_id", "block").orderBy("line_no")
    return (blocks.unionByName(starts)
            .withColumn("section", F.last("heading", ignorenulls=True).over(inside))
            .filter("given").select("doc_id", "line_no", "text", "section"))


def resume_roles(lines: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """N-04: a role per date-range line of the experience section; title and company stand right before it.

    A range is two dates, or a date and an open end, with a dash or a word between: `04/2025 - 09/2025`, `Jan 2019 – Present`,
    `2012-01 - 2013-02`, `3 March 2015 to 2017`.

    The lines of a block are read in order once; the last two of a block stand before the next one as well, as a role may begin
    with them. Where line numbers repeat, the largest text counts.
    """
    source = sections if sections is not None else resume_sections(lines)
    block = F.floor(F.col("line_no") / BLOCK)
    both = F.when(F.pmod("line_no", F.lit(BLOCK)) >= BLOCK - 2, F.array(block, block + 1)).otherwise(F.array(block))
    jobs = source.filter(F.col("section") == "experience").select("doc_id", "line_no", "text", F.explode(both).alias("block"))
    ordered = Window.partitionBy("doc_id", "block").orderBy("line_no")

    def at(n: int, text: Column) -> Column:
        return F.max(text).over(ordered.rangeBetween(-n, -n))

    dates = F.when(F.col("text").rlike(fixed.DATE_RANGE), F.col("text"))
    roles = (jobs.withColumns({"dates": at(0, dates), "title": F.trim(at(1, F.col("text"))), "company": F.trim(at(2, F.col("text"))),
                               "once": F.row_number().over(ordered) == F.rank().over(ordered)})
             .filter(F.col("dates").isNotNull() & F.col("once") & F.col("block").eqNullSafe(block)))
    return roles.select(
        "doc_id", "line_no", "title", "company",
        F.regexp_extract("dates", fixed.DATE_RANGE, 1).alias("start_date"),
        F.regexp_extract("dates", fixed.DATE_RANGE, 2).alias("end_date"))


def distinct_roles(roles: DataFrame) -> DataFrame:
    """The first of several equal company and title pairs of a document."""
    from jobweave.operators.ordered import dedupe_first
    return dedupe_first(roles, ["doc_id", "company", "title"], ["line_no"])


def resume_skills(sections: DataFrame) -> DataFrame:
    """F-18: keywords of the skills section, first occurrence first: `doc_id, skill, line_no, pos`."""
    text = F.when(heading(F.col("text")).isNotNull(), F.regexp_replace("text", r"^[^:]*:?", "")).otherwise(F.col("text"))
    words = (sections.filter(F.col("section") == "skills")
             .select("doc_id", "line_no", F.posexplode(F.split(text, ",")).alias("pos", "skill"))
             .withColumn("skill", F.regexp_replace(F.trim("skill"), r"\.$", "")).filter(F.col("skill") != ""))
    first = F.min(F.struct("line_no", "pos")).alias("first")
    return words.groupBy("doc_id", "skill").agg(first).select("doc_id", "skill", "first.*")
