"""Page texts of documents."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import main_content as content_of


def assemble_pages(df: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """S-02: the non-empty pages of a document in order, a newline after each: one text per document.

    The text is an output; what works on lines takes `page_lines`, which never holds a whole document.
    """
    pages = F.array_sort(F.collect_list(F.struct(F.col(page_no), F.col(text).alias("text"))))
    joined = F.array_join(F.transform(pages, lambda p: F.concat(p["text"], F.lit("\n"))), "")
    return df.filter(F.col(text) != "").groupBy(doc).agg(joined.alias("text"))


def page_lines(df: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """Lines of documents straight from their pages: `doc_id, line_no, text`, numbered without a gap across pages.

    Only the pages' line counts are summed along a document; page numbers are unique within one.
    """
    pages = df.filter(F.col(text) != "").select(F.col(doc).alias("doc_id"), F.col(page_no).alias("page_no"), F.split(text, "\n").alias("lines"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    first = (pages.select("doc_id", "page_no", F.size("lines").cast("long").alias("n"))
             .withColumn("first", F.coalesce(before, F.lit(0).cast("long"))).drop("n"))
    rows = pages.join(first, ["doc_id", "page_no"]).select("doc_id", "first", F.posexplode("lines").alias("n", "text"))
    return rows.select("doc_id", (F.col("first") + F.col("n")).alias("line_no"), "text")


def main_content(df: DataFrame, html: str) -> DataFrame:
    """S-04: column `text` with the main content of a page."""
    return df.withColumn("text", content_of(F.col(html)))
