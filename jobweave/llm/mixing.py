"""Mixing sources to target weights by nested hash thresholds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.session import written

# Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
# A source's target, and what is taken of one document, stop at so many times their size.
MOST = 3
# Bits of a document's hash, and of it at each level of the histograms.
HASH_BITS, LEVEL_BITS = 48, 12


def words_of(text: Column) -> Column:
    """Number of words, runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def hashed(doc_id: Column) -> Column:
    """A number of HASH_BITS bits that only depends on the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_no, source_size and target of each source; `sizes` has (source, size).

    Targets are shares of the total by weight, none above `most` times its source; what lies above is shared again by
    weight. That is one common level per weight: sources reach their limit in the order of limit / weight, so it follows
    from running sums over the sources, which are few.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    named = (sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(order))
             .withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total, all_weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left, free = (total - F.coalesce(F.sum("most").over(before), F.lit(0)), all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    capped = named.withColumn("total", total).withColumn("all_weights", all_weights).withColumn("capped", F.col("weight") * left >= F.col("most") * free)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0))
    free = F.col("all_weights") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    share = (F.col("weight") * left).cast("double") / free
    return capped.select("source", "source_no", "source_size",
                         F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes of it, repeats counted) of every document.

    Of each source the mix takes every document as often as the target holds its whole size, and spends the rest on the
    documents lowest in a hash of doc_id: histograms of words by (source, hash bucket) give the bucket in which the rest
    runs out, only that bucket's documents go into the next, finer histogram, and the last level is a single hash value,
    whose documents share what is left in proportion to size. Documents are filtered by these thresholds, never sorted;
    a hot source is summed per task before the shuffle. Reruns agree, as nothing but ids, sources and sizes decides.

    Null and empty texts have size 0 and 0 taken; null sources are one source, last by name; rows of equal doc_id share
    their fate; a source without words has target 0; an empty table gives none; other columns are ignored.
    """
    sized = written(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("hash")), "sizes")
    goals = written(targets(sized, weights, most).withColumn("words", F.floor("target"))
                    .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0))
                    .withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size")), "targets")
    rows = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).select(
        "doc_id", sized["source"], "size", "hash", "source_no", "source_size", "target", "whole", "rest")

    # edge: where the rest of each source runs out so far - the bucket, what is left at its begin, and its words
    edge = goals.select(F.col("source_no").alias("no"), F.lit(0).cast("long").alias("bucket"), F.col("rest").alias("left"),
                        F.col("source_size").alias("words"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = rows.join(edge, (F.col("source_no") == F.col("no")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("bucket")))
        sums = inside.groupBy("no", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("no").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        edge = over.groupBy("no").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "words"), "bucket").alias("e")).select("no", "e.*")
        edge = written(edge, "edges")

    at_edge = F.floor(F.col("size") * F.col("left") / F.col("words"))
    some = F.when(F.col("hash") < F.col("bucket"), F.col("size")).when(F.col("hash") == F.col("bucket"), at_edge).otherwise(0)
    return rows.join(edge, F.col("source_no") == F.col("no"), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.coalesce(some, F.lit(0))).cast("long").alias("taken"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HASH_BITS // 4}))::BIGINT AS h
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source),
weighed AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[(no - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight, source_size * {MOST} AS most FROM named),
running AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(most) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighed WINDOW w AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, weight * (total - most_before) >= most * (weights - weight_before) AS cap FROM running),
goals AS (
  SELECT source, source_size, CASE WHEN cap THEN most::DOUBLE ELSE
           (weight * (total - coalesce(sum(most) FILTER (cap) OVER (), 0)))::DOUBLE / (weights - coalesce(sum(weight) FILTER (cap) OVER (), 0)) END AS target
  FROM capped),
spent AS (
  SELECT doc_id, s.source, size, source_size, target, h, floor(target)::BIGINT AS goal,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS here
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
rest AS (SELECT *, goal - whole * source_size AS rest FROM spent)
SELECT doc_id, source, size, source_size, target,
       (whole * size + CASE WHEN upto <= rest THEN size WHEN upto - here <= rest AND here > 0 THEN floor(size * (rest - upto + here) / here) ELSE 0 END)::BIGINT AS taken
FROM rest
"""
