"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.session import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every id that has a link to another one.

    Each round hangs every id's larger neighbours, then all its neighbours, on the smallest; rounds grow with the logarithm
    of the longest path. Minima are combined before the shuffle, links stay in written tables and never meet on the driver.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        if (new := _state(edges)) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = new
