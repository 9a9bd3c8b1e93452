"""First-of-group, top-k and unions: the ordered building blocks."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """N-01: the first row of every key.

    A minimum over structs is combined on the map side, so a key that holds much of the data
    reaches the final task as one row per map task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return df.groupBy(*key).agg(first).select(*key, "first.*").select(*df.columns)


def top_k(df: DataFrame, by: list[str], order: list[Column | str], k: int, spread: list[str] | None = None,
          pos: str = "pos", parts: int = 16) -> DataFrame:
    """T-01..T-05: the k first rows of every group, numbered from 1 in column `pos`.

    Groups of any size need `spread`: each group is cut into `parts` by a hash of those columns and
    reduced to k rows per part, then the parts are merged. Both steps are group limits, which Spark
    also applies before the shuffle, so no task sorts a hot group as a whole. Without `spread`, for
    groups that are known to be small, there is one step.
    """
    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(pos, number).filter(F.col(pos) <= k)

    if spread:
        part = F.pmod(F.xxhash64(*spread), F.lit(parts))
        df = first(df.withColumn("_part", part), [*by, "_part"]).drop("_part")
    return first(df, by)


def union_sources(sources: dict[str, DataFrame | None]) -> DataFrame:
    """U-01: all sources under one another with their name; a source that failed (None) adds nothing."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items() if df is not None]
    return reduce(DataFrame.unionByName, named)
