"""Edits of profiles as logs, folded without replaying them one by one."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import py_strip


def apply_skill_edits(skills: DataFrame, edits: DataFrame) -> DataFrame:
    """U-03: skills after all edits: `profile_id, skill, added, ord`.

    `skills` has `profile_id, skill, ord`; `edits` has `profile_id, edit_id, op, skill` with op `add`
    or `remove`. A skill that was never removed keeps its place; one added later comes after all
    given ones (`added` = 1), by its first addition since the last removal.
    """
    key = ["profile_id", "skill"]
    removed = edits.filter("op = 'remove'").groupBy(*key).agg(F.max("edit_id").alias("removed_at"))
    adds = (edits.filter("op = 'add'").withColumn("skill", py_strip(F.col("skill"))).filter("skill <> ''")
            .select(*key, F.lit(1).alias("added"), F.col("edit_id").alias("ord")))
    given = skills.select(*key, F.lit(0).alias("added"), F.col("ord").cast("bigint").alias("ord"))
    alive = given.unionByName(adds).join(removed, key, "left").filter(
        F.col("removed_at").isNull() | ((F.col("added") == 1) & (F.col("ord") > F.col("removed_at"))))
    first = F.min(F.struct("added", "ord")).alias("first")
    return alive.groupBy(*key).agg(first).select(*key, "first.*")


def apply_role_edits(roles: DataFrame, edits: DataFrame) -> DataFrame:
    """U-04: roles after all edits: `profile_id, role_id, title, years, active`.

    `roles` has those columns; `edits` has `profile_id, edit_id, op, role_id, title` with op `toggle`,
    `remove` or `add`. An odd number of toggles flips `active`; a removed role is gone; an added one
    has 0 years and is active.
    """
    key = ["profile_id", "role_id"]
    added = (edits.filter("op = 'add'").withColumn("title", py_strip(F.col("title"))).filter("title <> ''")
             .select(*key, "title", F.lit(0).cast("decimal(12,2)").alias("years"), F.lit(True).alias("active")))
    changes = edits.groupBy(*key).agg(
        (F.count_if(F.col("op") == "toggle") % 2 == 1).alias("flip"),
        F.max(F.col("op") == "remove").alias("gone"))
    return (roles.select(*key, "title", F.col("years").cast("decimal(12,2)").alias("years"), "active")
            .unionByName(added).join(changes, key, "left")
            .filter(~F.coalesce("gone", F.lit(False)))
            .select(*key, "title", "years", (F.col("active") != F.coalesce("flip", F.lit(False))).alias("active")))
