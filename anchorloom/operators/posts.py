"""Which posts may be linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.settings import Settings

#: Nodes of the way up from a category that are looked at, itself included.
ANCESTRY = 5


def excluded_categories(categories: DataFrame, excluded: tuple[int, ...]) -> DataFrame:
    """(id) of categories that are, or have among their nearest ancestors, an excluded one.

    From the excluded ones down, level by level, at most ANCESTRY - 1 levels; a loop ends there."""
    wanted = F.col("id").isin(*excluded) if excluded else F.lit(False)
    level = categories.where(wanted).select("id")
    # An excluded id need not be a category of its own to exclude its children.
    below = categories.where(F.col("parent_id").isin(*excluded) if excluded else F.lit(False)).select("id")
    out, level = level.unionByName(below), below
    for _ in range(ANCESTRY - 2):
        level = categories.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
        out = out.unionByName(level)
    return out.distinct()


def linkable_posts(posts: DataFrame, categories: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Regular posts with text, in a topic that is not private (unless allowed), outside
    excluded categories. A post without a topic is never linked; one without a category may be."""
    ok = posts.where(F.coalesce(F.col("raw").rlike(r"\S"), F.lit(False)) & (F.col("post_type") == "regular") & F.col("topic_id").isNotNull())
    if not settings.include_private:
        ok = ok.where(~F.col("private"))
    if not settings.excluded_categories:
        return ok
    bad = excluded_categories(categories, settings.excluded_categories).select(F.col("id").alias("category_id"))
    return ok.withColumn("category_id", F.col("category_id").cast("long")).join(bad, "category_id", "left_anti")
