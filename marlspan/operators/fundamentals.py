"""Company facts: filing views, period algebra, resolution, ratios, validation.
Facts are long, ``(entity, field, period_end, value, ...)``; statements are a
pivot of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def point_in_time(df: DataFrame) -> DataFrame:
    """First-filed and last-filed value of each (entity, field, period), by filing date and priority."""
    first, last = F.struct("filed", "priority"), F.struct("filed", -F.col("priority"))
    return df.groupBy("entity", "field", "period_end").agg(
        F.min_by("value", first).alias("first_value"), F.max_by("value", last).alias("last_value"), F.countDistinct("filed").alias("filings"))


def resolve(df: DataFrame) -> DataFrame:
    """One value per (entity, field, period): within a source a restated value
    wins, then confidence, source rank and filing date decide."""
    by_source = Window.partitionBy("entity", "field", "period_end", "source").orderBy(F.desc("restated"), F.desc("filed"))
    best = Window.partitionBy("entity", "field", "period_end").orderBy(F.desc("confidence"), F.asc("source_rank"), F.desc("filed"))
    x = df.where("approved").withColumn("k", F.row_number().over(by_source)).where("k = 1")
    return x.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def statements(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.groupBy("entity", "period_end").pivot("field", fields).agg(F.first("value"))


def prune_empty(df: DataFrame, core: list[str]) -> DataFrame:
    """Facts of the periods that have a core field."""
    periods = df.where(F.col("field").isin(core) & F.col("value").isNotNull()).select("entity", "period_end").distinct()
    return df.join(periods, ["entity", "period_end"], "left_semi")


def ttm(df: DataFrame) -> DataFrame:
    """Sums of four consecutive quarters; null where one of them is missing."""
    w = Window.partitionBy("entity", "field").orderBy("period_end").rowsBetween(-3, 0)
    q = F.year("period_end") * 4 + F.quarter("period_end")
    x = df.withColumn("q", q)
    whole = (F.count("value").over(w) == 4) & (F.col("q") - F.min("q").over(w) == 3)
    return x.withColumn("ttm", F.when(whole, F.sum("value").over(w))).drop("q")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """New filings over stored facts: an equal value changes nothing, another one
    becomes a restated row beside the first."""
    o = old.select(*keys, F.col("value").alias("was"))
    both = new.join(o, keys, "left")
    changed = F.col("was").isNotNull() & (F.abs(F.col("value") - F.col("was")) > tolerance)
    fresh = both.where(F.col("was").isNull() | changed).select(*keys, "value", changed.alias("restated"))
    return old.select(*keys, "value", F.lit(False).alias("restated")).unionByName(fresh)
