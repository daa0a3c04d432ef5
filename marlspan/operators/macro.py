"""Macro dashboards: trailing z-scores, tiles, composite trails, islands of a
flag, event surprises and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions.stats import clip, ratio

from .series import by_series


def trailing(df: DataFrame, rows: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ts")))
    return df.withColumn("k", k).where(F.col("k") <= rows)


def last_z(df: DataFrame, rows: int) -> DataFrame:
    """The last value's z within its trailing window, clipped at 5; 0 without deviation."""
    s = trailing(df, rows).groupBy("series_id").agg(
        F.max_by("value", "ts").alias("last"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    z = F.when(F.col("sd") == 0, 0.0).otherwise(clip(ratio(F.col("last") - F.col("m"), F.col("sd")), -5.0, 5.0))
    return s.where("n >= 6").select("series_id", z.alias("z"))


def tiles(df: DataFrame, per_year: int, spark_rows: int = 24) -> DataFrame:
    """Last value, the one before, change, change on the year and a sparkline."""
    w = by_series()
    x = df.withColumns({"prev": F.lag("value").over(w), "year_ago": F.lag("value", per_year).over(w)})
    last = x.groupBy("series_id").agg(F.max_by(F.struct("ts", "value", "prev", "year_ago"), "ts").alias("x"))
    line = trailing(df, spark_rows).groupBy("series_id").agg(F.count("*").alias("spark_n"), F.avg("value").alias("spark_mean"))
    return last.join(line, "series_id").select(
        "series_id", F.col("x.ts").alias("ts"), F.col("x.value").alias("last"), F.col("x.prev").alias("prev"),
        (F.col("x.value") - F.col("x.prev")).alias("change"), ((ratio(F.col("x.value"), F.col("x.year_ago")) - 1) * 100).alias("yoy"), "spark_n", "spark_mean")


def z_trail(df: DataFrame, window: int) -> DataFrame:
    """Mean over series of the z within the last ``window`` rows, by date."""
    r = by_series().rowsBetween(-(window - 1), 0)
    z = F.when(F.count("value").over(r) >= 6, ratio(F.col("value") - F.avg("value").over(r), F.stddev_samp("value").over(r)))
    return df.withColumn("z", z).where("z IS NOT NULL").groupBy("ts").agg(F.avg("z").alias("z"), F.count("*").alias("n"))


def quadrant(growth, inflation):  # noqa: ANN001, ANN201
    return F.when((growth >= 0) & (inflation < 0), "goldilocks").when((growth >= 0) & (inflation >= 0), "reflation") \
        .when((growth < 0) & (inflation >= 0), "stagflation").otherwise("deflation")


def islands(df: DataFrame, flag: str) -> DataFrame:
    """Runs of rows with the flag: first and last date and length."""
    w = by_series()
    x = df.withColumn("__new", (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("__new").over(w))
    return x.where(F.col(flag)).groupBy("series_id", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("rows"))


def technical_recessions(df: DataFrame) -> DataFrame:
    """Two or more falls in a row: from the first one to the first rise after it."""
    w = by_series()
    fall = df.withColumns({"falls": F.coalesce(F.col("value") < F.lag("value").over(w), F.lit(False)), "next_ts": F.lead("ts").over(w)})
    x = fall.withColumn("__new", (F.col("falls") & ~F.coalesce(F.lag("falls").over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("__new").over(w))
    return x.where("falls").groupBy("series_id", "island").agg(F.min("ts").alias("start"), F.max_by("next_ts", "ts").alias("end"), F.count("*").alias("rows")) \
        .where("rows >= 2").drop("island")


def surprises(df: DataFrame) -> DataFrame:
    """``actual`` against ``consensus``: difference, percent, and the ratio to the
    deviation of the last 24 differences, not centred, from four on, clipped at 6."""
    s = df.withColumn("surprise", F.col("actual") - F.col("consensus"))
    r = Window.partitionBy("event_key").orderBy("ts").rowsBetween(-23, 0)
    sd = F.when(F.count("surprise").over(r) >= 4, F.stddev_samp("surprise").over(r))
    return s.withColumns({
        "surprise_pct": ratio(F.col("surprise"), F.abs("consensus")) * 100,
        "surprise_z": clip(ratio(F.col("surprise"), sd), -6.0, 6.0),
    })


def surprise_index(df: DataFrame, days: int = 90) -> DataFrame:
    """Importance-weighted mean z over the last ``days`` days at each release day."""
    daily = df.where("surprise_z IS NOT NULL").groupBy("country", F.to_date("ts").alias("day")).agg(
        F.sum(F.col("importance") * F.col("surprise_z")).alias("wz"), F.sum("importance").alias("w"))
    n = daily.withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    r = Window.partitionBy("country").orderBy("n").rangeBetween(-(days - 1), 0)
    return n.select("country", "day", ratio(F.sum("wz").over(r), F.sum("w").over(r)).alias("esi"))
