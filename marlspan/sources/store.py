"""The lake of series on disk: Parquet in folders by a hash of the series.

A write replaces only the folders of the series that it touches, in one
dynamic overwrite: new files are staged aside and take the folders' place at
the job's commit, so a write that fails leaves the old rows, and one that is
tried again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspan.operators.series import last_wins

#: Folders of a lake; a series is in one of them.
FOLDERS = 256


def folder(series: Column, n: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(series), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, n: int) -> None:
    placed = rows.withColumn("folder", folder(F.col("series_id"), n)).repartition("folder").sortWithinPartitions("folder", "series_id", "ts")
    placed.write.partitionBy("folder").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def create(rows: DataFrame, path: str, n: int = FOLDERS) -> None:
    """A new lake of ``rows(series_id, ts, value)``."""
    _write(rows, path, n)


def read(spark: SparkSession, path: str, series: list[str] | None = None, n: int = FOLDERS) -> DataFrame:
    """``series_id, ts, value``; with ``series`` only their folders are read."""
    rows = spark.read.parquet(path)
    if series is not None:
        at = spark.range(1).select(F.array(*[folder(F.lit(s), n) for s in series]).cast("array<int>")).first()[0]
        rows = rows.where(F.col("folder").isin(sorted(set(at)))).where(F.col("series_id").isin(series))
    return rows.drop("folder")


def upsert(new: DataFrame, path: str, n: int = FOLDERS) -> None:
    """Rows of ``new`` replace stored ones of the same series and time, others
    are added; folders of other series stay as they are."""
    spark = new.sparkSession
    touched = new.select(folder(F.col("series_id"), n).alias("folder")).distinct()
    # at most ``n`` numbers
    old = spark.read.parquet(path).join(F.broadcast(touched), "folder", "left_semi").drop("folder")
    _write(last_wins(old, new.select(old.columns), ["series_id", "ts"]), path, n)


def replace_from(new: DataFrame, since: DataFrame, path: str, n: int = FOLDERS) -> None:
    """Per series of ``since(series_id, since)`` the stored rows from then on give way to those of ``new``."""
    spark = new.sparkSession
    touched = since.select(folder(F.col("series_id"), n).alias("folder")).distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), "folder", "left_semi").drop("folder")
    kept = old.join(since, "series_id", "left").where(F.col("since").isNull() | (F.col("ts") < F.col("since"))).select(old.columns)
    _write(kept.unionByName(new.select(old.columns)), path, n)
