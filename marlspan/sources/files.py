"""Readers and writers of text formats, as column expressions over raw lines,
and the sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit words and what they multiply by.
UNITS = {"": 1.0, "%": 0.01, "k": 1e3, "m": 1e6, "mm": 1e6, "mn": 1e6, "bn": 1e9, "b": 1e9, "t": 1e12}


def normalize(df: DataFrame) -> DataFrame:
    """``ts, value`` with the types of the lake; rows without a time go."""
    return df.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value")).na.drop(subset=["ts"])


def parse_csv_lines(lines: DataFrame) -> DataFrame:
    """Lines ``date,value`` with comma, semicolon or tab; a month stands for its
    first day; headers and bad rows go."""
    parts = F.split(F.trim("value"), "[,;\t]")
    day = F.coalesce(F.try_to_date(F.get(parts, 0), "yyyy-MM-dd"), F.try_to_date(F.concat(F.get(parts, 0), F.lit("-01")), "yyyy-MM-dd"))
    return lines.select(day.cast("timestamp_ntz").alias("ts"), F.get(parts, 1).try_cast("double").alias("value")).na.drop()


def read_csv_observations(spark, path: str) -> DataFrame:
    return parse_csv_lines(spark.read.text(path))


def sdmx_period(period: Column) -> Column:
    """Start of ``2020``, ``2020-Q1``, ``2020-S1``, ``2020-01`` or ``2020-01-31``."""
    year, part = F.substring(period, 1, 4).try_cast("int"), F.substring(period, 7, 1).try_cast("int")
    return F.when(F.length(period) == 4, F.make_date(year, F.lit(1), F.lit(1))) \
        .when(period.rlike("^\\d{4}-Q[1-4]$"), F.make_date(year, part * 3 - 2, F.lit(1))) \
        .when(period.rlike("^\\d{4}-S[12]$"), F.make_date(year, part * 6 - 5, F.lit(1))) \
        .when(F.length(period) == 7, F.try_to_date(F.concat(period, F.lit("-01")))) \
        .otherwise(F.try_to_date(period)).cast("timestamp_ntz")


def number_with_unit(raw: Column) -> Column:
    """``12.5%``, ``1,200 mm``, ``(3)``, ``120K``: a number with its unit applied; null if there is none."""
    text = F.lower(F.regexp_replace(raw, "[\\s,$]", ""))
    negative = text.startswith("(") | text.startswith("-")
    digits = F.regexp_extract(text, "(\\d+(?:\\.\\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(text, "\\d(?:\\.\\d+)?\\)?([a-z%]*)$", 1)
    units = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(negative, -digits).otherwise(digits) * F.coalesce(F.try_element_at(units, unit), F.lit(1.0))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_cache(df: DataFrame, path: str, by: str) -> None:
    """A result cache that is read by ``by``; replaced as a whole."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_cache(spark, path: str, by: str, key: str, score: str, name: str, limit: int) -> DataFrame:
    """The strongest rows of one key of a cache; only its folder is read."""
    return spark.read.parquet(path).where(F.col(by) == key).orderBy(F.abs(score).desc(), name).limit(limit)


def shared(spark) -> str:  # noqa: ANN001
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where
    that is unset and all runs in one process, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (path or tempfile.mkdtemp(prefix="marlspan-")).rstrip("/")


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet under a name of its own beginning with ``path``, and read back."""
    at = f"{path}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def widened(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its few files give fewer tasks, for work that
    is dear by row; the splits of a large table stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
