"""Catalog, calendar and text lookups: small rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name fragments and the unit, kind and category they stand for, first match first.
UNIT_HINTS = [("percent", "pct"), ("index", "index"), ("dollar", "usd"), ("part", "count")]
# Provider patterns of pasted addresses.
URL_KEYS = [("fred", r"fred\.[a-z.]+/series/(\w+)"), ("example", r"example\.(?:com|net|org)/(\w+/\d+)")]
# 8-K items and the kind of event they tell.
FILING_FORMS = {"us_10k": ["10-K", "10-Q"], "foreign_20f": ["20-F", "40-F", "6-K"]}


def catalog_filter(df: DataFrame, text: str, columns: list[str], tags: str) -> DataFrame:
    """Rows where any column, or any tag, contains ``text``."""
    q = F.lit(text.lower())
    hit = F.exists(F.col(tags), lambda t: F.contains(F.lower(t), q))
    for c in columns:
        hit = hit | F.contains(F.lower(c), q)
    return df.where(F.coalesce(hit, F.lit(False)))


def since(text: Column, now: Column) -> Column:
    """Start of ``24h``, ``7d``, ``30m`` before ``now``, or an ISO time."""
    n, unit = F.regexp_extract(text, "^(\\d+)([hdm])$", 1).try_cast("int"), F.regexp_extract(text, "^(\\d+)([hdm])$", 2)
    span = F.when(unit == "h", F.make_dt_interval(F.lit(0), n)).when(unit == "d", F.make_dt_interval(n)).when(unit == "m", F.make_dt_interval(F.lit(0), F.lit(0), n))
    return F.coalesce(now - span, text.try_cast("timestamp_ntz"))


def freshness(age_days: Column, enabled: Column, failed: Column, allowed: Column) -> Column:
    return F.when(~enabled, "paused").when(failed, "failed").when(age_days.isNull(), "never").when(age_days > allowed, "late").otherwise("ok")


def symbol_class(symbol: Column) -> Column:
    return F.when(symbol.rlike("^\\^"), "index").when(symbol.rlike("=X$"), "fx").when(symbol.rlike("=F$"), "future") \
        .when(symbol.rlike("\\.TA$"), "tase").when(symbol.rlike("^[A-Z]{1,5}$"), "us").otherwise("other")


def guess(name: Column, hints: list[tuple[str, str]], default: str) -> Column:
    out = None
    for fragment, label in hints:
        hit = F.contains(F.lower(name), F.lit(fragment))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def provider_key(url: Column) -> Column:
    """``provider:key`` of a pasted address, by the first pattern that fits."""
    found = [F.when(F.regexp_extract(url, p, 1) != "", F.concat(F.lit(f"{name}:"), F.regexp_extract(url, p, 1))) for name, p in URL_KEYS]
    return F.coalesce(*found)


def nth_weekday(month_start: Column, day: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(month_start, 1), day), 7 * (n - 1))


def last_weekday(month_start: Column, day: str) -> Column:
    return F.date_sub(F.next_day(F.last_day(month_start), day), 7)


def period_of(text: Column) -> Column:
    """``Q2 2024``, ``H1 2024``, ``Jan 2024`` or ``2024`` as a period key."""
    year = F.regexp_extract(text, "(\\d{4})", 1)
    part = F.upper(F.regexp_extract(text, "(?i)\\b([QH][1-4])\\b", 1))
    month = F.regexp_extract(F.lower(text), "\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1)
    number = F.lpad((F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), month)).cast("string"), 2, "0")
    return F.when(year == "", None).when(part != "", F.concat(year, F.lit("-"), part)).when(month != "", F.concat(year, F.lit("-"), number)).otherwise(year)


def peers(pins: Column, auto: Column, excluded: Column, me: Column) -> Column:
    """Pinned peers, then found ones, without the excluded and oneself."""
    return F.array_except(F.array_distinct(F.concat(pins, auto)), F.concat(excluded, F.array(me)))


def decisions(df: DataFrame, today: Column) -> DataFrame:
    """Per bank the next and last meeting, days to go and how many are left."""
    return df.groupBy("bank").agg(
        F.min(F.when(F.col("day") >= today, F.col("day"))).alias("next_day"), F.max(F.when(F.col("day") < today, F.col("day"))).alias("last_day"),
        F.count_if(F.col("day") >= today).alias("remaining")).withColumn("days_to_go", F.datediff("next_day", today))


def snap(instants: DataFrame, periods: DataFrame) -> DataFrame:
    """Instants moved to the entity's latest period end at or before them; those before the first go."""
    p = periods.select("entity", F.col("period_end").alias("ts"), F.lit(0).alias("side"), F.col("period_end").alias("snapped"))
    i = instants.withColumns({"side": F.lit(1), "snapped": F.lit(None).cast("timestamp_ntz")})
    w = Window.partitionBy("entity").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = i.unionByName(p, allowMissingColumns=True)
    return both.withColumn("snapped", F.last("snapped", ignorenulls=True).over(w)).where("side = 1 AND snapped IS NOT NULL").drop("side")


def map_diff(a: Column, b: Column) -> Column:
    """Keys whose values differ between two maps, in order."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


def checksum(value: Column) -> Column:
    return F.substring(F.sha2(F.to_json(value).cast("binary"), 256), 1, 16)


def classify_forms(forms: Column) -> Column:
    out = None
    for label, names in FILING_FORMS.items():
        hit = F.arrays_overlap(forms, F.array(*[F.lit(n) for n in names]))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unknown")
