"""Series operators on long tables ``(series_id, ts, value)``: transforms,
resampling, alignment and as-of joins. All windows are partitioned by series,
so one call serves one series or millions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions.stats import full, ratio

ROWS_PER_YEAR = {"1d": 252, "1w": 52, "1mo": 12, "1q": 4, "1y": 1}
UNITS = {"1w": ("week", "interval 7 days"), "1mo": ("month", "interval 1 month"), "1q": ("quarter", "interval 3 months"), "1y": ("year", "interval 12 months")}
FREQ_RANK = {"1d": 0, "1w": 1, "1mo": 2, "1q": 3, "1y": 4}


def by_series(*more: str):
    return Window.partitionBy("series_id", *more).orderBy("ts")


def transform(df: DataFrame, kind: str, freq: str = "1mo", window: int = 20) -> DataFrame:
    """level, log_ret, diff, diff_bp, pct, yoy or zscore; rows without a value go."""
    v, w = F.col("value"), by_series()
    before = F.lag(v).over(w)
    if kind == "level":
        new = v
    elif kind == "log_ret":
        new = F.when((v > 0) & (before > 0), F.ln(ratio(v, before)))
    elif kind == "diff":
        new = v - before
    elif kind == "diff_bp":
        new = (v - before) * 100
    elif kind == "pct":
        new = (ratio(v, before) - 1) * 100
    elif kind == "yoy":
        new = (ratio(v, F.lag(v, ROWS_PER_YEAR[freq]).over(w)) - 1) * 100
    elif kind == "zscore":
        r = w.rowsBetween(-(window - 1), 0)
        new = full(ratio(v - F.avg(v).over(r), F.stddev_samp(v).over(r)), F.count(v).over(r), window)
    else:
        raise ValueError(f"no transform {kind}")
    return df.withColumn("value", new).where("value IS NOT NULL").select("series_id", "ts", "value")


def resample(df: DataFrame, freq: str, how: str = "last") -> DataFrame:
    """Periods closed on the left and labelled by their right end; empty ones give no row."""
    if freq == "1d":
        return df
    unit, step = UNITS[freq]
    agg = {"last": F.max_by("value", "ts"), "first": F.min_by("value", "ts"), "mean": F.avg("value"), "sum": F.sum("value")}[how]
    label = (F.date_trunc(unit, "ts") + F.expr(step)).cast("timestamp_ntz")
    return df.where("value IS NOT NULL").groupBy("series_id", label.alias("ts")).agg(agg.alias("value"))


def resample_by_kind(df: DataFrame, kinds: DataFrame, freq: str) -> DataFrame:
    """The last value, but the mean where ``kinds(series_id, value_kind)`` says yield or spread."""
    unit, step = UNITS[freq]
    label = (F.date_trunc(unit, "ts") + F.expr(step)).cast("timestamp_ntz")
    both = df.join(kinds, "series_id").groupBy("series_id", "value_kind", label.alias("ts")).agg(
        F.max_by("value", "ts").alias("last"), F.avg("value").alias("mean"))
    return both.select("series_id", "ts", F.when(F.col("value_kind").isin("yield", "spread"), F.col("mean")).otherwise(F.col("last")).alias("value"))


def pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Inner join of two series on ``ts``: ``ts, a, b``."""
    left = df.where(F.col("series_id") == a).select("ts", F.col("value").alias("a"))
    return left.join(df.where(F.col("series_id") == b).select("ts", F.col("value").alias("b")), "ts")


def pair_full(df: DataFrame, a: str, b: str, limit: int, key: Column | None = None) -> DataFrame:
    """Full join with at most ``limit`` rows of forward fill, complete rows only."""
    left = df.where(F.col("series_id") == a).select("ts", F.col("value").alias("a"))
    right = df.where(F.col("series_id") == b).select("ts", F.col("value").alias("b"))
    w = Window.partitionBy(F.lit(f"{a}|{b}")).orderBy("ts").rowsBetween(-limit, 0)
    filled = left.join(right, "ts", "full").select("ts", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("a", "b")])
    return filled.where("a IS NOT NULL AND b IS NOT NULL")


def shift_column(df: DataFrame, column: str, k: int, keys: list[str]) -> DataFrame:
    """``column`` moved by ``k`` aligned rows; incomplete rows go."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.withColumn(column, F.lag(column, k).over(w)).where(F.col(column).isNotNull())


def all_pairs(df: DataFrame) -> DataFrame:
    """Every unordered pair of series on shared dates: ``a_id, b_id, ts, a, b``."""
    left = df.select(F.col("series_id").alias("a_id"), "ts", F.col("value").alias("a"))
    right = df.select(F.col("series_id").alias("b_id"), "ts", F.col("value").alias("b"))
    return left.join(right, "ts").where("a_id < b_id")


def align_pairs(df: DataFrame, freq: str, lag_b: int = 0, min_overlap: int = 10) -> DataFrame:
    """All pairs on one grid with ``b`` lagged; too short pairs get a status instead of an error."""
    p = all_pairs(resample(df, freq))
    w = Window.partitionBy("a_id", "b_id").orderBy("ts")
    lagged = p.withColumn("b", F.lag("b", lag_b).over(w) if lag_b else F.col("b")).where("b IS NOT NULL")
    n = F.count("*").over(Window.partitionBy("a_id", "b_id"))
    return lagged.withColumn("status", F.when(n >= min_overlap, "ok").otherwise("short"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its ``ts``:
    a union and one window, no range join."""
    l = left.withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    r = right.select(*keys, "ts", value).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__side")


def asof_within(left: DataFrame, right: DataFrame, keys: list[str], value: str, days: int) -> DataFrame:
    """As-of with a tolerance: nothing older than ``days``."""
    both = asof_backward(left, right.withColumn("__at", F.col("ts")).withColumn(value, F.struct("__at", value)).drop("__at"), keys, value)
    fresh = F.col(f"{value}.__at") >= F.col("ts") - F.make_dt_interval(F.lit(days))
    return both.withColumn(value, F.when(fresh, F.col(f"{value}.{value}")))


def first_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Forward as-of: the first ``value`` at or after ``ts``. Read backwards in
    time, it is the last one so far, so the frame runs on and is read once."""
    l = left.withColumn("__side", F.lit(0)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    r = right.select(*keys, "ts", value).withColumn("__side", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.where("__side = 0").drop("__side")


def rebase(df: DataFrame) -> DataFrame:
    """Values as percent of the series' first value."""
    w = by_series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("value", ratio(F.col("value"), F.first("value", ignorenulls=True).over(w)) * 100)


def common_dates(df: DataFrame) -> DataFrame:
    """Rows of the dates that every series has."""
    n = df.select("series_id").distinct().count()
    dates = df.where("value IS NOT NULL").groupBy("ts").agg(F.countDistinct("series_id").alias("n")).where(F.col("n") == n).select("ts")
    return df.join(dates, "ts", "left_semi")


_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_][A-Za-z0-9_]*)|([-+*/()]))")


def formula_sql(text: str, names: dict[str, str]) -> str:
    """``text`` as an SQL expression over the columns that ``names`` gives its
    identifiers; anything but numbers, names, ``+ - * / ( )`` is refused."""
    at, out = 0, []
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"formula not understood at {text[at:at + 10]!r}")
        if m[2] and m[2] not in names:
            raise ValueError(f"formula names an unknown series {m[2]!r}")
        out.append(m[1] and f"{m[1]}D" or m[2] and f"`{names[m[2]]}`" or m[3])
        at = m.end()
    return " ".join(out)


def formula_series(df: DataFrame, formula: str, names: dict[str, str], series_id: str, fill: int = 10) -> DataFrame:
    """A derived series: the operands side by side, filled forward by at most
    ``fill`` rows, and the formula where all are there. ``names`` maps the
    formula's identifiers to series ids."""
    ids = list(names.values())
    wide = df.where(F.col("series_id").isin(ids)).groupBy("ts").pivot("series_id", ids).agg(F.first("value"))
    w = Window.partitionBy(F.lit(series_id)).orderBy("ts").rowsBetween(-fill, 0)
    filled = wide.select("ts", *[F.last(f"`{i}`", ignorenulls=True).over(w).alias(i) for i in ids])
    value = F.expr(re.sub(r"(`[^`]+`|[\d.]+D|\)) / (`[^`]+`)", r"\1 / nullif(\2, 0)", formula_sql(formula, names)))
    return filled.select(F.lit(series_id).alias("series_id"), "ts", value.alias("value")).where("value IS NOT NULL")


def coarsest(freqs: list[str]) -> str:
    """The grid on which series of these frequencies meet."""
    return max(freqs, key=FREQ_RANK.__getitem__)


def freq_rank(freq: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in FREQ_RANK.items() for x in (k, v)]), freq)


def resolved_freq(a: Column, b: Column, asked: Column) -> tuple[Column, Column]:
    """The grid of two native frequencies, the coarser one where ``auto`` is
    asked, and whether what is asked is finer than that and would invent rows."""
    native = F.when(freq_rank(a) >= freq_rank(b), a).otherwise(b)
    finer = (asked != "auto") & (freq_rank(asked) < freq_rank(native))
    return F.when(asked == "auto", native).otherwise(asked), F.coalesce(finer, F.lit(False))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, with ``n``, the number of its rows."""
    by = Window.partitionBy(*keys)
    return df.withColumns({"__k": F.row_number().over(by.orderBy(*order)), "n": F.count("*").over(by)}).where("__k = 1").drop("__k")


def publication_lag(df: DataFrame, lags: DataFrame) -> DataFrame:
    """Dates moved to when the value was known; ``lags(series_id, lag_days)``."""
    return df.join(lags, "series_id", "left").withColumn(
        "ts", (F.col("ts") + F.make_dt_interval(F.coalesce("lag_days", F.lit(0)))).cast("timestamp_ntz")).drop("lag_days")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merge of an append: of equal keys the new row stays."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__seq"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__seq")
