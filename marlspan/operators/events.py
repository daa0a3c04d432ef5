"""Event calendar: merging sources, vintages, reactions, calendar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions.stats import ratio


# Which tier of source is believed first, by field; other fields go by title.
TIERS = {
    "title": ["official", "rule", "vendor", "forexfactory", "user"],
    "actual": ["official", "vendor", "forexfactory", "rule", "user"],
    "previous": ["official", "vendor", "forexfactory", "rule", "user"],
    "consensus": ["vendor", "forexfactory", "official", "rule", "user"],
    "forecast_alt": ["forexfactory", "vendor", "official", "rule", "user"],
}


def tier_rank(field: str, tier: Column) -> Column:
    order = TIERS.get(field, TIERS["title"])
    place = F.array_position(F.array(*[F.lit(t) for t in order]), tier)
    return F.when(place > 0, place - 1).otherwise(len(order))


def merge_reports(df: DataFrame, fields: list[str]) -> DataFrame:
    """Reports of one release as one event.

    ``df(event_id, event_key, period, day, tier, status, importance, tag,
    *fields)``. Reports with a period are a group by key and period. One without
    a period joins a group of its key that has a report on the same day, else on
    the day before, else on the day after (of several groups the one whose first
    report comes first), else it is a group by key and day. Each field comes
    from the tier that is believed first for it, of equals the earliest report;
    importance is the highest, tags are united, and a scheduled event with an
    actual is released.
    """
    told, bare = df.where("period IS NOT NULL"), df.where("period IS NULL")
    firsts = told.groupBy("event_key", "period").agg(F.min("event_id").alias("first"))
    days = told.select("event_key", "period", "day").distinct().join(firsts, ["event_key", "period"])
    days = days.groupBy("event_key", F.col("day").alias("at")).agg(F.min_by("period", "first").alias("found"))
    shifts = F.array(F.lit(0), F.lit(-1), F.lit(1))
    near = bare.select("event_id", "event_key", F.posexplode(shifts).alias("place", "shift"), "day").withColumn("at", F.date_add("day", F.col("shift")))
    near = near.join(days, ["event_key", "at"]).groupBy("event_id").agg(F.min_by("found", "place").alias("found"))
    bare = bare.join(near, "event_id", "left").withColumn("period", F.col("found")).drop("found")
    every = told.unionByName(bare).withColumn("on", F.when(F.col("period").isNull(), F.col("day")))
    best = lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(tier_rank(f, F.col("tier")).alias("rank"), "event_id")))
    merged = every.groupBy("event_key", "period", "on").agg(
        *[best(f).alias(f) for f in fields], best("status").alias("status"), F.max("importance").alias("importance"), F.min("day").alias("day"),
        F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"), F.count("*").alias("reports"))
    released = F.when((F.col("status") == "scheduled") & F.col("actual").isNotNull(), "released").otherwise(F.col("status"))
    return merged.withColumn("status", released)


def upsert_vintages(stored: DataFrame, fresh: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """What an ingest does to stored events: per fresh row ``action`` (``new``,
    ``vintage`` or ``same``; ``kept`` where a user's row is left alone), the
    numbers of the vintage, which keep what the fresh row lacks, the status and
    the surprise. ``stored(*keys, *numbers, status, provider)`` has the latest
    vintage; a number that the fresh row lacks changes nothing."""
    was = stored.select(*keys, F.struct(*numbers, "status", "provider").alias("was"))
    both = fresh.join(was, keys, "left")
    there = F.col("was").isNotNull()
    moved = F.lit(False)
    for n in numbers:
        moved = moved | (F.col(n).isNotNull() & (~there | ~F.col(n).eqNullSafe(F.col(f"was.{n}"))))
    users = there & (F.col("was.provider") == "user") & (F.col("provider") != "user")
    action = F.when(users, "kept").when(moved, F.when(there, "vintage").otherwise("new")).otherwise("same")
    now = {n: F.coalesce(F.col(n), F.col(f"was.{n}")) for n in numbers}
    revised = there & F.col("was.actual").isNotNull() & now["actual"].isNotNull() & (now["actual"] != F.col("was.actual"))
    status = F.when(F.col("action") == "kept", F.col("was.status")).when(F.col("action") == "same", F.coalesce("was.status", "status")).when(revised, "revised") \
        .when(now["actual"].isNotNull(), "released").otherwise(F.coalesce("was.status", "status"))
    surprise = now["actual"] - now["consensus"]
    return both.withColumn("action", action).select(
        *keys, "action", status.alias("status"), *[F.when(F.col("action") == "kept", F.col(f"was.{n}")).otherwise(c).alias(n) for n, c in now.items()],
        F.when(F.col("action").isin("new", "vintage"), surprise).alias("surprise"),
        F.when(F.col("action").isin("new", "vintage"), ratio(surprise, F.abs(now["consensus"])) * 100).alias("surprise_pct"))


def near_days(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df(key, day, id)`` with the row of ``other(key, day, other_id)`` of the
    same key within a day: the same day first, then the day before, then the day
    after. An equi join on shifted days, no range join."""
    order = F.array(F.lit(0), F.lit(-1), F.lit(1))
    shifted = df.select("*", F.posexplode(order).alias("place", "shift")).withColumn("at", F.date_add("day", F.col("shift")))
    hit = shifted.join(other.select(key, F.col("day").alias("at"), "other_id"), [key, "at"])
    return hit.groupBy("id", key, "day").agg(F.min_by("other_id", F.struct("place", "other_id")).alias("other_id"))


def market_reaction(events: DataFrame, bars: DataFrame, lookback: int = 60, least: int = 10, least_bars: int = 20, ahead_days: int = 5) -> DataFrame:
    """How strongly the bar of an event stands out: ``event_id, ticker, session,
    ret, ret_z, vol_z, score``.

    ``events(event_id, ticker, day)``, ``bars(ticker, ts, close, volume)``. An
    event sees the bars from ``2 * lookback`` days before its day to
    ``ahead_days`` after. Its session is the first bar from its day on; its
    measure are the last ``lookback`` bars before. ``ret_z`` is the absolute
    return by the deviation of theirs, ``vol_z`` the volume's z, and the score
    their sum over six, at most one. Without a session, with fewer than
    ``least`` bars before or ``least_bars`` in all, the score is 0 and the rest
    null. Each bar carries its predecessors, so a day meets one bar only. Days of
    tickers are worked out once each, whatever the number of their events.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    facts = F.struct(F.to_date("ts").alias("day"), (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"), "volume")
    b = bars.select("ticker", "ts", "close", "volume", facts.alias("bar"))
    b = b.withColumns({"past": F.collect_list("bar").over(w.rowsBetween(-lookback - 1, -1)), "next": F.collect_list("bar.day").over(w.rowsBetween(0, ahead_days))})
    e = events.select("ticker", F.to_date("day").cast("timestamp_ntz").alias("ts")).distinct().withColumn("side", F.lit(0))
    both = e.unionByName(b.select("ticker", "ts", F.struct("ts", "bar", "past", "next").alias("hit"), F.lit(1).alias("side")), allowMissingColumns=True)
    back = Window.partitionBy("ticker").orderBy(F.desc("ts"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("hit", F.last("hit", ignorenulls=True).over(back)).where("side = 0").select(
        "ticker", F.to_date("ts").alias("day"), "hit.ts", "hit.bar", "hit.past", "hit.next")
    inside = lambda x: x["day"] >= F.date_sub("day", 2 * lookback)
    seen = seen.withColumn("window", F.filter("past", inside)).withColumn("n_ahead", F.size(F.filter("next", lambda x: x <= F.date_add("day", ahead_days))))
    # the first bar of the window has no return there; one bar more than the measure tells whether the window starts before it
    seen = seen.withColumn("whole", F.size("window") > lookback)
    seen = seen.withColumn("window", F.when(F.col("whole"), F.slice("window", -lookback, lookback)).when(F.size("window") > 0, F.concat(
        F.array(F.struct(F.col("window")[0]["day"].alias("day"), F.lit(None).cast("double").alias("ret"), F.col("window")[0]["volume"].alias("volume"))),
        F.slice("window", 2, lookback))).otherwise(F.col("window")))
    x = seen.select("ticker", "day", "ts", "bar", "n_ahead", F.explode_outer("window").alias("x"))
    m = x.groupBy("ticker", "day").agg(
        F.any_value("ts").alias("ts"), F.any_value("bar").alias("bar"), F.any_value("n_ahead").alias("n_ahead"), F.count("x").alias("n"),
        F.stddev_samp("x.ret").alias("ret_sd"), F.avg("x.volume").alias("vol_mean"), F.stddev_samp("x.volume").alias("vol_sd"))
    known = (F.col("n_ahead") > 0) & (F.col("n") >= least) & (F.col("n") + F.col("n_ahead") >= least_bars)
    ret_z = F.when(F.col("bar.ret").isNotNull() & (F.col("ret_sd") > 1e-9), F.abs("bar.ret") / F.col("ret_sd")).otherwise(0.0)
    vol_z = F.when(F.col("vol_sd") > 1e-9, (F.coalesce("bar.volume", F.lit(0.0)) - F.col("vol_mean")) / F.col("vol_sd")).otherwise(0.0)
    score = F.least(F.lit(1.0), (ret_z + F.greatest(F.lit(0.0), vol_z)) / 6)
    told = m.select("ticker", "day", *[F.when(known, c).alias(n) for n, c in (
        ("session", F.col("ts")), ("ret", F.col("bar.ret")), ("ret_z", F.round(ret_z, 2)), ("vol_z", F.round(vol_z, 2)))],
        F.when(known, F.round(score, 3)).otherwise(0.0).alias("score"))
    return events.select("event_id", "ticker", F.to_date("day").alias("day")).join(told, ["ticker", "day"], "left") \
        .select("event_id", "ticker", "session", "ret", "ret_z", "vol_z", F.coalesce("score", F.lit(0.0)).alias("score"))


def third_friday(month_start: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(month_start, 1), "FRI"), 14)


def option_expiry(spark, start: str, end: str, holidays: list[str]) -> DataFrame:  # noqa: ANN001
    """Third Fridays of the months, the day before where that is a holiday."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    day = third_friday(F.col("month"))
    closed = F.array(*[F.lit(h).cast("date") for h in holidays])
    return months.select("month", F.when(F.array_contains(closed, day), F.date_sub(day, 1)).otherwise(day).alias("expiry"),
                         (F.month("month") % 3 == 0).alias("quadruple"))


def market_open(ts: Column, zone: str, opens: int, closes: int, days: list[int]) -> Column:
    """Whether ``ts`` (UTC) is within the session: minutes of the local day, weekdays from Monday = 0."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    minute = F.hour(local) * 60 + F.minute(local)
    return F.weekday(local).isin(days) & (minute >= opens) & (minute < closes)


def quiet(minute: Column, start: int, end: int) -> Column:
    """Inside a window of the day that may wrap over midnight."""
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def business_days(spark, start: str, end: str, closed: list[str], weekend: list[int]) -> DataFrame:  # noqa: ANN001
    """Each day with the next open day at or after it."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    shut = F.weekday("day").isin(weekend) | F.col("day").isin([F.lit(c).cast("date") for c in closed])
    back = Window.partitionBy(F.lit(1)).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("next_open", F.last(F.when(~shut, F.col("day")), ignorenulls=True).over(back))


def fomc_minutes(decision: Column) -> Column:
    """Minutes come out three weeks after the decision."""
    return F.date_add(decision, 21)


def beige_book(decision: Column) -> Column:
    """The survey comes out two weeks before the decision."""
    return F.date_sub(decision, 14)


def cbs_release(nominal: DataFrame, closed: DataFrame, price_index: Column, back_days: int = 14) -> DataFrame:
    """``nominal(id, day)`` with ``release``, naive UTC: price indices at 18:30
    Jerusalem time, or at 14:00 of the open day before where the day is a Friday,
    a Saturday or in ``closed(day)``; other releases at 13:00 of the last open
    day up to theirs. The days before are looked up by equi join, ``back_days``
    of them; a longer closure gives null."""
    days = nominal.withColumn("price_index", price_index).withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(back_days))))
    days = days.withColumn("at", F.date_sub("day", F.col("back")))
    shut = closed.select(F.col("day").alias("at"), F.lit(True).alias("shut")).distinct()
    open_ = days.join(F.broadcast(shut), "at", "left").where("shut IS NULL").where(~F.weekday("at").isin(4, 5))
    first = open_.groupBy("id").agg(F.min_by(F.struct("at", "back", "price_index"), "back").alias("x"))
    minutes = F.when(~F.col("x.price_index"), 13 * 60).when(F.col("x.back") == 0, 18 * 60 + 30).otherwise(14 * 60)
    local = F.col("x.at").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return nominal.join(first, "id", "left").select("id", "day", F.convert_timezone(F.lit("Asia/Jerusalem"), F.lit("UTC"), local).alias("release"))


def reporting_deadlines(years: DataFrame) -> DataFrame:
    """``years(year)``: the exchange's statutory report dates, ``year, deadline, period, label``."""
    y = F.col("year")
    one = lambda m, d, p, label: F.struct(F.make_date(y, F.lit(m), F.lit(d)).alias("deadline"), F.lit(p).alias("period"), label.alias("label"))
    q = lambda k: F.concat(F.lit(f"Q{k} "), y.cast("string"), F.lit(" report"))
    return years.select("year", F.inline(F.array(one(3, 31, "FY", F.concat(F.lit("annual report FY"), (y - 1).cast("string"))), one(5, 31, "Q1", q(1)), one(8, 31, "Q2", q(2)), one(11, 30, "Q3", q(3)))))


def month_range(df: DataFrame, start: str, end: str, step: int = 1) -> DataFrame:
    """A row for each month, or each quarter with ``step`` 3, that [start, end] touches: ``year, part``."""
    unit = "month" if step == 1 else "quarter"
    days = F.explode(F.sequence(F.trunc(start, unit), F.trunc(end, unit), F.make_ym_interval(F.lit(0), F.lit(step))))
    return df.withColumn("__at", days).withColumns({"year": F.year("__at"), "part": F.month("__at") if step == 1 else F.quarter("__at")}).drop("__at")
