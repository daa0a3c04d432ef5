"""Alert rules: metric columns, and the state machine that fires and re-arms.

The machine is one function over (state, reading); batch replay and streaming
both run it per (rule, ticker) in order of time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspan.functions.stats import ratio


ZONE = ZoneInfo("Asia/Jerusalem")
# Which way a kind of rule looks; a series rule says so itself.
DIRECTIONS = {
    "upside_gt": "above", "price_below_fv": "above", "mos_gt": "above", "price_crosses_fv": "cross", "consensus_gap_gt": "above", "implied_growth_lt": "below",
    "price_above": "above", "price_below": "below", "pct_change_gt": "above", "series_threshold": "above",
}


@dataclass
class Rule:
    """Fires when the value is at or past ``threshold`` in its ``direction``
    (``above``, ``below``, or ``cross``: the sign of the distance changes);
    re-arms past it by ``hysteresis``; rests ``cooldown_hours``; at most
    ``daily_cap`` a day of ``ZONE`` (0: no cap). Readings that are older than
    ``stale_seconds`` when they are evaluated in market hours are passed over,
    and so are those of grey sources unless ``allow_grey``."""

    threshold: float
    direction: str = "above"
    hysteresis: float = 0.0
    cooldown_hours: float = 0.0
    daily_cap: int = 0
    stale_seconds: float = 900.0
    allow_grey: bool = False


@dataclass
class State:
    armed: bool = True
    last_value: float | None = None
    fired_at: float | None = None
    day: int = -1
    fired_today: int = 0


def local_day(ts: float) -> int:
    return datetime.fromtimestamp(ts, ZONE).toordinal()


def crossed(rule: Rule, value: float, before: float | None) -> bool:
    if rule.direction == "above":
        return value >= rule.threshold
    if rule.direction == "below":
        return value <= rule.threshold
    return before is not None and (value - rule.threshold) * (before - rule.threshold) < 0


def rearmed(rule: Rule, value: float) -> bool:
    if rule.direction == "above":
        return value < rule.threshold - rule.hysteresis
    if rule.direction == "below":
        return value > rule.threshold + rule.hysteresis
    return abs(value - rule.threshold) >= rule.hysteresis


def advance(rule: Rule, s: State, ts: float, value: float | None, age: float = 0.0, grey: bool = False, is_open: bool = True) -> str:
    """What a reading does: fired, hold, rearmed, cooldown, capped or nothing,
    and, without touching the state, missing, stale or grey."""
    if value is None or value != value:
        return "missing"
    if age > rule.stale_seconds and is_open:
        return "stale"
    if grey and not rule.allow_grey:
        return "grey"
    before, s.last_value = s.last_value, value
    if local_day(ts) != s.day:
        s.day, s.fired_today = local_day(ts), 0
    if not s.armed:
        s.armed = rearmed(rule, value)
        return "rearmed" if s.armed else "hold"
    if not crossed(rule, value, before):
        return "nothing"
    if s.fired_at is not None and ts - s.fired_at < rule.cooldown_hours * 3600:
        return "cooldown"
    if rule.daily_cap and s.fired_today >= rule.daily_cap:
        return "capped"
    s.armed, s.fired_at, s.fired_today = False, ts, s.fired_today + 1
    return "fired"


def with_rules(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Readings with each enabled rule of their ticker, or of all tickers where
    a rule names none. ``rules(rule_id, ticker, enabled, <fields of Rule>)``: an
    equi join by ticker; the rules for all are spread over the tickers first."""
    live = rules.where("enabled")
    named = live.where("ticker IS NOT NULL")
    tickers = readings.select("ticker").distinct()
    every = live.where("ticker IS NULL").drop("ticker").join(tickers).select(named.columns)
    return readings.join(named.unionByName(every).drop("enabled"), "ticker")


RULE_FIELDS = ["threshold", "direction", "hysteresis", "cooldown_hours", "daily_cap", "stale_seconds", "allow_grey"]


def rule_of(g: pd.DataFrame) -> Rule:
    return Rule(**{f: g[f].iloc[0] for f in RULE_FIELDS})


def run_rows(rule: Rule, s: State, g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["ts", "event_id"])
    ts = g["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6
    n = len(g)
    age, grey, is_open = (g[c].tolist() if c in g else [d] * n for c, d in (("age", 0.0), ("grey", False), ("is_open", True)))
    return g[["rule_id", "ticker", "event_id", "ts"]].assign(outcome=[advance(rule, s, *x) for x in zip(ts.tolist(), g["value"].tolist(), age, grey, is_open)])


OUTCOME = "rule_id string, ticker string, event_id long, ts timestamp_ntz, outcome string"


def replay(ruled: DataFrame) -> DataFrame:
    """:func:`with_rules` rows through the machine, each rule and ticker in order of time."""
    return ruled.groupBy("rule_id", "ticker").applyInPandas(lambda g: run_rows(rule_of(g), State(), g), OUTCOME)


def metric(kind: Column, last: Column, change_pct: Column, fair_value: Column, target: Column, implied_growth: Column, series_last: Column) -> Column:
    """The number a kind of rule looks at; null where a part is missing or zero."""
    up = lambda x: (ratio(F.when(x != 0, x), last) - 1) * 100
    return F.when(kind == "series_threshold", series_last).when(kind.isin("price_above", "price_below"), last).when(kind == "pct_change_gt", F.abs(change_pct)) \
        .when(kind == "consensus_gap_gt", up(target)).when(kind == "implied_growth_lt", F.when(last.isNotNull(), implied_growth * 100)).when(kind == "upside_gt", up(fair_value)) \
        .when(kind.isin("price_below_fv", "mos_gt"), (1 - ratio(last, fair_value)) * 100).when(kind == "price_crosses_fv", (ratio(last, fair_value) - 1) * 100)


def prev_close(trades: DataFrame, sessions: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Trades with the close to compare with: of the ticker's reference session
    its last price if the trade is on a later local day, else the close before
    it, and the trade's own ``fallback`` where that or the session is missing.
    ``sessions(ticker, day, last, before)``, one per ticker."""
    s = sessions.select("ticker", F.struct("day", "last", "before").alias("ref"))
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), "ts"))
    found = F.when(local > F.col("ref.day"), F.col("ref.last")).otherwise(F.coalesce("ref.before", "fallback"))
    return trades.join(s, "ticker", "left").withColumn("prev_close", F.when(F.col("ref").isNull(), F.col("fallback")).otherwise(found)).drop("ref")


def digest(fired: DataFrame, quiet: Column) -> DataFrame:
    """One message per channel and day for what fired in quiet hours."""
    return fired.where(quiet).groupBy("channel", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))
