"""Regime labels of a series: bands, trends, volatility quantiles, user windows
and two-state Markov switching. All give ``series_id, ts, regime``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions import kernels

from .series import by_series

# The presets' series, kinds, edges and labels.
PRESETS = {
    "vix": ("fred:VIXCLS", "bands", {"edges": [15.0, 25.0], "labels": ["calm", "normal", "stress"]}),
    "curve": ("fred:T10Y3M", "bands", {"edges": [0.0], "labels": ["inverted", "normal"]}),
    "fed": ("fred:DFF", "trend", {"periods": 63, "threshold": 0.10, "labels": ["cutting", "hold", "hiking"]}),
    "hy": ("fred:BAMLH0A0HYM2", "bands", {"edges": [3.5, 5.0], "labels": ["tight", "mid", "wide"]}),
    "usrec": ("fred:USREC", "bands", {"edges": [0.5], "labels": ["expansion", "recession"]}),
    "boi_fed": ("derived:BOI_FED_DIFF", "bands", {"edges": [0.0], "labels": ["boi_below_fed", "boi_above_fed"]}),
    "realized_vol": (None, "volatility", {"window": 20, "quantiles": [0.33, 0.67], "labels": ["low_vol", "mid_vol", "high_vol"]}),
    "markov": (None, "markov", {}),
}


def preset(df: DataFrame, name: str) -> DataFrame:
    """The regimes of ``df(series_id, ts, value)`` by a preset; ``df`` holds the
    preset's series, or the analysed one where the preset names none."""
    _, kind, params = PRESETS[name]
    return {"bands": bands, "trend": trend, "volatility": volatility, "markov": markov}[kind](df, **params)


def ladder(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge above ``x``; the last label beyond all."""
    out = None
    for e, label in zip(edges, labels):
        out = F.when(x < e, label) if out is None else out.when(x < e, label)
    return out.otherwise(labels[-1])


def bands(df: DataFrame, edges: list[float], labels: list[str]) -> DataFrame:
    return df.where("value IS NOT NULL").select("series_id", "ts", ladder(F.col("value"), edges, labels).alias("regime"))


def trend(df: DataFrame, periods: int, threshold: float, labels=("falling", "flat", "rising")) -> DataFrame:
    """By the change over ``periods`` rows; the first rows, with no change yet, get the middle label."""
    move = F.col("value") - F.lag("value", periods).over(by_series())
    return df.select("series_id", "ts", F.when(move < -threshold, labels[0]).when(move > threshold, labels[2]).otherwise(labels[1]).alias("regime"))


def volatility(df: DataFrame, window: int, quantiles=(0.33, 0.67), labels=("low", "mid", "high")) -> DataFrame:
    """By the rolling deviation against its own quantiles (the nearest row's value, not an interpolation)."""
    r = by_series().rowsBetween(-(window - 1), 0)
    sd = df.withColumn("sd", F.when(F.count("value").over(r) >= max(3, window // 2), F.stddev_samp("value").over(r))).where("sd IS NOT NULL")
    ranked = sd.withColumns({
        "k": F.row_number().over(Window.partitionBy("series_id").orderBy("sd", "ts")) - 1,
        "n": F.count("*").over(Window.partitionBy("series_id")),
    })
    edge = [F.max(F.when(F.col("k") == F.floor((F.col("n") - 1) * q + 0.5), F.col("sd"))).alias(f"q{i}") for i, q in enumerate(quantiles)]
    e = ranked.groupBy("series_id").agg(*edge)
    return ranked.join(e, "series_id").select("series_id", "ts", F.when(F.col("sd") < F.col("q0"), labels[0]).when(
        F.col("sd") < F.col("q1"), labels[1]).otherwise(labels[2]).alias("regime"))


def user_windows(df: DataFrame, windows: DataFrame, default: str = "other") -> DataFrame:
    """``windows(idx, start, end, label)`` with both ends included; a later window wins.

    The windows' ends cut time into stretches, each with the label of the last
    window over it; that is a join of the windows with their own ends. A series
    meets one stretch by an as-of look back: a union and one frame, no range
    join over data."""
    step = F.expr("interval 1 microsecond")
    cuts = windows.select(F.col("start").alias("at")).union(windows.select((F.col("end") + step).alias("at"))).distinct()
    over = (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end"))
    stretches = cuts.join(windows, over, "left").groupBy("at").agg(F.coalesce(F.max_by("label", "idx"), F.lit(default)).alias("regime"))
    rows = df.select("series_id", "ts").withColumns({"side": F.lit(1), "regime": F.lit(None).cast("string")})
    marks = df.select("series_id").distinct().join(F.broadcast(stretches)).select("series_id", F.col("at").alias("ts"), F.lit(0).alias("side"), "regime")
    w = by_series().orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("regime", F.coalesce(F.last("regime", ignorenulls=True).over(w), F.lit(default)))
    return found.where("side = 1").select("series_id", "ts", "regime")


def markov(df: DataFrame, least: int = 100) -> DataFrame:
    """The state of two with its own mean and variance, ``calm`` or ``wild``, smoothed."""
    def run(g):  # noqa: ANN001, ANN202
        g = g.sort_values("ts")
        if len(g) < least:
            return g.assign(regime=None)[["series_id", "ts", "regime"]]
        p = kernels.markov_two_states(g["value"].to_numpy("float64"))
        return g.assign(regime=["wild" if x > 0.5 else "calm" for x in p])[["series_id", "ts", "regime"]]

    return df.where("value IS NOT NULL").groupBy("series_id").applyInPandas(run, "series_id string, ts timestamp_ntz, regime string")
