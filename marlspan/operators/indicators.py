"""Technical indicators on bars. Fixed windows are SQL window frames; recursive
averages run per ticker in pandas, as a recursion has no frame."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions.stats import full, ratio


def _frame(n: int):
    return Window.partitionBy("ticker").orderBy("ts").rowsBetween(-(n - 1), 0)


def sma(df: DataFrame, n: int) -> DataFrame:
    w = _frame(n)
    return df.withColumn(f"sma{n}", full(F.avg("close").over(w), F.count("close").over(w), n))


def bollinger(df: DataFrame, n: int) -> DataFrame:
    w = _frame(n)
    mid, sd, k = F.avg("close").over(w), F.stddev_samp("close").over(w), F.count("close").over(w)
    return df.withColumns({"bb_mid": full(mid, k, n), "bb_up": full(mid + 2 * sd, k, n), "bb_low": full(mid - 2 * sd, k, n)})


def vwap(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap", ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def _recursive(df: DataFrame, columns: dict[str, Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    schema = ", ".join([*[f"{n} {t}" for n, t in df.dtypes], *[f"{c} double" for c in columns]])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts").reset_index(drop=True)
        return g.assign(**{c: f(g) for c, f in columns.items()})

    return df.groupBy("ticker").applyInPandas(run, schema)


def _ewm(x: pd.Series, alpha: float) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False).mean()


def ema(df: DataFrame, n: int) -> DataFrame:
    return _recursive(df, {f"ema{n}": lambda g: _ewm(g["close"], 2 / (n + 1))})


def _rsi(close: pd.Series, n: int) -> pd.Series:
    move = close.diff().fillna(0.0)
    up, down = _ewm(move.clip(lower=0), 1 / n), _ewm((-move).clip(lower=0), 1 / n)
    out = 100 * up / (up + down)
    return out.where(up + down > 0)


def rsi(df: DataFrame, n: int) -> DataFrame:
    return _recursive(df, {f"rsi{n}": lambda g: _rsi(g["close"], n)})


def macd(df: DataFrame) -> DataFrame:
    def line(g):
        return _ewm(g["close"], 2 / 13) - _ewm(g["close"], 2 / 27)

    return _recursive(df, {"macd": line, "macd_signal": lambda g: _ewm(line(g), 2 / 10), "macd_hist": lambda g: line(g) - _ewm(line(g), 2 / 10)})


def atr(df: DataFrame, n: int) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("ts"))
    spread = df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return _recursive(spread, {f"atr{n}": lambda g: _ewm(g["true_range"], 1 / n)}).drop("true_range")


KINDS: dict[str, tuple[Callable, int | None]] = {
    "sma": (sma, 20), "ema": (ema, 20), "rsi": (rsi, 14), "bb": (bollinger, 20), "atr": (atr, 14), "macd": (macd, None), "vwap": (vwap, None),
}


def apply(df: DataFrame, names: list[str]) -> DataFrame:
    """Indicators by name with an optional length: ``sma50``, ``rsi``; unknown names are passed over."""
    for name in names:
        m = re.fullmatch(r"([a-z]+)(\d*)", name.lower())
        if m and m[1] in KINDS:
            f, default = KINDS[m[1]]
            df = f(df) if default is None else f(df, int(m[2] or default))
    return df


def adjusted(df: DataFrame) -> DataFrame:
    """Prices scaled by adj_close / close."""
    k = ratio(F.col("adj_close"), F.col("close"))
    return df.withColumns({c: F.col(c) * k for c in ("open", "high", "low")}).withColumn("close", F.col("adj_close"))


def own_beta(df: DataFrame, market: str, min_weeks: int = 30) -> DataFrame:
    """Beta to ``market`` on weekly log returns, and its Blume adjustment."""
    weekly = df.groupBy("ticker", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    w = Window.partitionBy("ticker").orderBy("ts")
    r = weekly.withColumn("r", F.ln(F.col("close") / F.lag("close").over(w))).where("r IS NOT NULL")
    m = r.where(F.col("ticker") == market).select("ts", F.col("r").alias("m"))
    beta = r.join(m, "ts").groupBy("ticker").agg(
        ratio(F.covar_samp("r", "m"), F.var_samp("m")).alias("beta"), F.count("*").alias("n")).where(F.col("n") >= min_weeks)
    return beta.withColumn("blume", 0.67 * F.col("beta") + 0.33)


def range_52w(df: DataFrame, rows: int = 252) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts")))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= rows).groupBy("ticker").agg(F.max("high").alias("high_52w"), F.min("low").alias("low_52w"))


def last_k(df: DataFrame, k: int) -> DataFrame:
    """The last ``k`` closes of each ticker, oldest first."""
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts")))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= k).groupBy("ticker").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ts", "close"))), lambda x: x["close"]).alias("closes"))
