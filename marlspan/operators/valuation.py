"""Valuation: discounted cash flows over exploded years, grids over exploded
scenarios, multiples, blends. A grid is just more rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions import kernels
from marlspan.functions.stats import ratio


def fcff(df: DataFrame, keys: list[str], years: int = 10) -> DataFrame:
    """Equity value per share of ``(revenue, growth, terminal_growth, margin,
    tax, reinvestment, wacc, net_debt, shares)`` rows: growth fades linearly
    towards the terminal rate, cash flows are discounted mid-year, the terminal
    value by Gordon over a spread of half a percent at least."""
    growth = lambda t: F.col("growth") + (F.col("terminal_growth") - F.col("growth")) * (t - 1) / F.lit(float(years))
    told = lambda sum_ln: F.col("revenue") * F.exp(sum_ln) * F.col("margin") * (1 - F.col("tax")) * (1 - F.col("reinvestment"))

    def year(s: Column, t: Column) -> Column:
        logs = s["logs"] + F.ln(1 + F.greatest(growth(t), F.lit(-0.99)))
        cash = told(logs)
        return F.struct(logs.alias("logs"), (s["pv"] + cash / F.pow(1 + F.col("wacc"), t - 0.5)).alias("pv"), cash.alias("cash"))

    zero = F.struct(F.lit(0.0).alias("logs"), F.lit(0.0).alias("pv"), F.lit(None).cast("double").alias("cash"))
    y = df.select("*", F.inline(F.array(F.struct(F.aggregate(F.sequence(F.lit(1), F.lit(years)), zero, year).alias("cash_flows")))))
    spread = F.greatest(F.col("wacc") - F.col("terminal_growth"), F.lit(0.005))
    last = F.col("cash_flows.cash") * (1 + F.col("terminal_growth")) / spread / F.pow(1 + F.col("wacc"), F.lit(years))
    out = y.select(*keys, F.col("cash_flows.pv").alias("pv"), last.alias("terminal"), "net_debt", "shares")
    return out.select(*keys, "pv", "terminal", ratio(F.col("pv") + F.col("terminal") - F.col("net_debt"), F.col("shares")).alias("value"))


def grid(df: DataFrame, changes: dict[str, list[float]]) -> DataFrame:
    """Every combination of additions to the named inputs; columns ``d_<input>`` tell which."""
    for column, steps in changes.items():
        df = df.withColumn(f"d_{column}", F.explode(F.array(*[F.lit(float(s)) for s in steps]))).withColumn(column, F.col(column) + F.col(f"d_{column}"))
    return df


def centred_grid(df: DataFrame, steps: dict[str, float], n: int = 5, below: tuple[str, str] | None = None) -> DataFrame:
    """``n`` values around each named input, its step apart and of four digits;
    every combination is a row, columns ``at_<input>`` tell which. With ``below``
    ``(a, b)`` values of ``a`` go that aren't under the least of ``b``."""
    for column, step in steps.items():
        df = df.withColumn(f"all_{column}", F.array(*[F.round(F.col(column) + (i - n // 2) * step, 4) for i in range(n)]))
    if below:
        a, b = (f"all_{c}" for c in below)
        df = df.withColumn(a, F.filter(a, lambda x: x < F.array_min(F.col(b))))
    for column in steps:
        df = df.withColumn(f"at_{column}", F.explode(f"all_{column}")).withColumn(column, F.col(f"at_{column}"))
    return df.drop(*[f"all_{c}" for c in steps])


def implied_growth(df: DataFrame, years: int = 10) -> DataFrame:
    """Growth at which the cash-flow value meets ``price``, between -50 % and
    150 %; null where it can't. Adds ``implied_growth``."""
    columns = ["revenue", "terminal_growth", "margin", "tax", "reinvestment", "wacc", "net_debt", "shares", "price"]

    @F.pandas_udf("double")
    def solve(x):  # noqa: ANN001, ANN202
        def gap(g):  # noqa: ANN001, ANN202
            level, pv, cash = x["revenue"].to_numpy(), 0.0, 0.0
            tg, wacc = x["terminal_growth"].to_numpy(), x["wacc"].to_numpy()
            keep = (x["margin"] * (1 - x["tax"]) * (1 - x["reinvestment"])).to_numpy()
            for t in range(1, years + 1):
                level = level * (1 + np.maximum(g + (tg - g) * (t - 1) / years, -0.99))
                cash = level * keep
                pv = pv + cash / (1 + wacc) ** (t - 0.5)
            tail = cash * (1 + tg) / np.maximum(wacc - tg, 0.005) / (1 + wacc) ** years
            return ((pv + tail - x["net_debt"]) / x["shares"] - x["price"]).to_numpy()

        return pd.Series(kernels.bisect(gap, np.full(len(x), -0.5), np.full(len(x), 1.5)))

    found = solve(F.struct(*columns))
    return df.withColumn("implied_growth", found).withColumn("implied_growth", F.when(~F.isnan("implied_growth"), F.col("implied_growth")))


def quartiles(value: Column) -> list[Column]:
    """p25, median and p75 of positive finite values, from two on."""
    ok = F.when((value > 0) & (value < float("inf")), value)
    q = F.percentile(ok, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.when(F.count(ok) >= 2, q[i]).alias(n) for i, n in enumerate(("p25", "median", "p75"))]


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the cumulated weight reaches half, over what is there."""
    x = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    w = Window.partitionBy(*keys).orderBy(value, weight)
    x = x.withColumns({"__run": F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum(weight).over(Window.partitionBy(*keys))})
    return x.where(F.col("__run") >= 0.5 * F.col("__all") - 1e-12).groupBy(*keys).agg(F.min(value).alias("blended"))


def graham(eps: Column, bvps: Column) -> Column:
    return F.when((eps > 0) & (bvps > 0), F.sqrt(22.5 * eps * bvps))


def fade(first: Column, last: Column, i: Column, n: int) -> Column:
    return first + (last - first) * i / F.lit(float(n))


METRICS = ["ev_ebitda", "ev_sales", "pe", "ps", "pb", "peg"]


def company_figures(df: DataFrame) -> DataFrame:
    """What multiples are applied to, from statement fields, ``shares``,
    ``price`` and ``growth``: adds ``f_ebitda, f_eps, f_debt, f_minority``."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    debt = z("short_term_debt") + z("long_term_debt") + z("long_term_lease_liabilities") - z("cash_and_equivalents") - z("short_term_investments")
    return df.withColumns({
        "f_ebitda": F.col("operating_income") + z("depreciation_amortization"), "f_eps": F.coalesce("eps_diluted", ratio(F.col("net_income"), F.col("shares"))),
        "f_debt": debt, "f_minority": z("minority_interest")})


def multiples(df: DataFrame) -> DataFrame:
    """The six multiples of :func:`company_figures` rows, null where price or
    shares are missing, a denominator is zero, or earnings, book or growth are
    not positive."""
    known = (F.coalesce("price", F.lit(0.0)) != 0) & (F.coalesce("shares", F.lit(0.0)) != 0)
    cap = F.when(known, F.col("price") * F.col("shares"))
    ev = cap + F.col("f_debt") + F.col("f_minority")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    pe = F.when(known, ratio(F.col("price"), positive("f_eps")))
    out = {"ev_ebitda": ratio(ev, F.col("f_ebitda")), "ev_sales": ratio(ev, F.col("revenue")), "pe": pe, "ps": ratio(cap, F.col("revenue")),
           "pb": ratio(cap, positive("total_equity")), "peg": ratio(pe, positive("growth") * 100)}
    return df.withColumns(out)


def implied_price(metric: str, multiple: Column) -> Column:
    """The price per share at which a company has a multiple."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    shares = some("shares")
    equity = lambda ev: ratio(ev - F.col("f_debt") - F.col("f_minority"), shares)
    return {
        "ev_ebitda": equity(multiple * positive("f_ebitda")), "ev_sales": equity(multiple * some("revenue")), "pe": F.when(shares.isNotNull(), multiple * positive("f_eps")),
        "ps": ratio(multiple * some("revenue"), shares), "pb": ratio(multiple * positive("total_equity"), shares),
        "peg": F.when(shares.isNotNull(), multiple * positive("growth") * 100 * positive("f_eps")),
    }[metric]


def multiple_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each multiple within ``keys`` as ``<keys>, metric, p25, median, p75, n``, of two positive values on."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])))
    good = F.when((F.col("x") > 0) & (F.col("x") < float("inf")), F.col("x"))
    return long.groupBy(*keys, "metric").agg(*quartiles(F.col("x")), F.count(good).alias("n")).where("n >= 2")


def blended_stats(peers: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of peers and of a company's own history, averaged where both have a metric."""
    q = ["p25", "median", "p75"]
    both = peers.select(*keys, "metric", F.struct(*q).alias("a")).join(history.select(*keys, "metric", F.struct(*q).alias("b")), [*keys, "metric"], "full")
    return both.select(*keys, "metric", *[F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(c) for c in q])


def relative_value(figures: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Low, base and high value per share: the medians over the metrics of the
    prices that the quartiles imply, over metrics whose median implies one."""
    x = figures.join(stats, keys)
    by_metric = lambda q: F.coalesce(*[F.when(F.col("metric") == m, implied_price(m, F.col(q))) for m in METRICS])
    x = x.withColumns({"low": by_metric("p25"), "base": by_metric("median"), "high": by_metric("p75")}).where("base IS NOT NULL")
    return x.groupBy(*keys).agg(F.median("low").alias("low"), F.median("base").alias("base"), F.median("high").alias("high"), F.count("*").alias("n_metrics"))


def football_field(rows: DataFrame, current: Column) -> DataFrame:
    """``rows(ticker, method, low, base, high)`` in order of the base value, ends
    that are missing taken from the base, with the upside to ``current``."""
    filled = rows.where("base IS NOT NULL").withColumns({"low": F.coalesce("low", "base"), "high": F.coalesce("high", "base")})
    x = filled.withColumns({"low": F.least("low", "high"), "high": F.greatest("low", "high"), "upside": ratio(F.col("base"), current) - 1})
    return x.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("base"), "method")))


def implied_margin(df: DataFrame, years: int = 10) -> DataFrame:
    """Margin at which the cash-flow value meets ``price``. The value is linear in
    the margin, so two values tell it; null outside -50 % to 80 %. Needs a
    ``ticker`` per row."""
    at = lambda m: fcff(df.withColumn("margin", F.lit(m)), ["ticker"], years).select("ticker", F.col("value").alias(f"v{int(m)}"))
    both = df.join(at(0.0), "ticker").join(at(1.0), "ticker")
    m = ratio(F.col("price") - F.col("v0"), F.col("v1") - F.col("v0"))
    return both.withColumn("implied_margin", F.when(m.between(-0.5, 0.8), m)).drop("v0", "v1")


class Models:
    """Valuation models of users: functions that add ``value`` to inputs, under
    an id. A model that can't be planned is reported and left out; two models
    can't share an id."""

    def __init__(self) -> None:
        self.models: dict[str, object] = {}
        self.errors: dict[str, str] = {}

    def add(self, model_id: str, run) -> None:  # noqa: ANN001
        if model_id in self.models:
            raise ValueError(f"there is a model {model_id!r} already")
        self.models[model_id] = run

    def values(self, inputs: DataFrame, keys: list[str]) -> DataFrame:
        """``<keys>, model, value`` of all models."""
        out = None
        for name, run in self.models.items():
            try:
                part = run(inputs).select(*keys, F.lit(name).alias("model"), F.col("value").cast("double").alias("value"))
            except Exception as e:  # noqa: BLE001  whatever a user's model raises concerns that model alone
                self.errors[name] = str(e)[:200]
                continue
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError(f"no model could be planned: {self.errors}")
        return out
