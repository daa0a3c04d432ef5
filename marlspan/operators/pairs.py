"""Correlation, lead-lag, regression and universe statistics. Input is a long
table of pairs, ``(pair_id, ts, a, b)``, or of series; every statistic is one
aggregation or window over all pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions import kernels
from marlspan.functions.stats import fisher_bound, full, ratio, safe_corr

from .series import common_dates


def _w(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts")


def average_ranks(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    by = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, column))
    return df.withColumn(name, F.rank().over(by.orderBy(column)) + (ties - 1) / 2)


def correlation(df: DataFrame, min_n: int = 10) -> DataFrame:
    """Per pair: Pearson, Spearman, n, lag-1 autocorrelations, effective n, intervals and r²."""
    ok = df.where(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b"))
    ranked = average_ranks(average_ranks(ok, "a", ["pair_id"], "ra"), "b", ["pair_id"], "rb")
    whole = Window.partitionBy("pair_id")
    centred = ranked.withColumns({"xa": F.col("a") - F.avg("a").over(whole), "xb": F.col("b") - F.avg("b").over(whole)})
    lagged = centred.withColumns({"la": F.lag("xa").over(_w("pair_id")), "lb": F.lag("xb").over(_w("pair_id"))})
    s = lagged.groupBy("pair_id").agg(
        safe_corr(F.col("a"), F.col("b")).alias("pearson"), safe_corr(F.col("ra"), F.col("rb")).alias("spearman"), F.count("*").alias("n"),
        ratio(F.sum(F.col("xa") * F.col("la")), F.sum(F.col("xa") * F.col("xa"))).alias("auto_a"),
        ratio(F.sum(F.col("xb") * F.col("lb")), F.sum(F.col("xb") * F.col("xb"))).alias("auto_b"),
    ).where(F.col("n") >= min_n)
    p = F.col("auto_a") * F.col("auto_b")
    s = s.withColumn("n_eff", F.greatest(F.lit(3.0), F.least(F.col("n").cast("double"), F.col("n") * ratio(1 - p, 1 + p))))
    return s.withColumns({
        "ci_low": fisher_bound(F.col("pearson"), F.col("n"), -1), "ci_high": fisher_bound(F.col("pearson"), F.col("n"), 1),
        "r2": F.col("pearson") * F.col("pearson"),
    })


def with_p_values(df: DataFrame) -> DataFrame:
    """Two-sided p of the t statistic of ``pearson`` with ``n``, and with ``n_eff``."""
    @F.pandas_udf("double")
    def p(r, n):  # noqa: ANN001, ANN202
        return kernels.correlation_p(r, n)

    return df.withColumns({"p_value": p("pearson", F.col("n").cast("double")), "p_eff": p("pearson", "n_eff")})


def lead_lag(df: DataFrame, max_lag: int) -> DataFrame:
    """Correlation at lags -L..L, the sample size and the band 2/√n; ``best`` marks
    the largest |r|, the first of equals. A positive lag pairs a(t) with b(t - lag)."""
    rows = df.withColumn("k", F.row_number().over(_w("pair_id")))
    left = rows.select("pair_id", "k", "a").withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    left = left.withColumn("kb", F.col("k") - F.col("lag"))
    right = rows.select("pair_id", F.col("k").alias("kb"), "b")
    s = left.join(right, ["pair_id", "kb"]).groupBy("pair_id", "lag").agg(safe_corr(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.abs(F.round("r", 12)).desc_nulls_last(), "lag"))
    return s.withColumns({"band": 2 / F.sqrt("n"), "best": place == 1})


def rolling_correlation(df: DataFrame, window: int) -> DataFrame:
    """Rolling Pearson with its Fisher band; leading windows need 80 % of the rows."""
    least = max(3, round(0.8 * window))
    r = _w("pair_id").rowsBetween(-(window - 1), 0)
    n = F.count("*").over(r)
    corr = F.when(n >= least, safe_corr(F.col("a"), F.col("b"), r))
    out = df.withColumns({"r": corr, "n": n})
    return out.withColumns({"lo": fisher_bound(F.col("r"), F.col("n"), -1), "hi": fisher_bound(F.col("r"), F.col("n"), 1)})


def regression(df: DataFrame) -> DataFrame:
    """OLS of b on a: slope, intercept, r², Durbin-Watson and the spurious-regression flag."""
    whole = Window.partitionBy("pair_id")
    fit = df.withColumns({"beta": F.regr_slope("b", "a").over(whole), "alpha": F.regr_intercept("b", "a").over(whole), "r2": F.regr_r2("b", "a").over(whole)})
    res = fit.withColumn("e", F.col("b") - F.col("alpha") - F.col("beta") * F.col("a"))
    res = res.withColumn("de", F.col("e") - F.lag("e").over(_w("pair_id")))
    return res.groupBy("pair_id").agg(
        F.first("beta").alias("beta"), F.first("alpha").alias("alpha"), F.first("r2").alias("r2"), F.count("*").alias("n"),
        ratio(F.sum(F.col("de") * F.col("de")), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"),
    ).withColumn("spurious", F.col("r2") > F.col("durbin_watson"))


def rolling_beta(df: DataFrame, window: int) -> DataFrame:
    r = _w("pair_id").rowsBetween(-(window - 1), 0)
    n, least = F.count("*").over(r), max(5, int(0.8 * window))
    return df.withColumns({c: F.when(n >= least, f("b", "a").over(r)) for c, f in
                           (("beta", F.regr_slope), ("alpha", F.regr_intercept), ("r2", F.regr_r2))})


def spread_z(df: DataFrame, window: int) -> DataFrame:
    """Rolling z of the residual of b on a."""
    whole = Window.partitionBy("pair_id")
    e = df.withColumn("spread", F.col("b") - F.regr_intercept("b", "a").over(whole) - F.regr_slope("b", "a").over(whole) * F.col("a"))
    size = max(10, window)
    r = _w("pair_id").rowsBetween(-(size - 1), 0)
    z = ratio(F.col("spread") - F.avg("spread").over(r), F.stddev_samp("spread").over(r))
    return e.withColumn("z", F.when(F.count("*").over(r) >= max(5, size // 2), z))


def half_life(df: DataFrame) -> DataFrame:
    """AR(1) half-life of the residual of b on a."""
    whole = Window.partitionBy("pair_id")
    e = df.withColumn("e", F.col("b") - F.regr_intercept("b", "a").over(whole) - F.regr_slope("b", "a").over(whole) * F.col("a"))
    e = e.withColumn("before", F.lag("e").over(_w("pair_id"))).where("before IS NOT NULL")
    s = e.groupBy("pair_id").agg(F.regr_slope(F.col("e") - F.col("before"), F.col("before")).alias("k"))
    return s.withColumn("half_life", F.when((F.col("k") < 0) & (F.col("k") > -1), -F.ln(F.lit(2.0)) / F.ln(1 + F.col("k"))))


def stability(rolled: DataFrame) -> DataFrame:
    """Mean and spread of a rolling correlation, population and sample."""
    return rolled.groupBy("pair_id").agg(F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("sd_pop"), F.stddev_samp("r").alias("sd_samp"))


def conditional_correlation(df: DataFrame, min_n: int = 20) -> DataFrame:
    """Pearson, Spearman and the interval by the effective n of each pair within
    each regime; nulls in regimes of fewer than ``min_n`` rows. ``df`` carries
    ``regime``."""
    keyed = df.withColumn("pair_id", F.to_json(F.struct("pair_id", "regime")))
    s = correlation(keyed, 1)
    key = F.from_json("pair_id", "pair_id string, regime string")
    known = F.col("n") >= min_n
    effective = F.when(F.col("n_eff").isNotNull(), F.col("n_eff")).otherwise(F.col("n"))
    out = {"r": F.col("pearson"), "spearman": F.col("spearman"), "n_eff": F.col("n_eff"), "lo": fisher_bound(F.col("pearson"), effective, -1), "hi": fisher_bound(F.col("pearson"), effective, 1)}
    return s.select(key["pair_id"].alias("pair_id"), key["regime"].alias("regime"), "n", *[F.when(known, c).alias(k) for k, c in out.items()])


def matrix(series: DataFrame, min_overlap: int = 10) -> DataFrame:
    """Pairwise-complete correlations of a universe in long form, both halves and the diagonal."""
    left = series.select(F.col("series_id").alias("a_id"), "ts", F.col("value").alias("a"))
    right = series.select(F.col("series_id").alias("b_id"), "ts", F.col("value").alias("b"))
    half = left.join(right, "ts").where("a_id < b_id").groupBy("a_id", "b_id").agg(safe_corr(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n"))
    half = half.withColumn("r", F.when(F.col("n") >= min_overlap, F.col("r")))
    other = half.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "r", "n")
    diagonal = series.groupBy(F.col("series_id").alias("a_id"), F.col("series_id").alias("b_id")).agg(F.lit(1.0).alias("r"), F.count("*").alias("n"))
    return half.unionByName(other).unionByName(diagonal)


def _per_pair(df: DataFrame, f, schema: str) -> DataFrame:
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, g):  # noqa: ANN001, ANN202
        g = g.sort_values("ts")
        found = f(g["a"].to_numpy("float64"), g["b"].to_numpy("float64"))
        return pd.DataFrame([(key[0], *found)], columns=["pair_id", *names])

    return df.groupBy("pair_id").applyInPandas(run, f"pair_id string, {schema}")


def rolling_spearman(df: DataFrame, window: int) -> DataFrame:
    """Spearman over the last ``window`` rows, ranked inside each window; one
    call a pair, which ranks many windows at once."""
    least = max(3, round(0.8 * window))

    def run(g):  # noqa: ANN001, ANN202
        g = g.sort_values("ts")
        return g.assign(rho=kernels.rolling_spearman(g["a"].to_numpy("float64"), g["b"].to_numpy("float64"), window, least))[["pair_id", "ts", "rho"]]

    found = df.select("pair_id", "ts", "a", "b").groupBy("pair_id").applyInPandas(run, "pair_id string, ts timestamp_ntz, rho double")
    return found.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


def ewma_correlation(df: DataFrame, window: int) -> DataFrame:
    """Exponentially weighted correlation, half-life a third of the window."""
    def run(g):  # noqa: ANN001, ANN202
        g = g.sort_values("ts")
        return g.assign(r=g["a"].ewm(halflife=max(2.0, window / 3), min_periods=3).corr(g["b"]).to_numpy())[["pair_id", "ts", "r"]]

    return df.groupBy("pair_id").applyInPandas(run, "pair_id string, ts timestamp_ntz, r double").withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def hac(df: DataFrame) -> DataFrame:
    """OLS of b on a with Newey-West errors."""
    return _per_pair(df, kernels.ols_hac, "beta double, alpha double, t_hac double, p_hac double")


def unit_roots(df: DataFrame) -> DataFrame:
    """ADF and KPSS statistics of b and the verdict from both."""
    return _per_pair(df, lambda a, b: kernels.adf_kpss(b), "adf double, adf_p double, kpss double, verdict string")


def cointegration(df: DataFrame) -> DataFrame:
    """Engle-Granger: hedge ratio, ADF statistic and p of the spread."""
    return _per_pair(df, kernels.engle_granger, "hedge double, adf double, p_value double")


def johansen(df: DataFrame) -> DataFrame:
    """Trace statistics of two series and the rank at 5 %."""
    return _per_pair(df, kernels.johansen, "trace0 double, trace1 double, rank int")


def granger(df: DataFrame, max_lag: int = 5) -> DataFrame:
    """F tests in both directions, the lag chosen by AIC."""
    return _per_pair(df, lambda a, b: (*kernels.granger(a, b, max_lag), *kernels.granger(b, a, max_lag)),
                     "lag_ab int, f_ab double, p_ab double, lag_ba int, f_ba double, p_ba double")


def universe_structure(series: DataFrame) -> DataFrame:
    """Ledoit-Wolf shrinkage, first component's share, and average-linkage
    clusters with leaf order, over the dates that all series have. One row per
    series. The products of all pairs are summed up in SQL, so that k by k
    numbers, whatever the number of dates, meet in one call."""
    import pandas as pd

    full = common_dates(series)
    centred = full.withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy("series_id")))
    left = centred.select("ts", F.col("series_id").alias("a"), F.col("x").alias("xa"))
    right = centred.select("ts", F.col("series_id").alias("b"), F.col("x").alias("xb"))
    product = F.col("xa") * F.col("xb")
    sums = left.join(right, "ts").groupBy("a", "b").agg(F.avg(product).alias("s"), F.avg(product * product).alias("q"), F.count("*").alias("n"))

    def run(g):  # noqa: ANN001, ANN202
        s, q = (g.pivot(index="a", columns="b", values=c).sort_index().sort_index(axis=1) for c in ("s", "q"))
        shrink, share, cluster, order = kernels.universe(s.to_numpy("float64"), q.to_numpy("float64"), int(g["n"].iloc[0]))
        return pd.DataFrame({"series_id": s.index, "shrinkage": shrink, "pc1_share": share, "cluster": cluster, "leaf": order})

    return sums.groupBy(F.lit(1).alias("universe")).applyInPandas(run, "series_id string, shrinkage double, pc1_share double, cluster int, leaf int")


def discovery(df: DataFrame, levels: DataFrame, max_lag: int, window: int, days: int = 730, points: int = 40) -> DataFrame:
    """One row per pair: correlations with p and effective n, the best lead or
    lag, ``stability`` (mean of the rolling correlation over its deviation, the
    last ``days`` days of it, three values at least), the p of a
    cointegration test of the levels, and ``spark``, the rolling correlation at
    ``points`` evenly spaced rows."""
    base = with_p_values(correlation(df)).select("pair_id", "pearson", F.abs("pearson").alias("strength"), "spearman", F.col("p_value").alias("p"), "n", "n_eff")
    best = lead_lag(df, max_lag).where("best").select("pair_id", F.col("lag").alias("best_lag"), F.col("r").alias("best_corr"))
    whole = Window.partitionBy("pair_id")
    rolled = rolling_correlation(df, window).select("pair_id", "ts", "r").withColumn("end", F.max("ts").over(whole)).where("r IS NOT NULL")
    recent = F.when(F.col("ts") >= F.col("end") - F.make_dt_interval(F.lit(days)), F.col("r"))
    sd = F.stddev_samp(recent)
    stable = F.when((F.count(recent) >= 3) & (sd > 0), F.round(F.avg(recent) / sd, 3))
    numbered = rolled.withColumns({"k": F.row_number().over(_w("pair_id")) - 1, "m": F.count("*").over(whole)})
    # row k is drawn if it is the nearest to one of the evenly spaced places
    place = F.bround(F.bround(F.col("k") * (points - 1) / (F.col("m") - 1)) * (F.col("m") - 1) / F.lit(points - 1))
    drawn = F.when((F.col("m") <= points) | (place == F.col("k")), F.struct("k", F.round("r", 3).alias("r")))
    lines = numbered.groupBy("pair_id").agg(stable.alias("stability"), F.transform(F.sort_array(F.collect_list(drawn)), lambda x: x["r"]).alias("spark"))
    tested = cointegration(levels).select("pair_id", F.col("p_value").alias("coint_p"))
    return base.join(best, "pair_id", "left").join(lines, "pair_id", "left").join(tested, "pair_id", "left")


def full_windows(df: DataFrame, column: str, n: int) -> DataFrame:
    r = _w("pair_id").rowsBetween(-(n - 1), 0)
    return df.withColumn(column, full(F.avg(column).over(r), F.count(column).over(r), n))
