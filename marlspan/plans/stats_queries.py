"""Queries of pair, universe, regime and macro statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspan.operators import macro as M
from marlspan.operators import pairs as P
from marlspan.operators import regimes as R
from marlspan.operators import series as S
from marlspan.sources import views
from marlspan.sources.views import OBS, SHIP

from .registry import Register
from .series_queries import PAIRS, rounded

reg = Register()
query = reg.query

RET = f"""{PAIRS}, ret AS (SELECT pair_id, ts, ln(a / lag(a) OVER w) AS a, ln(b / lag(b) OVER w) AS b FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY ts)),
rp AS (SELECT * FROM ret WHERE a IS NOT NULL AND b IS NOT NULL)"""
FISHER = "tanh(atanh(greatest(-0.999999, least(0.999999, {r}))) {s} 1.959964 / sqrt(greatest({n} - 3, 1e-9)))"


def levels(spark, d):
    p = S.all_pairs(S.resample(views.observations(spark, d), "1mo"))
    return p.select(F.concat_ws("|", "a_id", "b_id").alias("pair_id"), "ts", "a", "b")


def returns(spark, d):
    """Monthly log returns of all pairs; the lag runs over the pair's shared dates."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id").orderBy("ts")
    x = levels(spark, d)
    return x.select("pair_id", "ts", *[F.ln(F.col(c) / F.lag(c).over(w)).alias(c) for c in ("a", "b")]).where("a IS NOT NULL AND b IS NOT NULL")


@query("rolling_pearson", f"""WITH {RET}, w AS (SELECT pair_id, ts, corr(a, b) OVER r AS r, count(*) OVER r AS n FROM rp WINDOW r AS (PARTITION BY pair_id ORDER BY ts ROWS 11 PRECEDING)),
m AS (SELECT pair_id, ts, n, CASE WHEN n >= 10 THEN r END AS r FROM w)
SELECT pair_id, ts, n, round(r, 6) AS r, round({FISHER.format(r='r', s='-', n='n')}, 6) AS lo, round({FISHER.format(r='r', s='+', n='n')}, 6) AS hi FROM m WHERE r IS NOT NULL""")
def _(spark, d):
    out = P.rolling_correlation(returns(spark, d), 12).where("r IS NOT NULL")
    return rounded(out.select("pair_id", "ts", "n", "r", "lo", "hi"), "r", "lo", "hi")


@query("pearson_spearman", f"""WITH {RET}, k AS (SELECT *, rank() OVER (PARTITION BY pair_id ORDER BY a) + (count(*) OVER (PARTITION BY pair_id, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY pair_id ORDER BY b) + (count(*) OVER (PARTITION BY pair_id, b) - 1) / 2.0 AS rb,
  a - avg(a) OVER (PARTITION BY pair_id) AS xa, b - avg(b) OVER (PARTITION BY pair_id) AS xb FROM rp),
l AS (SELECT *, lag(xa) OVER (PARTITION BY pair_id ORDER BY ts) AS la, lag(xb) OVER (PARTITION BY pair_id ORDER BY ts) AS lb FROM k),
s AS (SELECT pair_id, corr(a, b) AS r, corr(ra, rb) AS rho, count(*) AS n, sum(xa * la) / sum(xa * xa) AS pa, sum(xb * lb) / sum(xb * xb) AS pb FROM l GROUP BY 1)
SELECT pair_id, round(r, 6) AS pearson, round(rho, 6) AS spearman, n, round(pa, 6) AS auto_a, round(pb, 6) AS auto_b,
  round(greatest(3.0, least(n::DOUBLE, n * (1 - pa * pb) / (1 + pa * pb))), 6) AS n_eff,
  round({FISHER.format(r='r', s='-', n='n')}, 6) AS ci_low, round({FISHER.format(r='r', s='+', n='n')}, 6) AS ci_high, round(r * r, 6) AS r2 FROM s WHERE n >= 10""")
def _(spark, d):
    return rounded(P.correlation(returns(spark, d)), "pearson", "spearman", "auto_a", "auto_b", "n_eff", "ci_low", "ci_high", "r2")


@query("correlation_p")
def _(spark, d):
    return P.with_p_values(P.correlation(returns(spark, d))).select("pair_id", "pearson", "n", "p_value", "p_eff")


@query("lead_lag", f"""WITH {RET}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts) AS k FROM rp), g AS (SELECT unnest(range(-6, 7)) AS lag),
s AS (SELECT x.pair_id, lag, corr(x.a, y.b) AS r, count(*) AS n FROM k x, g, k y WHERE y.pair_id = x.pair_id AND y.k = x.k - lag GROUP BY 1, 2)
SELECT pair_id, lag::INT AS lag, round(r, 6) AS r, n, round(2 / sqrt(n), 6) AS band, row_number() OVER (PARTITION BY pair_id ORDER BY abs(round(r, 12)) DESC, lag) = 1 AS best FROM s""")
def _(spark, d):
    return rounded(P.lead_lag(returns(spark, d), 6), "r", "band")


@query("ols_durbin_watson", f"""WITH {RET}, f AS (SELECT *, regr_slope(b, a) OVER w AS beta, regr_intercept(b, a) OVER w AS alpha, regr_r2(b, a) OVER w AS r2 FROM rp WINDOW w AS (PARTITION BY pair_id)),
e AS (SELECT *, b - alpha - beta * a AS e FROM f), g AS (SELECT *, e - lag(e) OVER (PARTITION BY pair_id ORDER BY ts) AS de FROM e)
SELECT pair_id, round(any_value(beta), 6) AS beta, round(any_value(alpha), 6) AS alpha, round(any_value(r2), 6) AS r2, count(*) AS n, round(sum(de * de) / sum(e * e), 6) AS durbin_watson,
any_value(r2) > sum(de * de) / sum(e * e) AS spurious FROM g GROUP BY 1""")
def _(spark, d):
    return rounded(P.regression(returns(spark, d)), "beta", "alpha", "r2", "durbin_watson")


@query("rolling_beta", f"""WITH {RET}, w AS (SELECT pair_id, ts, regr_slope(b, a) OVER r AS beta, regr_intercept(b, a) OVER r AS alpha, regr_r2(b, a) OVER r AS r2, count(*) OVER r AS n
FROM rp WINDOW r AS (PARTITION BY pair_id ORDER BY ts ROWS 23 PRECEDING)) SELECT pair_id, ts, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM w WHERE n >= 19""")
def _(spark, d):
    return rounded(P.rolling_beta(returns(spark, d), 24).where("beta IS NOT NULL").select("pair_id", "ts", "beta", "alpha", "r2"), "beta", "alpha", "r2")


@query("spread_z", f"""WITH {PAIRS}, e AS (SELECT pair_id, ts, b - regr_intercept(b, a) OVER w - regr_slope(b, a) OVER w * a AS e FROM pairs WINDOW w AS (PARTITION BY pair_id)),
z AS (SELECT pair_id, ts, (e - avg(e) OVER r) / stddev_samp(e) OVER r AS z, count(*) OVER r AS n FROM e WINDOW r AS (PARTITION BY pair_id ORDER BY ts ROWS 19 PRECEDING))
SELECT pair_id, ts, round(z, 5) AS z FROM z WHERE n >= 10""")
def _(spark, d):
    return rounded(P.spread_z(levels(spark, d), 20).where("z IS NOT NULL").select("pair_id", "ts", "z"), "z", digits=5)


@query("half_life", f"""WITH {PAIRS}, e AS (SELECT pair_id, ts, b - regr_intercept(b, a) OVER w - regr_slope(b, a) OVER w * a AS e FROM pairs WINDOW w AS (PARTITION BY pair_id)),
l AS (SELECT *, lag(e) OVER (PARTITION BY pair_id ORDER BY ts) AS p FROM e), s AS (SELECT pair_id, regr_slope(e - p, p) AS k FROM l WHERE p IS NOT NULL GROUP BY 1)
SELECT pair_id, round(k, 6) AS k, round(CASE WHEN k < 0 AND k > -1 THEN -ln(2.0) / ln(1 + k) END, 5) AS half_life FROM s""")
def _(spark, d):
    return rounded(rounded(P.half_life(levels(spark, d)), "k"), "half_life", digits=5)


@query("stability", f"""WITH {RET}, w AS (SELECT pair_id, corr(a, b) OVER r AS r, count(*) OVER r AS n FROM rp WINDOW r AS (PARTITION BY pair_id ORDER BY ts ROWS 11 PRECEDING))
SELECT pair_id, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS sd_pop, round(stddev_samp(r), 6) AS sd_samp FROM w WHERE n >= 10 GROUP BY 1""")
def _(spark, d):
    return rounded(P.stability(P.rolling_correlation(returns(spark, d), 12)), "mean_r", "sd_pop", "sd_samp")


@query("conditional_corr", f"""WITH {RET}, g AS (SELECT *, CASE WHEN month(ts) <= 9 THEN 'h1' ELSE 'h2' END AS regime FROM rp),
c AS (SELECT *, a - avg(a) OVER p AS xa, b - avg(b) OVER p AS xb, rank() OVER (PARTITION BY pair_id, regime ORDER BY a) AS ka, rank() OVER (PARTITION BY pair_id, regime ORDER BY b) AS kb, count(*) OVER (PARTITION BY pair_id, regime, a) AS ta, count(*) OVER (PARTITION BY pair_id, regime, b) AS tb FROM g WINDOW p AS (PARTITION BY pair_id, regime)),
l AS (SELECT *, lag(xa) OVER w AS la, lag(xb) OVER w AS lb FROM c WINDOW w AS (PARTITION BY pair_id, regime ORDER BY ts)),
s AS (SELECT pair_id, regime, count(*) AS n, corr(a, b) AS r, corr(ka + (ta - 1) / 2, kb + (tb - 1) / 2) AS spearman, sum(xa * la) / sum(xa * xa) * (sum(xb * lb) / sum(xb * xb)) AS p FROM l GROUP BY 1, 2),
e AS (SELECT *, greatest(3, least(n, n * (1 - p) / (1 + p))) AS e FROM s)
SELECT pair_id, regime, n, CASE WHEN n >= 20 THEN round(r, 6) END AS r, CASE WHEN n >= 20 THEN round(spearman, 6) END AS spearman, CASE WHEN n >= 20 THEN round(e, 6) END AS n_eff, CASE WHEN n >= 20 THEN round({FISHER.format(r='r', s='-', n='e')}, 6) END AS lo, CASE WHEN n >= 20 THEN round({FISHER.format(r='r', s='+', n='e')}, 6) END AS hi FROM e""")
def _(spark, d):
    x = returns(spark, d).withColumn("regime", F.when(F.month("ts") <= 9, "h1").otherwise("h2"))
    return rounded(P.conditional_correlation(x), "r", "spearman", "n_eff", "lo", "hi")


@query("corr_matrix", f"""WITH {OBS}, mon AS (SELECT series_id, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS ts, arg_max(value, ts) AS value FROM obs GROUP BY 1, 2)
SELECT x.series_id AS a_id, y.series_id AS b_id, round(CASE WHEN x.series_id = y.series_id THEN 1.0 ELSE corr(x.value, y.value) END, 6) AS r, count(*) AS n FROM mon x JOIN mon y USING (ts) GROUP BY x.series_id, y.series_id""")
def _(spark, d):
    return rounded(P.matrix(S.resample(views.observations(spark, d), "1mo")), "r")


@query("discovery_top_k", f"""WITH {RET}, s AS (SELECT pair_id, corr(a, b) AS r, count(*) AS n FROM rp GROUP BY 1) SELECT pair_id, round(r, 6) AS r, n FROM s ORDER BY abs(s.r) DESC, pair_id LIMIT 5""")
def _(spark, d):
    s = P.correlation(returns(spark, d)).select("pair_id", F.col("pearson").alias("r"), "n")
    return rounded(s.orderBy(F.abs("r").desc(), "pair_id").limit(5), "r")


@query("discovery_row")
def _(spark, d):
    return P.discovery(returns(spark, d), levels(spark, d), 6, 12).orderBy(F.desc_nulls_last("strength"), "pair_id").limit(50)


@query("rolling_spearman", f"""WITH {RET}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts) AS k FROM rp), w AS (SELECT x.pair_id, x.ts, y.a, y.b FROM k x JOIN k y ON x.pair_id = y.pair_id AND y.k BETWEEN x.k - 11 AND x.k),
r AS (SELECT pair_id, ts, rank() OVER (PARTITION BY pair_id, ts ORDER BY a) + (count(*) OVER (PARTITION BY pair_id, ts, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY pair_id, ts ORDER BY b) + (count(*) OVER (PARTITION BY pair_id, ts, b) - 1) / 2.0 AS rb FROM w)
SELECT pair_id, ts, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= 10 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0""")
def _(spark, d):
    return rounded(P.rolling_spearman(returns(spark, d), 12).where("rho IS NOT NULL").select("pair_id", "ts", "rho"), "rho")


# All earlier rows weigh a half for every four rows of age.
@query("ewma_corr", f"""WITH {RET}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts) AS k FROM rp), w AS (SELECT x.pair_id, x.ts, y.a, y.b, pow(0.5, (x.k - y.k) / 4.0) AS w FROM k x JOIN k y ON x.pair_id = y.pair_id AND y.k <= x.k),
m AS (SELECT pair_id, ts, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, count(*) AS n FROM w GROUP BY 1, 2),
c AS (SELECT pair_id, ts, any_value(n) AS n, sum(w * (a - ma) * (b - mb)) AS ab, sum(w * (a - ma) ** 2) AS aa, sum(w * (b - mb) ** 2) AS bb FROM w JOIN m USING (pair_id, ts) GROUP BY 1, 2)
SELECT pair_id, ts, CASE WHEN n >= 3 AND aa > 0 AND bb > 0 THEN round(ab / sqrt(aa * bb), 6) END AS r FROM c""")
def _(spark, d):
    return rounded(P.ewma_correlation(returns(spark, d), 12), "r")


for name, f in (("ols_hac", P.hac), ("adf_kpss", P.unit_roots), ("cointegration", P.cointegration), ("johansen", P.johansen), ("granger", P.granger)):
    def _run(spark, d, f=f, name=name):
        return f(returns(spark, d) if name in ("ols_hac", "granger") else levels(spark, d))

    query(name)(_run)


@query("pair_analysis", f"""WITH {RET}, f AS (SELECT pair_id, corr(a, b) AS r, regr_slope(b, a) AS beta, regr_intercept(b, a) AS alpha, regr_r2(b, a) AS r2, count(*) AS n FROM rp GROUP BY 1)
SELECT pair_id, round(r, 6) AS pearson, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r2, n, CASE WHEN n < 30 THEN 'short sample' ELSE 'ok' END AS warning FROM f WHERE n >= 10""")
def _(spark, d):
    x = returns(spark, d)
    both = P.correlation(x).select("pair_id", "pearson", "n").join(P.regression(x).drop("n", "durbin_watson", "spurious"), "pair_id")
    return rounded(both.withColumn("warning", F.when(F.col("n") < 30, "short sample").otherwise("ok")), "pearson", "beta", "alpha", "r2")


@query("universe_structure")
def _(spark, d):
    return P.universe_structure(S.transform(S.resample(views.observations(spark, d), "1mo"), "log_ret"))


@query("regime_bands", f"""WITH {OBS} SELECT series_id, ts, CASE WHEN value < 100000 THEN 'low' WHEN value < 200000 THEN 'mid' ELSE 'high' END AS regime FROM obs""")
def _(spark, d):
    return R.bands(views.observations(spark, d), [100000.0, 200000.0], ["low", "mid", "high"])


@query("regime_presets", f"""WITH {OBS}, o AS (SELECT series_id, ts, value / 10000 AS value FROM obs), m AS (SELECT series_id, ts, value - lag(value, 63) OVER (PARTITION BY series_id ORDER BY ts) AS m FROM o)
SELECT 'vix' AS preset, series_id, ts, CASE WHEN value < 15 THEN 'calm' WHEN value < 25 THEN 'normal' ELSE 'stress' END AS regime FROM o UNION ALL SELECT 'hy', series_id, ts, CASE WHEN value < 3.5 THEN 'tight' WHEN value < 5 THEN 'mid' ELSE 'wide' END FROM o
UNION ALL SELECT 'fed', series_id, ts, CASE WHEN m < -0.1 THEN 'cutting' WHEN m > 0.1 THEN 'hiking' ELSE 'hold' END FROM m""")
def _(spark, d):
    o = views.observations(spark, d).withColumn("value", F.col("value") / 10000)
    parts = [R.preset(o, n).withColumn("preset", F.lit(n)) for n in ("vix", "hy", "fed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("regime_trend", f"""WITH {OBS}, m AS (SELECT series_id, ts, value - lag(value, 5) OVER (PARTITION BY series_id ORDER BY ts) AS m FROM obs)
SELECT series_id, ts, CASE WHEN m < -20000 THEN 'falling' WHEN m > 20000 THEN 'rising' ELSE 'flat' END AS regime FROM m""")
def _(spark, d):
    return R.trend(views.observations(spark, d), 5, 20000.0)


@query("regime_vol_quantile", f"""WITH {OBS}, w AS (SELECT series_id, ts, stddev_samp(value) OVER r AS sd, count(*) OVER r AS n FROM obs WINDOW r AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING)),
k AS (SELECT series_id, ts, sd, row_number() OVER (PARTITION BY series_id ORDER BY sd, ts) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS m FROM w WHERE n >= 10),
q AS (SELECT series_id, max(CASE WHEN k = floor((m - 1) * 0.33::DOUBLE + 0.5) THEN sd END) AS q0, max(CASE WHEN k = floor((m - 1) * 0.67::DOUBLE + 0.5) THEN sd END) AS q1 FROM k GROUP BY 1)
SELECT series_id, ts, CASE WHEN sd < q0 THEN 'low' WHEN sd < q1 THEN 'mid' ELSE 'high' END AS regime FROM k JOIN q USING (series_id)""")
def _(spark, d):
    return R.volatility(views.observations(spark, d), 20)


WINDOWS = [(0, "1995-06-01", "1996-06-01", "first"), (1, "1996-01-01", "1997-01-01", "second"), (2, "1998-01-01", "1998-12-31", "third")]


@query("regime_windows", f"""WITH {OBS}, w AS (SELECT * FROM (VALUES {', '.join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}', '{c}')" for i, a, b, c in WINDOWS)}) t(idx, s, e, label))
SELECT series_id, ts, coalesce(arg_max(label, idx), 'other') AS regime FROM obs LEFT JOIN w ON ts BETWEEN s AND e GROUP BY 1, 2""")
def _(spark, d):
    w = spark.createDataFrame(WINDOWS, "idx int, start string, end string, label string")
    w = w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    return R.user_windows(views.observations(spark, d), w)


@query("regime_markov")
def _(spark, d):
    return R.markov(S.transform(S.resample(views.ship_observations(spark, d), "1w"), "log_ret"))


@query("macro_z", f"""WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM obs),
s AS (SELECT series_id, arg_max(value, ts) AS l, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM k WHERE k <= 60 GROUP BY 1)
SELECT series_id, round(CASE WHEN sd = 0 THEN 0 ELSE greatest(-5, least(5, (l - m) / sd)) END, 6) AS z FROM s WHERE n >= 6""")
def _(spark, d):
    return rounded(M.last_z(views.observations(spark, d), 60), "z")


MONTHLY = f"""{OBS}, mon AS (SELECT series_id, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS ts, arg_max(value, ts) AS value FROM obs GROUP BY 1, 2)"""


@query("macro_tile", f"""WITH {MONTHLY}, l AS (SELECT *, lag(value) OVER w AS prev, lag(value, 12) OVER w AS y, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM mon WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
t AS (SELECT series_id, count(*) AS spark_n, avg(value) AS spark_mean FROM l WHERE k <= 24 GROUP BY 1)
SELECT l.series_id, ts, value AS last, prev, round(value - prev, 6) AS change, round((value / nullif(y, 0) - 1) * 100, 6) AS yoy, spark_n, round(spark_mean, 6) AS spark_mean FROM l JOIN t USING (series_id) WHERE k = 1""")
def _(spark, d):
    return rounded(M.tiles(S.resample(views.observations(spark, d), "1mo"), 12), "change", "yoy", "spark_mean")


@query("regime_label", f"""WITH {PAIRS}, l AS (SELECT pair_id, ts, a - lag(a) OVER w AS g, b - lag(b) OVER w AS i FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY ts))
SELECT pair_id, ts, CASE WHEN g >= 0 AND i < 0 THEN 'goldilocks' WHEN g >= 0 AND i >= 0 THEN 'reflation' WHEN g < 0 AND i >= 0 THEN 'stagflation' ELSE 'deflation' END AS regime FROM l WHERE g IS NOT NULL""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id").orderBy("ts")
    x = levels(spark, d).withColumns({"g": F.col("a") - F.lag("a").over(w), "i": F.col("b") - F.lag("b").over(w)}).where("g IS NOT NULL")
    return x.select("pair_id", "ts", M.quadrant(F.col("g"), F.col("i")).alias("regime"))


@query("recession_flag_intervals", f"""WITH {MONTHLY}, f AS (SELECT *, value < 100000 AS flag, coalesce(lag(value < 100000) OVER w, false) AS before FROM mon WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
i AS (SELECT *, sum(CASE WHEN flag AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS island FROM f)
SELECT series_id, min(ts) AS start, max(ts) AS "end", count(*) AS rows FROM i WHERE flag GROUP BY series_id, island""")
def _(spark, d):
    x = S.resample(views.observations(spark, d), "1mo").withColumn("flag", F.col("value") < 100000)
    return M.islands(x, "flag").drop("island")


@query("technical_recession", f"""WITH {OBS}, q AS (SELECT series_id, (date_trunc('quarter', ts) + INTERVAL 3 MONTH)::TIMESTAMP AS ts, arg_max(value, ts) AS value FROM obs GROUP BY 1, 2),
f AS (SELECT *, coalesce(value < lag(value) OVER w, false) AS falls, lead(ts) OVER w AS nxt FROM q WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
g AS (SELECT *, coalesce(lag(falls) OVER (PARTITION BY series_id ORDER BY ts), false) AS before FROM f),
i AS (SELECT *, sum(CASE WHEN falls AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS island FROM g)
SELECT series_id, min(ts) AS start, CASE WHEN count(nxt) = count(*) THEN max(nxt) END AS "end", count(*) AS rows FROM i WHERE falls GROUP BY series_id, island HAVING count(*) >= 2""")
def _(spark, d):
    return M.technical_recessions(S.resample(views.observations(spark, d), "1q"))


RELEASES = """rel AS (SELECT o_orderpriority AS event_key, CASE WHEN o_custkey % 2 = 0 THEN 'US' ELSE 'IL' END AS country, o_orderdate::TIMESTAMP AS ts, o_orderkey, (o_custkey % 3 + 1)::INT AS importance,
  o_totalprice AS actual, (o_custkey % 50) * 5000.0::DOUBLE AS consensus FROM orders)"""


def releases(spark, d):
    o = views.table(spark, d, "orders")
    return o.select(
        F.col("o_orderpriority").alias("event_key"), F.when(F.col("o_custkey") % 2 == 0, "US").otherwise("IL").alias("country"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") / 1000)).cast("timestamp_ntz").alias("ts"),
        (F.col("o_custkey") % 3 + 1).cast("int").alias("importance"), F.col("o_totalprice").alias("actual"),
        ((F.col("o_custkey") % 50) * 5000.0).alias("consensus"), "o_orderkey")


Z = f"""{RELEASES}, s AS (SELECT *, actual - consensus AS surprise, (actual - consensus) / nullif(abs(consensus), 0) * 100 AS surprise_pct,
  CASE WHEN count(*) OVER r >= 4 THEN (actual - consensus) / nullif(stddev_samp(actual - consensus) OVER r, 0) END AS z FROM rel
  WINDOW r AS (PARTITION BY event_key ORDER BY ts, o_orderkey ROWS 23 PRECEDING)),
sz AS (SELECT *, greatest(-6, least(6, z)) AS surprise_z FROM s WHERE z IS NOT NULL)"""


@query("surprise_rolling_z", f"""WITH {Z} SELECT o_orderkey, round(surprise, 6) AS surprise, round(surprise_pct, 6) AS surprise_pct, round(surprise_z, 6) AS surprise_z FROM sz""")
def _(spark, d):
    out = M.surprises(releases(spark, d)).where("surprise_z IS NOT NULL")
    return rounded(out.select("o_orderkey", "surprise", "surprise_pct", "surprise_z"), "surprise", "surprise_pct", "surprise_z")


@query("esi", f"""WITH {Z}, p AS (SELECT country, ts::DATE AS day, sum(importance * surprise_z) AS wz, sum(importance) AS w FROM sz GROUP BY 1, 2)
SELECT country, day, round(sum(wz) OVER r / nullif(sum(w) OVER r, 0), 6) AS esi FROM p WINDOW r AS (PARTITION BY country ORDER BY day RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return rounded(M.surprise_index(M.surprises(releases(spark, d))), "esi")


@query("compare_pivot", f"""WITH {MONTHLY} SELECT ts, max(CASE WHEN series_id = '1-URGENT' THEN value END) AS urgent, max(CASE WHEN series_id = '5-LOW' THEN value END) AS low FROM mon GROUP BY 1""")
def _(spark, d):
    x = S.resample(views.observations(spark, d), "1mo")
    return x.groupBy("ts").pivot("series_id", ["1-URGENT", "5-LOW"]).agg(F.first("value")).toDF("ts", "urgent", "low")
