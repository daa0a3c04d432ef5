"""Queries of scans, series transforms, alignment and indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspan.operators import indicators as I
from marlspan.operators import refresh as W
from marlspan.operators import series as S
from marlspan.sources import files, store, views
from marlspan.sources.files import kept, shared
from marlspan.sources.views import BARS, OBS, SHIP

from .registry import Register

reg = Register()
query = reg.query


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("scan_series", f"WITH {OBS} SELECT * FROM obs WHERE series_id = '1-URGENT' AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def _(spark, d):
    return views.observations(spark, d).where(
        "series_id = '1-URGENT' AND ts BETWEEN timestamp_ntz'1996-01-01 00:00:00' AND timestamp_ntz'1997-12-31 00:00:00'")


@query("scan_ohlcv", f"WITH {BARS} SELECT ticker, ts, open, high, low, close, volume FROM bars WHERE ticker = 'S3' AND ts >= TIMESTAMP '1997-01-01'")
def _(spark, d):
    return views.bars(spark, d).where(F.col("ticker") == F.upper(F.lit("s3"))).where("ts >= timestamp_ntz'1997-01-01 00:00:00'").drop("adj_close")


@query("read_ohlcv_adjusted", f"""WITH {BARS}, a AS (SELECT ticker, ts, open * (adj_close / close) AS open, adj_close AS close FROM bars),
w AS (SELECT *, CASE WHEN count(close) OVER f >= 20 THEN avg(close) OVER f END AS sma20 FROM a
      WINDOW f AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING))
SELECT ticker, ts, round(open, 6) AS open, round(close, 6) AS close, round(sma20, 6) AS sma20 FROM w WHERE ts >= TIMESTAMP '1998-01-01'""")
def _(spark, d):
    out = I.sma(I.adjusted(views.bars(spark, d)), 20).where("ts >= timestamp_ntz'1998-01-01 00:00:00'")
    return rounded(out.select("ticker", "ts", "open", "close", "sma20"), "open", "close", "sma20", digits=6)


@query("merge_write", f"""WITH {OBS} SELECT series_id, ts, round(CASE WHEN day(ts) <= 5 THEN value * 1.1 ELSE value END, 6) AS value FROM obs""")
def _(spark, d):
    obs = views.observations(spark, d)
    new = obs.where("day(ts) <= 5").withColumn("value", F.col("value") * 1.1)
    return rounded(S.last_wins(obs, new, ["series_id", "ts"]), "value", digits=6)


@query("normalize_obs", "SELECT o_orderdate::TIMESTAMP AS ts, o_totalprice AS value FROM orders WHERE o_orderdate IS NOT NULL")
def _(spark, d):
    return files.normalize(views.table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")))


@query("series_stats", f"WITH {OBS} SELECT series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY 1")
def _(spark, d):
    return views.observations(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("list_ids", "SELECT DISTINCT o_orderpriority AS series_id FROM orders")
def _(spark, d):
    return views.observations(spark, d).select("series_id").distinct()


@query("wide_scan", f"""WITH {SHIP} SELECT ts, max(CASE WHEN series_id = 'A' THEN value END) AS a, max(CASE WHEN series_id = 'N' THEN value END) AS n,
max(CASE WHEN series_id = 'R' THEN value END) AS r FROM ship WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY ts""")
def _(spark, d):
    x = views.ship_observations(spark, d).where("ts >= timestamp_ntz'1996-01-01 00:00:00'")
    return x.groupBy("ts").pivot("series_id", ["A", "N", "R"]).agg(F.first("value")).toDF("ts", "a", "n", "r")


@query("validate_range", f"""WITH {OBS} SELECT series_id, count(*) FILTER (value BETWEEN 50000 AND 500000) AS kept,
count(*) FILTER (NOT value BETWEEN 50000 AND 500000) AS dropped FROM obs GROUP BY 1""")
def _(spark, d):
    ok = F.col("value").between(50000, 500000)
    return views.observations(spark, d).groupBy("series_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("incremental_since", f"WITH {OBS} SELECT series_id, max(ts) - INTERVAL 10 DAY AS since FROM obs GROUP BY 1")
def _(spark, d):
    return views.observations(spark, d).groupBy("series_id").agg((F.max("ts") - F.expr("interval 10 days")).alias("since"))


@query("stale_series", f"""WITH {OBS}, m AS (SELECT series_id, max(ts) AS last_ts FROM obs GROUP BY 1)
SELECT series_id, last_ts, date_diff('day', last_ts, TIMESTAMP '2001-12-31') AS age_days,
CASE WHEN date_diff('day', last_ts, TIMESTAMP '2001-12-31') > 365 THEN 'late' ELSE 'ok' END AS state FROM m""")
def _(spark, d):
    m = views.observations(spark, d).groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.col("last_ts").cast("date")).cast("long")
    return m.withColumn("age_days", age).withColumn("state", F.when(F.col("age_days") > 365, "late").otherwise("ok"))


@query("csv_observations", """SELECT strptime(strftime(o_orderdate, '%Y-%m'), '%Y-%m')::TIMESTAMP AS ts, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0""")
def _(spark, d):
    o = views.table(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(";", F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice").cast("string"))).otherwise("no date;x")
    return files.parse_csv_lines(o.select(line.alias("value")))


@query("sdmx_csv", """WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)
  ELSE strftime(o_orderdate, '%Y-%m') END AS period, o_totalprice AS v FROM orders)
SELECT CASE WHEN length(period) = 4 THEN strptime(period, '%Y') WHEN period LIKE '%Q%' THEN make_timestamp(left(period, 4)::BIGINT, right(period, 1)::BIGINT * 3 - 2, 1, 0, 0, 0)
  ELSE strptime(period, '%Y-%m') END::TIMESTAMP AS ts, count(*) AS n, arg_max(v, k) AS value FROM x GROUP BY 1""")
def _(spark, d):
    o = views.table(spark, d, "orders")
    y = F.date_format("o_orderdate", "yyyy")
    period = F.when(F.col("o_orderkey") % 3 == 0, y).when(F.col("o_orderkey") % 3 == 1, F.concat(y, F.lit("-Q"), F.quarter("o_orderdate"))) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return o.select(files.sdmx_period(period).alias("ts"), "o_totalprice", "o_orderkey").groupBy("ts").agg(
        F.count("*").alias("n"), F.max_by("o_totalprice", "o_orderkey").alias("value"))


@query("kv_assumptions", """SELECT c_custkey AS row, CASE c_custkey % 3 WHEN 0 THEN round(c_acctbal / 100, 6) WHEN 1 THEN round(c_acctbal * 1e6, 2) ELSE round(c_acctbal * 1e3, 2) END AS value FROM customer""")
def _(spark, d):
    c = views.table(spark, d, "customer")
    raw = F.concat(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.element_at(F.array(F.lit("%"), F.lit(" mm"), F.lit("k")), (F.col("c_custkey") % 3 + 1).cast("int")))
    v = files.number_with_unit(raw)
    return c.select(F.col("c_custkey").alias("row"), F.when(F.col("c_custkey") % 3 == 0, F.round(v, 6)).otherwise(F.round(v, 2)).alias("value"))


@query("tail_limit", f"WITH {OBS} SELECT ts, value FROM obs WHERE series_id = '5-LOW' ORDER BY ts DESC LIMIT 500")
def _(spark, d):
    return views.observations(spark, d).where("series_id = '5-LOW'").orderBy(F.desc("ts")).limit(500).select("ts", "value")


@query("bar_normalize", """WITH x AS (SELECT l_suppkey % 10 AS s, (l_shipdate AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS day, l_extendedprice AS close, (l_orderkey * 10 + l_linenumber) * 1e6::DOUBLE + l_extendedprice AS k
  FROM lineitem) SELECT 'S' || s AS ticker, day, arg_max(close, k) AS close FROM x WHERE day < DATE '1998-06-01' GROUP BY 1, 2""")
def _(spark, d):
    x = views.table(spark, d, "lineitem")
    day = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), "l_shipdate").cast("date")
    return x.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("ticker"), day.alias("day"), "l_extendedprice",
                    ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1e6 + F.col("l_extendedprice")).alias("k")).where("day < date'1998-06-01'").groupBy("ticker", "day").agg(
        F.max_by("l_extendedprice", "k").alias("close"))


@query("agorot_scale", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN round(p_retailprice / 100, 6) ELSE round(p_retailprice, 6) END AS price FROM part""")
def _(spark, d):
    p = views.table(spark, d, "part").withColumn("currency", F.when(F.col("p_size") % 2 == 0, "ILA").otherwise("ILS"))
    return p.select("p_partkey", F.round(F.when(F.col("currency") == "ILA", F.col("p_retailprice") / 100).otherwise(F.col("p_retailprice")), 6).alias("price"))


for kind, expr in {
    "level": "value", "log_ret": "CASE WHEN value > 0 AND l > 0 THEN ln(value / l) END", "diff": "value - l", "diff_bp": "(value - l) * 100",
    "pct": "(value / nullif(l, 0) - 1) * 100", "yoy": "(value / nullif(l12, 0) - 1) * 100",
    "zscore": "CASE WHEN n = 20 THEN (value - m) / nullif(s, 0) END",
}.items():
    def _run(spark, d, kind=kind):
        return rounded(S.transform(views.observations(spark, d), kind), "value")

    query(f"tf_{kind}", f"""WITH {OBS}, w AS (SELECT *, lag(value) OVER o AS l, lag(value, 12) OVER o AS l12, avg(value) OVER r AS m, stddev_samp(value) OVER r AS s, count(*) OVER r AS n
FROM obs WINDOW o AS (PARTITION BY series_id ORDER BY ts), r AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING)), t AS (SELECT series_id, ts, {expr} AS v FROM w)
SELECT series_id, ts, round(v, 6) AS value FROM t WHERE v IS NOT NULL""")(_run)

for freq, unit, step in (("1w", "week", "7 DAY"), ("1mo", "month", "1 MONTH"), ("1q", "quarter", "3 MONTH"), ("1y", "year", "12 MONTH")):
    for how, agg in (("last", "arg_max(value, ts)"), ("first", "arg_min(value, ts)"), ("mean", "avg(value)"), ("sum", "sum(value::DECIMAL(24,2))::DOUBLE")):
        if freq in ("1mo", "1q") or how == "last":
            def _run(spark, d, freq=freq, how=how):
                return rounded(S.resample(views.observations(spark, d), freq, how), "value", digits=6)

            query(f"resample_{freq}_{how}", f"""WITH {OBS} SELECT series_id, (date_trunc('{unit}', ts) + INTERVAL {step})::TIMESTAMP AS ts, round({agg}, 6) AS value FROM obs GROUP BY 1, 2""")(_run)


@query("resample_rule", f"""WITH {OBS}, k AS (SELECT *, CASE WHEN series_id < '3' THEN 'yield' ELSE 'level' END AS kind FROM obs)
SELECT series_id, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS ts, round(CASE WHEN any_value(kind) = 'yield' THEN avg(value) ELSE arg_max(value, ts) END, 6) AS value FROM k GROUP BY 1, 2""")
def _(spark, d):
    obs = views.observations(spark, d)
    kinds = obs.select("series_id").distinct().withColumn("value_kind", F.when(F.col("series_id") < "3", "yield").otherwise("level"))
    return rounded(S.resample_by_kind(obs, kinds, "1mo"), "value", digits=6)


@query("rebase", f"""WITH {OBS} SELECT series_id, ts, round(value / first_value(value) OVER (PARTITION BY series_id ORDER BY ts) * 100, 6) AS value FROM obs""")
def _(spark, d):
    return rounded(S.rebase(views.observations(spark, d)), "value")


@query("compare_rebased", f"""WITH {BARS}, c AS (SELECT ts FROM bars GROUP BY 1 HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)),
j AS (SELECT ticker AS series_id, ts, close FROM bars WHERE ts IN (SELECT ts FROM c))
SELECT series_id, ts, round(close / first_value(close) OVER (PARTITION BY series_id ORDER BY ts) * 100, 6) AS value FROM j""")
def _(spark, d):
    closes = views.bars(spark, d).select(F.col("ticker").alias("series_id"), "ts", F.col("close").alias("value"))
    return rounded(S.rebase(S.common_dates(closes)), "value")


@query("formula_series", f"""WITH {SHIP}, p AS (SELECT ts, max(CASE WHEN series_id = 'A' THEN value END) AS a, max(CASE WHEN series_id = 'R' THEN value END) AS r FROM ship WHERE series_id IN ('A', 'R') GROUP BY 1),
f AS (SELECT ts, last_value(a IGNORE NULLS) OVER w AS a, last_value(r IGNORE NULLS) OVER w AS r FROM p WINDOW w AS (ORDER BY ts ROWS 10 PRECEDING))
SELECT 'spread' AS series_id, ts, round((a - r) * 100 / (a + r), 6) AS value FROM f WHERE a IS NOT NULL AND r IS NOT NULL""")
def _(spark, d):
    return rounded(S.formula_series(views.ship_observations(spark, d), "(x - y) * 100 / (x + y)", {"x": "A", "y": "R"}, "spread"), "value")


@query("publication_lag", f"""WITH {OBS} SELECT series_id, ts + to_days(CASE WHEN series_id < '3' THEN 30 ELSE 0 END) AS ts, value FROM obs""")
def _(spark, d):
    obs = views.observations(spark, d)
    lags = obs.where("series_id < '3'").select("series_id").distinct().withColumn("lag_days", F.lit(30))
    return S.publication_lag(obs, lags)


@query("join_inner_ts", f"""WITH {OBS} SELECT x.ts, x.value AS a, y.value AS b FROM obs x JOIN obs y USING (ts) WHERE x.series_id = '1-URGENT' AND y.series_id = '2-HIGH'""")
def _(spark, d):
    return S.pair(views.observations(spark, d), "1-URGENT", "2-HIGH")


@query("join_full_ffill", f"""WITH {SHIP}, p AS (SELECT ts, max(CASE WHEN series_id = 'A' THEN value END) AS a, max(CASE WHEN series_id = 'R' THEN value END) AS b FROM ship WHERE series_id IN ('A', 'R') GROUP BY 1),
f AS (SELECT ts, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM p WINDOW w AS (ORDER BY ts ROWS 5 PRECEDING)) SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(spark, d):
    return S.pair_full(views.ship_observations(spark, d), "A", "R", 5)


PAIRS = f"""{OBS}, mon AS (SELECT series_id, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS ts, arg_max(value, ts) AS value FROM obs GROUP BY 1, 2),
pairs AS (SELECT x.series_id || '|' || y.series_id AS pair_id, x.series_id AS a_id, y.series_id AS b_id, x.ts, x.value AS a, y.value AS b FROM mon x JOIN mon y ON x.ts = y.ts AND x.series_id < y.series_id)"""


@query("align_pair", f"""WITH {PAIRS}, l AS (SELECT a_id, b_id, ts, a, lag(b, 2) OVER (PARTITION BY a_id, b_id ORDER BY ts) AS b FROM pairs)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY a_id, b_id) >= 10 THEN 'ok' ELSE 'short' END AS status FROM l WHERE b IS NOT NULL""")
def _(spark, d):
    return S.align_pairs(views.observations(spark, d), "1mo", lag_b=2)


@query("shift_column", f"""WITH {OBS}, l AS (SELECT series_id, ts, lag(value, 3) OVER (PARTITION BY series_id ORDER BY ts) AS value FROM obs) SELECT * FROM l WHERE value IS NOT NULL""")
def _(spark, d):
    return S.shift_column(views.observations(spark, d), "value", 3, ["series_id"])


@query("self_pair_join", f"WITH {PAIRS} SELECT a_id, b_id, ts, a, b FROM pairs")
def _(spark, d):
    return S.all_pairs(S.resample(views.observations(spark, d), "1mo"))


@query("asof_backward", f"""WITH {SHIP}, r AS (SELECT (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS ts, series_id, CASE WHEN arg_max(value, ts) > 150000 THEN 'high' ELSE 'low' END AS regime FROM ship GROUP BY 1, 2)
SELECT s.series_id, s.ts, s.value, r.regime FROM ship s ASOF LEFT JOIN r ON s.series_id = r.series_id AND s.ts >= r.ts""")
def _(spark, d):
    ship = views.ship_observations(spark, d)
    r = S.resample(ship, "1mo").withColumn("regime", F.when(F.col("value") > 150000, "high").otherwise("low")).drop("value")
    return S.asof_backward(ship, r, ["series_id"], "regime")


@query("asof_price_at_period_end", f"""WITH {BARS}, e AS (SELECT ticker, unnest(generate_series(TIMESTAMP '1995-04-01', TIMESTAMP '2001-01-01', INTERVAL 3 MONTH)) AS ts FROM (SELECT DISTINCT ticker FROM bars)),
j AS (SELECT e.ticker, e.ts, b.close, b.ts AS found FROM e ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.ts >= b.ts)
SELECT ticker, ts, CASE WHEN found >= ts - INTERVAL 14 DAY THEN close END AS close FROM j""")
def _(spark, d):
    b = views.bars(spark, d)
    ends = b.select("ticker").distinct().withColumn("ts", F.explode(F.expr(
        "sequence(timestamp_ntz'1995-04-01 00:00:00', timestamp_ntz'2001-01-01 00:00:00', interval 3 months)")))
    return S.asof_within(ends, b.select("ticker", "ts", "close"), ["ticker"], "close", 14).select("ticker", "ts", "close")


@query("first_session_at_or_after", f"""WITH {BARS}, e AS (SELECT ticker, unnest(generate_series(TIMESTAMP '1995-04-01', TIMESTAMP '1999-01-01', INTERVAL 1 MONTH)) AS ts FROM (SELECT DISTINCT ticker FROM bars))
SELECT e.ticker, e.ts, b.close FROM e ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.ts <= b.ts""")
def _(spark, d):
    b = views.bars(spark, d)
    ends = b.select("ticker").distinct().withColumn("ts", F.explode(F.expr(
        "sequence(timestamp_ntz'1995-04-01 00:00:00', timestamp_ntz'1999-01-01 00:00:00', interval 1 month)")))
    return S.first_at_or_after(ends, b.select("ticker", "ts", "close"), ["ticker"], "close")


@query("ind_sma20", f"WITH {BARS} SELECT ticker, ts, round(CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END, 6) AS sma20 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING)")
def _(spark, d):
    return rounded(I.sma(views.bars(spark, d), 20), "sma20", digits=6).select("ticker", "ts", "sma20")


@query("ind_bb20", f"""WITH {BARS}, w AS (SELECT ticker, ts, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING))
SELECT ticker, ts, round(CASE WHEN n = 20 THEN m END, 6) AS bb_mid, round(CASE WHEN n = 20 THEN m + 2 * s END, 6) AS bb_up, round(CASE WHEN n = 20 THEN m - 2 * s END, 6) AS bb_low FROM w""")
def _(spark, d):
    return rounded(I.bollinger(views.bars(spark, d), 20), "bb_mid", "bb_up", "bb_low", digits=6).select("ticker", "ts", "bb_mid", "bb_up", "bb_low")


@query("ind_vwap", f"""WITH {BARS} SELECT ticker, ts, round(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return rounded(I.vwap(views.bars(spark, d)), "vwap", digits=6).select("ticker", "ts", "vwap")


def _ewm_sql(lists: str, alpha: str) -> str:
    """The running recursive average of a list of one-element lists."""
    return f"list_reduce({lists}, lambda p, q: list_append(p, p[-1] + ({alpha}) * (q[1] - p[-1])))"


@query("ind_ema20", f"""WITH {BARS}, h AS (SELECT ticker, list(ts ORDER BY ts) AS t, list([close] ORDER BY ts) AS x FROM bars GROUP BY 1), r AS (SELECT ticker, unnest(t) AS ts, unnest({_ewm_sql('x', '2.0::DOUBLE / 21')}) AS v FROM h)
SELECT ticker, ts, round(v, 6) AS ema20 FROM r""")
def _(spark, d):
    return rounded(I.ema(views.bars(spark, d), 20), "ema20", digits=6).select("ticker", "ts", "ema20")


@query("ind_rsi14", f"""WITH {BARS}, m AS (SELECT ticker, ts, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY ts), 0) AS move FROM bars),
h AS (SELECT ticker, list(ts ORDER BY ts) AS t, list([greatest(move, 0)] ORDER BY ts) AS u, list([greatest(-move, 0)] ORDER BY ts) AS d FROM m GROUP BY 1),
r AS (SELECT ticker, unnest(t) AS ts, unnest({_ewm_sql('u', '1.0::DOUBLE / 14')}) AS u, unnest({_ewm_sql('d', '1.0::DOUBLE / 14')}) AS d FROM h)
SELECT ticker, ts, round(100 * u / nullif(u + d, 0), 6) AS rsi14 FROM r""")
def _(spark, d):
    return rounded(I.rsi(views.bars(spark, d), 14), "rsi14", digits=6).select("ticker", "ts", "rsi14")


@query("ind_atr14", f"""WITH {BARS}, b AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS pc FROM bars),
h AS (SELECT ticker, list(ts ORDER BY ts) AS t, list([greatest(high - low, abs(high - pc), abs(low - pc))] ORDER BY ts) AS x FROM b GROUP BY 1), r AS (SELECT ticker, unnest(t) AS ts, unnest({_ewm_sql('x', '1.0::DOUBLE / 14')}) AS v FROM h)
SELECT ticker, ts, round(v, 6) AS atr14 FROM r""")
def _(spark, d):
    return rounded(I.atr(views.bars(spark, d), 14), "atr14", digits=6).select("ticker", "ts", "atr14")


@query("ind_macd", f"""WITH {BARS}, h AS (SELECT ticker, list(ts ORDER BY ts) AS t, list([close] ORDER BY ts) AS x FROM bars GROUP BY 1),
e AS (SELECT ticker, t, {_ewm_sql('x', '2.0::DOUBLE / 13')} AS fast, {_ewm_sql('x', '2.0::DOUBLE / 27')} AS slow FROM h), m AS (SELECT ticker, t, list_transform(list_zip(fast, slow), lambda p: p[1] - p[2]) AS macd FROM e),
s AS (SELECT ticker, unnest(t) AS ts, unnest(macd) AS macd, unnest({_ewm_sql('list_transform(macd, lambda v: [v])', '2.0::DOUBLE / 10')}) AS signal FROM m)
SELECT ticker, ts, round(macd, 6) AS macd, round(signal, 6) AS macd_signal, round(macd - signal, 6) AS macd_hist FROM s""")
def _(spark, d):
    return rounded(I.macd(views.bars(spark, d)), "macd", "macd_signal", "macd_hist", digits=6).select("ticker", "ts", "macd", "macd_signal", "macd_hist")


@query("ind_apply", f"""WITH {BARS} SELECT ticker, ts, round(CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END, 6) AS sma5,
round(sum((high + low + close) / 3 * volume) OVER u / nullif(sum(volume) OVER u, 0), 6) AS vwap FROM bars
WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 4 PRECEDING), u AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return rounded(I.apply(views.bars(spark, d), ["sma5", "vwap", "unknown9"]), "sma5", "vwap", digits=6).select("ticker", "ts", "sma5", "vwap")


@query("own_beta", f"""WITH {BARS}, k AS (SELECT ticker, date_trunc('week', ts)::TIMESTAMP AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2),
r AS (SELECT ticker, ts, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY ts)) AS r FROM k)
SELECT x.ticker, round(covar_samp(x.r, m.r) / var_samp(m.r), 6) AS beta, count(*) AS n, round(0.67 * covar_samp(x.r, m.r) / var_samp(m.r) + 0.33, 6) AS blume
FROM r x JOIN r m ON x.ts = m.ts AND m.ticker = 'S0' WHERE x.r IS NOT NULL AND m.r IS NOT NULL GROUP BY 1 HAVING count(*) >= 30""")
def _(spark, d):
    return rounded(I.own_beta(views.bars(spark, d), "S0"), "beta", "blume")


@query("range_52w", f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bars) SELECT ticker, max(high) AS high_52w, min(low) AS low_52w FROM r WHERE k <= 252 GROUP BY 1""")
def _(spark, d):
    return I.range_52w(views.bars(spark, d))


@query("last_k", f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bars) SELECT ticker, array_to_string(list(close ORDER BY ts), ',') AS closes FROM r WHERE k <= 5 GROUP BY 1""")
def _(spark, d):
    return I.last_k(views.bars(spark, d), 5).withColumn("closes", F.array_join(F.transform("closes", lambda x: x.cast("string")), ","))


@query("catalog_last_value", f"WITH {OBS} SELECT series_id, arg_max(value, ts) AS value FROM obs GROUP BY 1")
def _(spark, d):
    return views.observations(spark, d).groupBy("series_id").agg(F.max_by("value", "ts").alias("value"))


@query("scale_override", f"WITH {OBS} SELECT series_id, ts, round(value * CASE WHEN series_id < '3' THEN 0.001 ELSE 1.0 END, 6) AS value FROM obs")
def _(spark, d):
    return rounded(views.observations(spark, d).withColumn("value", F.col("value") * F.when(F.col("series_id") < "3", 0.001).otherwise(1.0)), "value")


@query("bounded_ffill", f"""WITH {SHIP}, g AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY)) AS ts),
j AS (SELECT g.ts, s.value FROM g LEFT JOIN (SELECT * FROM ship WHERE series_id = 'A' AND day(ts) % 3 = 0) s USING (ts))
SELECT ts, last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS 2 PRECEDING) AS value FROM j""")
def _(spark, d):
    days = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'1996-01-01 00:00:00', timestamp_ntz'1997-12-31 00:00:00', interval 1 day)")).alias("ts"))
    x = views.ship_observations(spark, d).where("series_id = 'A' AND day(ts) % 3 = 0").select("ts", "value")
    w = Window.partitionBy(F.lit("A")).orderBy("ts").rowsBetween(-2, 0)
    return days.join(x, "ts", "left").select("ts", F.last("value", ignorenulls=True).over(w).alias("value"))


# --- the lake on disk, and what follows from a fetch

FORMULAS = {"gap": ("x - y", {"x": "1-URGENT", "y": "2-HIGH"}), "share": ("gap * 100 / (z + gap)", {"gap": "gap", "z": "3-MEDIUM"}), "total": ("a + b * 2", {"a": "share", "b": "gap"}), "lone": ("u / 2", {"u": "5-LOW"})}
FETCHED = f"""{OBS}, latest AS (SELECT series_id, ts, CASE WHEN ts >= TIMESTAMP '1997-01-01' AND day(ts) = 7 AND series_id <> '5-LOW' THEN value * 1.5 ELSE value END AS value FROM obs WHERE series_id <> '5-LOW' OR ts < TIMESTAMP '1998-06-01')"""


def _level(name: str, of: dict[str, str], value: str) -> str:
    """A derived series over tables of its inputs, as SQL."""
    grid = " UNION ALL ".join(f"SELECT ts, {', '.join(f'value AS {c}' if c == n else f'NULL::DOUBLE AS {c}' for c in of)} FROM {t}" for n, t in of.items())
    held = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS 10 PRECEDING) AS {c}" for c in of)
    return f"""{name}_g AS (SELECT ts, {', '.join(f'max({c}) AS {c}' for c in of)} FROM ({grid}) GROUP BY 1), {name}_h AS (SELECT ts, {held} FROM {name}_g),
{name} AS (SELECT ts, {value} AS value FROM {name}_h WHERE {' AND '.join(f'{c} IS NOT NULL' for c in of)} AND ({value}) IS NOT NULL)"""


REFRESHED = f"""WITH {FETCHED}, s1 AS (SELECT ts, value FROM latest WHERE series_id = '1-URGENT'), s2 AS (SELECT ts, value FROM latest WHERE series_id = '2-HIGH'), s3 AS (SELECT ts, value FROM latest WHERE series_id = '3-MEDIUM'), s5 AS (SELECT ts, value FROM latest WHERE series_id = '5-LOW'),
{_level('gap', {'x': 's1', 'y': 's2'}, 'x - y')}, {_level('share', {'gap': 'gap', 'z': 's3'}, 'gap * 100 / (z + gap)')}, {_level('total', {'a': 'share', 'b': 'gap'}, 'a + b * 2')}, {_level('lone', {'u': 's5'}, 'u / 2')}
SELECT series_id, ts, round(value, 6) AS value FROM latest UNION ALL {' UNION ALL '.join(f"SELECT '{n}', ts, round(value, 6) FROM {n}" for n in ('gap', 'share', 'total', 'lone'))}"""


def lake(spark, d):  # noqa: ANN001, ANN201
    """A lake of the first years with its derived series, and what a fetch of all years, some values revised, tells."""
    obs = views.observations(spark, d)
    early = obs.where("ts < timestamp_ntz'1998-06-01'").where("NOT (series_id = '3-MEDIUM' AND ts >= timestamp_ntz'1998-01-01')")
    revised = F.when((F.col("ts") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.dayofmonth("ts") == 7), F.col("value") * 1.5).otherwise(F.col("value"))
    return early, obs.where("series_id <> '5-LOW'").withColumn("value", revised)


@query("refresh_derived", REFRESHED)
def _(spark, d):
    early, fetched = lake(spark, d)
    at = f"{shared(spark)}/lake-{uuid.uuid4().hex}"
    store.create(early.unionByName(W.recompute(early, FORMULAS)), at, 16)
    stored = store.read(spark, at)
    written, since = W.refresh(stored, fetched, FORMULAS, keep=lambda df, name: kept(df, f"{at}-{name}"))
    derived = F.col("series_id").isin(list(FORMULAS))
    store.upsert(written.where(~derived), at, 16)
    store.replace_from(written.where(derived), since, at, 16)
    return rounded(store.read(spark, at), "value", digits=6)


@query("store_upsert", f"""WITH {OBS} SELECT series_id, ts, round(CASE WHEN day(ts) <= 5 AND series_id < '3' THEN value * 1.1 ELSE value END, 6) AS value FROM obs UNION ALL SELECT 'new', ts, round(value, 6) FROM obs WHERE series_id = '5-LOW'""")
def _(spark, d):
    obs, at = views.observations(spark, d), f"{shared(spark)}/lake-{uuid.uuid4().hex}"
    store.create(obs, at, 16)
    again = obs.where("day(ts) <= 5 AND series_id < '3'").withColumn("value", F.col("value") * 1.1)
    store.upsert(again.unionByName(obs.where("series_id = '5-LOW'").withColumn("series_id", F.lit("new"))), at, 16)
    return rounded(store.read(spark, at), "value", digits=6)
