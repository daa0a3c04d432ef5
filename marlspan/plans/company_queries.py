"""Queries of fundamentals, valuation, event and news operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspan.functions.stats import ratio
from marlspan.operators import events as E
from marlspan.operators import fundamentals as D
from marlspan.operators import news as N
from marlspan.operators import valuation as V
from marlspan.sources import views
from marlspan.sources.files import kept, shared, widened
from marlspan.sources.views import BARS, FACTS, ITEMS

from .registry import Register
from .series_queries import rounded

reg = Register()
query = reg.query

# Facts as filed: each line of the supplier's quarter is a filing of its own, revised by later ones.
FILED = """filed AS (SELECT s_nationkey AS entity, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::TIMESTAMP AS period_end,
  CASE l_linenumber % 2 WHEN 0 THEN 'revenue' ELSE 'assets' END AS field, 'src' || (l_partkey % 3) AS source, l_orderkey AS filed, l_extendedprice AS value,
  l_returnflag = 'R' AS restated, l_partkey % 5 / 5.0::DOUBLE AS confidence, (l_partkey % 3)::INT AS source_rank, l_quantity > 3 AS approved,
  l_orderkey * 1000.0::DOUBLE + l_partkey % 1000 + l_extendedprice / 1e7 AS ord FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def filed(spark, d):
    x, s = views.table(spark, d, "lineitem"), views.table(spark, d, "supplier")
    return x.join(s, x.l_suppkey == s.s_suppkey).select(
        F.col("s_nationkey").alias("entity"), (F.date_trunc("quarter", "l_shipdate") + F.expr("interval 3 months")).cast("timestamp_ntz").alias("period_end"),
        F.when(F.col("l_linenumber") % 2 == 0, "revenue").otherwise("assets").alias("field"),
        F.concat(F.lit("src"), (F.col("l_partkey") % 3).cast("string")).alias("source"), F.col("l_orderkey").alias("order"), F.col("l_extendedprice").alias("value"),
        (F.col("l_returnflag") == "R").alias("restated"), (F.col("l_partkey") % 5 / 5.0).alias("confidence"), (F.col("l_partkey") % 3).cast("int").alias("source_rank"),
        (F.col("l_quantity") > 3).alias("approved"),
        (F.col("l_orderkey") * 1000.0 + F.col("l_partkey") % 1000 + F.col("l_extendedprice") / 1e7).alias("filed"), F.lit(0).alias("priority"))


@query("point_in_time_views", f"""WITH {FILED} SELECT entity, field, period_end, arg_min(value, ord) AS first_value, arg_max(value, ord) AS last_value, count(DISTINCT ord) AS filings FROM filed GROUP BY 1, 2, 3""")
def _(spark, d):
    return D.point_in_time(filed(spark, d))


@query("fact_resolve", f"""WITH {FILED}, a AS (SELECT *, row_number() OVER (PARTITION BY entity, field, period_end, source ORDER BY restated DESC, ord DESC) AS k FROM filed WHERE approved),
b AS (SELECT *, row_number() OVER (PARTITION BY entity, field, period_end ORDER BY confidence DESC, source_rank, ord DESC) AS j FROM a WHERE k = 1)
SELECT entity, field, period_end, source, value, restated FROM b WHERE j = 1""")
def _(spark, d):
    return D.resolve(filed(spark, d)).select("entity", "field", "period_end", "source", "value", "restated")


@query("canonical_statement", f"WITH {FACTS} SELECT entity, period_end, revenue, cost_of_revenue, tax, units FROM wide_facts")
def _(spark, d):
    return D.statements(views.facts(spark, d), ["revenue", "cost_of_revenue", "tax", "units"])


@query("prune_empty_periods", f"""WITH {FACTS}, c AS (SELECT * FROM facts WHERE field <> 'revenue' OR entity % 2 = 0)
SELECT * FROM c WHERE (entity, period_end) IN (SELECT (entity, period_end) FROM c WHERE field = 'revenue')""")
def _(spark, d):
    return D.prune_empty(views.facts(spark, d).where("field <> 'revenue' OR entity % 2 = 0"), ["revenue"])


@query("ttm", f"""WITH {FACTS}, w AS (SELECT *, year(period_end) * 4 + quarter(period_end) AS q FROM facts),
t AS (SELECT entity, field, period_end, value, CASE WHEN count(value) OVER w = 4 AND q - min(q) OVER w = 3 THEN sum(value) OVER w END AS ttm FROM w WINDOW w AS (PARTITION BY entity, field ORDER BY period_end ROWS 3 PRECEDING))
SELECT entity, field, period_end, round(ttm, 4) AS ttm FROM t""")
def _(spark, d):
    return rounded(D.ttm(views.facts(spark, d)).select("entity", "field", "period_end", "ttm"), "ttm", digits=4)


@query("facts_upsert", f"""WITH {FACTS}, n AS (SELECT entity, field, period_end, CASE WHEN entity % 3 = 0 THEN value * 2 ELSE value END AS value FROM facts WHERE field = 'units')
SELECT entity, field, period_end, value, false AS restated FROM facts WHERE field = 'units' UNION ALL SELECT entity, field, period_end, value, true FROM n WHERE entity % 3 = 0 AND abs(value / 2) > 1e-6""")
def _(spark, d):
    old = views.facts(spark, d).where("field = 'units'")
    new = old.withColumn("value", F.when(F.col("entity") % 3 == 0, F.col("value") * 2).otherwise(F.col("value")))
    return D.upsert(old, new, ["entity", "field", "period_end"])


@query("percentiles", """SELECT l_returnflag AS k, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS p75 FROM lineitem GROUP BY 1""")
def _(spark, d):
    return views.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(*V.quartiles(F.col("l_extendedprice")))


INPUTS = """inp AS (SELECT c_custkey AS ticker, 1000.0::DOUBLE + c_custkey % 100 * 10 AS revenue, c_custkey % 10 / 50.0::DOUBLE AS growth, 0.02::DOUBLE AS terminal_growth,
  0.1 + c_custkey % 7 / 100.0::DOUBLE AS margin, 0.25::DOUBLE AS tax, 0.3::DOUBLE AS reinvestment, 0.07 + c_custkey % 5 / 100.0::DOUBLE AS wacc, c_custkey % 11 * 10.0::DOUBLE AS net_debt, 100.0::DOUBLE AS shares FROM customer)"""


def inputs(spark, d):
    k = F.col("c_custkey")
    return views.table(spark, d, "customer").select(
        k.alias("ticker"), (1000.0 + k % 100 * 10).alias("revenue"), (k % 10 / 50.0).alias("growth"), F.lit(0.02).alias("terminal_growth"),
        (0.1 + k % 7 / 100.0).alias("margin"), F.lit(0.25).alias("tax"), F.lit(0.3).alias("reinvestment"), (0.07 + k % 5 / 100.0).alias("wacc"),
        (k % 11 * 10.0).alias("net_debt"), F.lit(100.0).alias("shares"))


def _dcf_sql(source: str, keys: str) -> str:
    return f"""y AS (SELECT *, unnest(range(1, 11)) AS t FROM {source}), g AS (SELECT *, growth + (terminal_growth - growth) * (t - 1) / 10.0::DOUBLE AS g FROM y),
c AS (SELECT *, revenue * exp(sum(ln(1 + greatest(g, -0.99::DOUBLE))) OVER (PARTITION BY {keys} ORDER BY t)) * margin * (1 - tax) * (1 - reinvestment) AS cash FROM g),
v AS (SELECT {keys}, sum(cash / pow(1 + wacc, t - 0.5)) AS pv, arg_max(cash, t) * any_value(1 + terminal_growth) / any_value(greatest(wacc - terminal_growth, 0.005)) / pow(1 + any_value(wacc), 10) AS terminal,
  any_value(net_debt) AS net_debt, any_value(shares) AS shares FROM c GROUP BY {keys})"""


@query("fcff_dcf", f"WITH {INPUTS}, {_dcf_sql('inp', 'ticker')} SELECT ticker, round(pv, 4) AS pv, round(terminal, 4) AS terminal, round((pv + terminal - net_debt) / shares, 5) AS value FROM v")
def _(spark, d):
    return rounded(rounded(V.fcff(inputs(spark, d), ["ticker"]), "pv", "terminal", digits=4), "value", digits=5)


@query("sensitivity_grid", f"""WITH {INPUTS}, a AS (SELECT * REPLACE (wacc + dw AS wacc, terminal_growth + dt AS terminal_growth), dw AS d_wacc, dt AS d_terminal_growth
  FROM (SELECT *, unnest([-0.01, 0.0, 0.01]::DOUBLE[]) AS dw FROM inp), (SELECT unnest([-0.005, 0.0, 0.005]::DOUBLE[]) AS dt)), {_dcf_sql('a', 'ticker, d_wacc, d_terminal_growth')}
SELECT ticker, d_wacc, d_terminal_growth, round((pv + terminal - net_debt) / shares, 5) AS value FROM v""")
def _(spark, d):
    g = V.grid(widened(inputs(spark, d)), {"wacc": [-0.01, 0.0, 0.01], "terminal_growth": [-0.005, 0.0, 0.005]})
    return rounded(V.fcff(g, ["ticker", "d_wacc", "d_terminal_growth"]).drop("pv", "terminal"), "value", digits=5)


def _centred_sql(x: str, x_step: float, y: str, y_step: float, keep: str) -> str:
    return f"""WITH {INPUTS}, a AS (SELECT * REPLACE (ax AS {x}, ay AS {y}), ax AS at_{x}, ay AS at_{y} FROM (SELECT *, unnest(list_transform(range(-2, 3), lambda i: round({y} + i * {y_step}, 4))) AS ay FROM
  (SELECT *, list_min(list_transform(range(-2, 3), lambda i: round({x} + i * {x_step}, 4))) AS low, unnest(list_transform(range(-2, 3), lambda i: round({x} + i * {x_step}, 4))) AS ax FROM inp)) WHERE {keep}), {_dcf_sql('a', f'ticker, at_{x}, at_{y}')}
SELECT ticker, at_{x}, at_{y}, round((pv + terminal - net_debt) / shares, 5) AS value FROM v"""


@query("wacc_growth_grid", _centred_sql("wacc", 0.01, "terminal_growth", 0.005, "ay < low"))
def _(spark, d):
    g = V.centred_grid(widened(inputs(spark, d)), {"wacc": 0.01, "terminal_growth": 0.005}, below=("terminal_growth", "wacc"))
    return rounded(V.fcff(g, ["ticker", "at_wacc", "at_terminal_growth"]).drop("pv", "terminal"), "value", digits=5)


@query("growth_margin_grid", _centred_sql("growth", 0.02, "margin", 0.02, "true"))
def _(spark, d):
    g = V.centred_grid(widened(inputs(spark, d)), {"growth": 0.02, "margin": 0.02})
    return rounded(V.fcff(g, ["ticker", "at_growth", "at_margin"]).drop("pv", "terminal"), "value", digits=5)


@query("reverse_dcf")
def _(spark, d):
    return V.implied_growth(inputs(spark, d).withColumn("price", 10.0 + F.col("ticker") % 20)).select("ticker", "price", "implied_growth")


@query("weighted_median", """WITH w AS (SELECT l_suppkey AS k, l_extendedprice AS v, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) AS r,
sum(l_quantity) OVER (PARTITION BY l_suppkey) AS t FROM lineitem) SELECT k AS l_suppkey, min(v) AS blended FROM w WHERE r >= 0.5 * t - 1e-12 GROUP BY 1""")
def _(spark, d):
    return V.weighted_median(views.table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("graham_number", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN sqrt(22.5 * c_acctbal * (c_custkey % 7 + 1)) END, 6) AS graham FROM customer")
def _(spark, d):
    c = views.table(spark, d, "customer")
    return c.select("c_custkey", F.round(V.graham(F.col("c_acctbal"), (F.col("c_custkey") % 7 + 1).cast("double")), 6).alias("graham"))


REPORTS = """rep AS (SELECT o_orderkey AS event_id, o_orderpriority || (o_custkey % 50) AS event_key, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m') END AS period, o_orderdate::DATE AS day,
  CASE o_custkey % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'vendor' WHEN 2 THEN 'rule' WHEN 3 THEN 'forexfactory' ELSE 'user' END AS tier, CASE WHEN o_custkey % 7 = 0 THEN 'revised' ELSE 'scheduled' END AS status,
  (o_custkey % 4)::INT AS importance, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END AS actual, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice / 2 END AS consensus, 'tag' || (o_custkey % 3) AS tag FROM orders)"""


def reports(spark, d):
    o = views.table(spark, d, "orders")
    k = F.col("o_custkey")
    tier = F.element_at(F.array(*[F.lit(t) for t in ("official", "vendor", "rule", "forexfactory", "user")]), (k % 5 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.concat("o_orderpriority", (k % 50).cast("string")).alias("event_key"),
        F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM")).alias("period"), F.col("o_orderdate").cast("date").alias("day"),
        tier.alias("tier"), F.when(k % 7 == 0, "revised").otherwise("scheduled").alias("status"), (k % 4).cast("int").alias("importance"),
        F.when(k % 2 == 0, F.col("o_totalprice")).alias("actual"), F.when(k % 3 == 0, F.col("o_totalprice") / 2).alias("consensus"),
        F.concat(F.lit("tag"), (k % 3).cast("string")).alias("tag"))


def _best(field: str, order: str) -> str:
    return f"arg_min({field}, list_position({order}, tier) * 1000000000000 + event_id) FILTER ({field} IS NOT NULL) AS {field}"


OFFICIAL = "['official', 'vendor', 'forexfactory', 'rule', 'user']"


@query("event_merge", f"""WITH {REPORTS}, f AS (SELECT event_key, period, min(event_id) AS first FROM rep WHERE period IS NOT NULL GROUP BY 1, 2),
g AS (SELECT DISTINCT r.event_key, r.period, r.day, f.first FROM rep r JOIN f ON r.event_key = f.event_key AND r.period = f.period),
n AS (SELECT r.event_id, g.period, row_number() OVER (PARTITION BY r.event_id ORDER BY CASE g.day - r.day WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END, g.first) AS k
  FROM rep r JOIN g ON r.event_key = g.event_key AND g.day BETWEEN r.day - 1 AND r.day + 1 WHERE r.period IS NULL),
a AS (SELECT r.* REPLACE (coalesce(r.period, n.period) AS period) FROM rep r LEFT JOIN n ON r.event_id = n.event_id AND n.k = 1),
m AS (SELECT event_key, period, CASE WHEN period IS NULL THEN day END AS "on", {_best('actual', OFFICIAL)}, {_best('consensus', "['vendor', 'forexfactory', 'official', 'rule', 'user']")},
  {_best('status', "['official', 'rule', 'vendor', 'forexfactory', 'user']")}, max(importance) AS importance, min(day) AS day, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags, count(*) AS reports FROM a GROUP BY 1, 2, 3)
SELECT * REPLACE (CASE WHEN status = 'scheduled' AND actual IS NOT NULL THEN 'released' ELSE status END AS status) FROM m""")
def _(spark, d):
    return E.merge_reports(reports(spark, d), ["actual", "consensus"])


@query("time_band_join", f"""WITH {REPORTS}, a AS (SELECT event_key, day, event_id AS id FROM rep WHERE period IS NULL), b AS (SELECT event_key, day, min(event_id) AS other FROM rep WHERE period IS NOT NULL GROUP BY 1, 2),
j AS (SELECT a.id, a.event_key, a.day, b.other, row_number() OVER (PARTITION BY a.id ORDER BY CASE b.day - a.day WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END) AS k FROM a JOIN b ON a.event_key = b.event_key AND b.day - a.day BETWEEN -1 AND 1)
SELECT id, event_key, day, other AS other_id FROM j WHERE k = 1""")
def _(spark, d):
    r = reports(spark, d)
    a = r.where("period IS NULL").select("event_key", "day", F.col("event_id").alias("id"))
    b = r.where("period IS NOT NULL").groupBy("event_key", "day").agg(F.min("event_id").alias("other_id"))
    return E.near_days(a, b, "event_key")


@query("news_band_join", f"""WITH {ITEMS} SELECT i.item_id, count(*) AS near, max(j.item_id) AS latest FROM items i JOIN items j ON i.ticker = j.ticker AND j.item_id < i.item_id
AND j.published_at >= i.published_at - INTERVAL 48 HOUR GROUP BY 1""")
def _(spark, d):
    i = views.items(spark, d).select("ticker", "item_id", "published_at")
    return N.earlier_within(i, 48).groupBy("item_id").agg(F.count("*").alias("near"), F.max("other_id").alias("latest"))


@query("event_upsert_vintage", """WITH s AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS actual, arg_max(o_totalprice / 2, o_orderkey) AS consensus, CASE WHEN o_custkey % 11 = 0 THEN 'user' ELSE 'feed' END AS provider
  FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
f AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 5 <> 0 THEN max(o_totalprice) END AS actual, CASE WHEN o_custkey % 4 = 0 THEN max(o_totalprice) / 2 END AS consensus FROM orders GROUP BY o_custkey),
j AS (SELECT f.k, s.k IS NOT NULL AS there, s.provider = 'user' AS users, coalesce(f.actual, s.actual) AS a, coalesce(f.consensus, s.consensus) AS c, s.actual AS sa, s.consensus AS sc,
  (f.actual IS NOT NULL AND (s.k IS NULL OR f.actual IS DISTINCT FROM s.actual)) OR (f.consensus IS NOT NULL AND (s.k IS NULL OR f.consensus IS DISTINCT FROM s.consensus)) AS moved FROM f LEFT JOIN s USING (k)),
x AS (SELECT *, CASE WHEN users THEN 'kept' WHEN moved AND there THEN 'vintage' WHEN moved THEN 'new' ELSE 'same' END AS action FROM j)
SELECT k AS o_custkey, action, CASE WHEN action IN ('kept', 'same') THEN 'scheduled' WHEN there AND sa IS NOT NULL AND a <> sa THEN 'revised' WHEN a IS NOT NULL THEN 'released' ELSE 'scheduled' END AS status,
CASE WHEN action = 'kept' THEN sa ELSE a END AS actual, CASE WHEN action = 'kept' THEN sc ELSE c END AS consensus,
CASE WHEN action IN ('new', 'vintage') THEN a - c END AS surprise, CASE WHEN action IN ('new', 'vintage') THEN (a - c) / nullif(abs(c), 0) * 100 END AS surprise_pct FROM x""")
def _(spark, d):
    o = views.table(spark, d, "orders")
    k = F.col("o_custkey")
    stored = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(
        F.max_by("o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))).alias("actual"), F.max_by(F.col("o_totalprice") / 2, "o_orderkey").alias("consensus")) \
        .withColumns({"status": F.lit("scheduled"), "provider": F.when(k % 11 == 0, "user").otherwise("feed")})
    fresh = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")).select(
        "o_custkey", F.when(k % 5 != 0, F.col("m")).alias("actual"), F.when(k % 4 == 0, F.col("m") / 2).alias("consensus"), F.lit("scheduled").alias("status"), F.lit("feed").alias("provider"))
    return E.upsert_vintages(stored, fresh, ["o_custkey"], ["actual", "consensus"])


EVENTS = "e AS (SELECT o_orderkey AS event_id, 'S' || (o_orderkey % 10) AS ticker, o_orderdate::DATE AS day FROM orders)"


def ticker_events(spark, d):
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.concat(F.lit("S"), (F.col("o_orderkey") % 10).cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("day"))


REACTION = """w AS (SELECT e.event_id, e.ticker, e.day, b.ts, b.close, b.volume, b.close / nullif(lag(b.close) OVER (PARTITION BY e.event_id ORDER BY b.ts), 0) - 1 AS ret,
  CASE WHEN b.ts < e.day THEN row_number() OVER (PARTITION BY e.event_id, b.ts < e.day ORDER BY b.ts DESC) END AS back, CASE WHEN b.ts >= e.day THEN row_number() OVER (PARTITION BY e.event_id, b.ts >= e.day ORDER BY b.ts) END AS ahead
  FROM e LEFT JOIN bars b ON e.ticker = b.ticker AND b.ts::DATE BETWEEN e.day - 120 AND e.day + 5),
m AS (SELECT event_id, ticker, count(ts) AS n, max(ahead) AS n_ahead, max(least(back, 60)) AS n_back, max(ts) FILTER (ahead = 1) AS session, max(ret) FILTER (ahead = 1) AS ret, max(volume) FILTER (ahead = 1) AS volume,
  stddev_samp(ret) FILTER (back <= 60) AS ret_sd, avg(volume) FILTER (back <= 60) AS vol_mean, stddev_samp(volume) FILTER (back <= 60) AS vol_sd FROM w GROUP BY 1, 2),
z AS (SELECT *, coalesce(n >= 20 AND n_ahead > 0 AND n_back >= 10, false) AS known, CASE WHEN ret IS NOT NULL AND ret_sd > 1e-9 THEN abs(ret) / ret_sd ELSE 0 END AS rz,
  CASE WHEN vol_sd > 1e-9 THEN (volume - vol_mean) / vol_sd ELSE 0 END AS vz FROM m)"""


@query("market_reaction", f"""WITH {BARS}, {EVENTS}, {REACTION} SELECT event_id, ticker, CASE WHEN known THEN session END AS session, CASE WHEN known THEN round(ret, 6) END AS ret,
CASE WHEN known THEN round(rz, 2) END AS ret_z, CASE WHEN known THEN round(vz, 2) END AS vol_z, CASE WHEN known THEN round(least(1, (rz + greatest(0, vz)) / 6), 3) ELSE 0 END AS score FROM z""")
def _(spark, d):
    return rounded(E.market_reaction(ticker_events(spark, d), views.bars(spark, d)), "ret")


@query("calendar_rules", """WITH o AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, day + 21 AS minutes, day - 14 AS beige FROM o""")
def _(spark, d):
    o = views.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", E.fomc_minutes(F.col("day")).alias("minutes"), E.beige_book(F.col("day")).alias("beige"))


@query("cbs_release", """WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderkey % 2 = 0 AS price FROM orders), h AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_custkey % 100 = 0 AND day(o_orderdate) IN (3, 14, 15)),
d AS (SELECT o.id, o.day, o.price, k, (o.day - k::INT)::DATE AS open_day FROM o, (SELECT unnest(range(0, 15)) AS k)), f AS (SELECT id, arg_min(open_day, k) AS open_day, min(k) AS k FROM d WHERE isodow(open_day) NOT IN (5, 6) AND open_day NOT IN (SELECT day FROM h) GROUP BY 1)
SELECT o.id, o.day, ((f.open_day + CASE WHEN NOT price THEN INTERVAL 780 MINUTE WHEN f.k = 0 THEN INTERVAL 1110 MINUTE ELSE INTERVAL 840 MINUTE END) AT TIME ZONE 'Asia/Jerusalem' AT TIME ZONE 'UTC')::TIMESTAMP AS release FROM o LEFT JOIN f USING (id)""")
def _(spark, d):
    o = views.table(spark, d, "orders")
    closed = o.where("o_custkey % 100 = 0 AND day(o_orderdate) IN (3, 14, 15)").select(F.to_date("o_orderdate").alias("day"))
    nominal = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return E.cbs_release(nominal, closed, F.col("id") % 2 == 0)


@query("reporting_deadlines", """SELECT y::INT AS year, unnest([make_date(y, 3, 31), make_date(y, 5, 31), make_date(y, 8, 31), make_date(y, 11, 30)]) AS deadline, unnest(['FY', 'Q1', 'Q2', 'Q3']) AS period,
unnest(['annual report FY' || (y - 1), 'Q1 ' || y || ' report', 'Q2 ' || y || ' report', 'Q3 ' || y || ' report']) AS label FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)""")
def _(spark, d):
    return E.reporting_deadlines(views.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct())


@query("month_range", """WITH c AS (SELECT c_custkey, DATE '2020-01-15' + (c_custkey % 90)::INT AS a, DATE '2020-01-15' + (c_custkey % 90 + c_custkey % 400)::INT AS b FROM customer)
SELECT c_custkey, 'month' AS unit, year(m)::INT AS year, month(m)::INT AS part FROM (SELECT c_custkey, unnest(generate_series(date_trunc('month', a)::DATE, date_trunc('month', b)::DATE, INTERVAL 1 MONTH)) AS m FROM c)
UNION ALL SELECT c_custkey, 'quarter', year(m)::INT, quarter(m)::INT FROM (SELECT c_custkey, unnest(generate_series(date_trunc('quarter', a)::DATE, date_trunc('quarter', b)::DATE, INTERVAL 3 MONTH)) AS m FROM c)""")
def _(spark, d):
    k = F.col("c_custkey")
    c = views.table(spark, d, "customer").select("c_custkey", F.date_add(F.lit("2020-01-15").cast("date"), (k % 90).cast("int")).alias("a"), F.date_add(F.lit("2020-01-15").cast("date"), (k % 90 + k % 400).cast("int")).alias("b"))
    return E.month_range(c, "a", "b").withColumn("unit", F.lit("month")).unionByName(E.month_range(c, "a", "b", 3).withColumn("unit", F.lit("quarter"))).select("c_custkey", "unit", "year", "part")


@query("option_expiry", """WITH m AS (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2024-12-01', INTERVAL 1 MONTH))::DATE AS month), f AS (SELECT month, (month + ((12 - isodow(month)) % 7)::INT + 14)::DATE AS day FROM m)
SELECT month, CASE WHEN day IN (DATE '2022-04-15', DATE '2024-03-15') THEN day - 1 ELSE day END AS expiry, month(month) % 3 = 0 AS quadruple FROM f""")
def _(spark, d):
    return E.option_expiry(spark, "2020-01-01", "2024-12-01", ["2022-04-15", "2024-03-15"])


@query("market_open", """SELECT event_id, isodow(l) <= 5 AND hour(l) * 60 + minute(l) >= 570 AND hour(l) * 60 + minute(l) < 960 AS open FROM (SELECT event_id, ts::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS l FROM events)""")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", E.market_open(F.col("ts"), "America/New_York", 570, 960, [0, 1, 2, 3, 4]).alias("open"))


@query("quiet_hours", "SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 420 AS quiet FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", E.quiet(F.hour("ts") * 60 + F.minute("ts"), 1320, 420).alias("quiet"))


@query("next_business_day", """WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY))::DATE AS day)
SELECT day, min(CASE WHEN isodow(day) < 6 AND day NOT IN (DATE '2024-07-04', DATE '2024-12-25') THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_open FROM d""")
def _(spark, d):
    return E.business_days(spark, "2024-01-01", "2024-12-31", ["2024-07-04", "2024-12-25"], [5, 6])


LINKS = """links AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/?utm_source=x&b=2&a=1&fbclid=9&_ga=1#top' WHEN 2 THEN replace(url, 'https://', 'HTTP://') || '?ref_src=t&source=s&z=&y=3'
  ELSE 'https://news.google.com/rss/articles/' || translate(rtrim(base64(encode(chr(8) || chr(19) || chr(34) || chr(60) || url || chr(1) || 'x')), '='), '+/', '-_') || '?oc=5' END AS link, url FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages))"""
CLEAN = """CASE page_id % 4 WHEN 1 THEN h || rtrim(p, '/') || '?a=1&b=2' WHEN 2 THEN h || CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END || '?source=s&y=3' ELSE h || CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END END"""
SPLIT = r"split_url AS (SELECT *, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p FROM links)"


def links(spark, d):
    k = F.col("page_id")
    url = F.substring_index("url", "?", 1)
    hidden = F.base64(F.concat(F.lit("\x08\x13\x22\x3c"), url, F.lit("\x01x")).cast("binary"))
    google = F.concat(F.lit("https://news.google.com/rss/articles/"), F.translate(F.rtrim(hidden, F.lit("=")), "+/", "-_"), F.lit("?oc=5"))
    link = F.when(k % 4 == 0, url).when(k % 4 == 1, F.concat(url, F.lit("/?utm_source=x&b=2&a=1&fbclid=9&_ga=1#top"))) \
        .when(k % 4 == 2, F.concat(F.replace(url, F.lit("https://"), F.lit("HTTP://")), F.lit("?ref_src=t&source=s&z=&y=3"))).otherwise(google)
    return views.table(spark, d, "pages").select("page_id", link.alias("link"))


@query("canonical_url", f"WITH {LINKS}, {SPLIT} SELECT page_id, {CLEAN} AS url FROM split_url")
def _(spark, d):
    return links(spark, d).select("page_id", N.canonical_url(F.col("link")).alias("url"))


@query("decoded_link", f"WITH {LINKS} SELECT page_id, CASE WHEN page_id % 4 = 3 THEN url END AS url FROM links")
def _(spark, d):
    return links(spark, d).select("page_id", N.decoded_link(F.col("link")).alias("url"))


@query("url_hash", f"WITH {LINKS}, {SPLIT} SELECT page_id, left(sha256({CLEAN}), 40) AS h FROM split_url")
def _(spark, d):
    return links(spark, d).select("page_id", N.url_hash(F.col("link")).alias("h"))


TITLE_SQL = r"""trim(regexp_replace(regexp_replace(lower(CASE WHEN length(trim(regexp_replace(t, '\s+[-–—|:]\s+([^-–—|]{2,40})$', ''))) >= 20 AND regexp_extract(t, '\s+[-–—|:]\s+([^-–—|]{2,40})$', 1) <> ''
  AND len(string_split_regex(trim(regexp_extract(t, '\s+[-–—|:]\s+([^-–—|]{2,40})$', 1)), '\s+')) <= 5 THEN regexp_replace(t, '\s+[-–—|:]\s+([^-–—|]{2,40})$', '') ELSE t END), '[^\p{L}\p{M}\p{N}_\s$%]+', ' ', 'g'), '\s+', ' ', 'g'))"""
TITLES = r"""titles AS (SELECT item_id, trim(translate(CASE item_id % 3 WHEN 0 THEN title WHEN 1 THEN title || ' — Globes News' ELSE 'שלום “' || title || '” | a b c d e f' END, '’‘“”״׳ךםןףץ', @Q@)) AS t FROM items)""".replace("@Q@", "'" + "''" * 2 + '"' * 3 + "''" + "כמנפצ'")


def titles(spark, d):
    k = F.col("item_id")
    t = F.when(k % 3 == 0, F.col("title")).when(k % 3 == 1, F.concat("title", F.lit(" — Globes News"))).otherwise(F.concat(F.lit("שלום “"), "title", F.lit("” | a b c d e f")))
    return views.items(spark, d).select("item_id", t.alias("title"))


@query("normalize_title", f"WITH {ITEMS}, {TITLES} SELECT item_id, {TITLE_SQL} AS title FROM titles")
def _(spark, d):
    return titles(spark, d).select("item_id", N.normalize_title(F.col("title")).alias("title"))


@query("detect_lang", rf"""WITH {ITEMS}, t AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN repeat('שלום ', 200) || snippet ELSE snippet END AS x FROM items)
SELECT item_id, CASE WHEN length(regexp_replace(x, '[^֐-׿]', '', 'g')) > 0.3 * length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) THEN 'he' ELSE 'en' END AS lang FROM t""")
def _(spark, d):
    text = F.when(F.col("item_id") % 5 == 0, F.concat(F.repeat(F.lit("שלום "), F.lit(200)), "snippet")).otherwise(F.col("snippet"))
    return views.items(spark, d).select("item_id", N.detect_lang(text).alias("lang"))


@query("simhash64")
def _(spark, d):
    return widened(views.items(spark, d)).select("item_id", N.simhash64("snippet").alias("hash"))


@query("simhash_pairs")
def _(spark, d):
    hashed = kept(widened(views.items(spark, d)).select(F.col("item_id").alias("id"), N.simhash64("snippet").alias("hash")), f"{shared(spark)}/simhash")
    return N.hamming_pairs(hashed)


@query("title_similarity")
def _(spark, d):
    i = views.items(spark, d).select("ticker", "item_id", "published_at", N.normalize_title(F.col("title")).alias("title"))
    pairs = N.earlier_within(i, 3)
    t = i.select("item_id", "title")
    both = pairs.join(t, "item_id").join(t.select(F.col("item_id").alias("other_id"), F.col("title").alias("other")), "other_id")
    return both.select("item_id", "other_id", F.round(N.token_set_ratio("title", "other"), 4).alias("ratio"))


@query("cluster_assign")
def _(spark, d):
    i = widened(views.items(spark, d)).select(
        "ticker", "item_id", "published_at", F.when(F.col("item_id") % 40 == 0, "filing").otherwise("news").alias("kind"), F.substring(F.sha2(F.col("snippet").cast("binary"), 256), 1, 40).alias("url_hash"),
        N.normalize_title(F.col("title")).alias("title"), N.simhash64("snippet").alias("hash"))
    return N.cluster_in_order(i)


KINDS = "CASE item_id % 9 WHEN 0 THEN 'filing' WHEN 1 THEN 'wire' ELSE 'news' END"


def kinds(spark, d):
    k = F.col("item_id")
    return views.items(spark, d).withColumns({
        "cluster_id": F.expr("(item_id * 7) % 1000"), "kind": F.when(k % 9 == 0, "filing").when(k % 9 == 1, "wire").otherwise("news"),
        "publisher": F.concat(F.lit(" Pub"), (k % 6).cast("string")), "sentiment": F.when(k % 5 != 0, (k % 21 - 10) / 10.0)})


@query("cluster_rollup", f"""WITH {ITEMS}, c AS (SELECT *, (item_id * 7) % 1000 AS cluster_id, {KINDS} AS kind, ' Pub' || (item_id % 6) AS publisher, CASE WHEN item_id % 5 <> 0 THEN (item_id % 21 - 10) / 10.0::DOUBLE END AS sentiment FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE kind WHEN 'filing' THEN 0 WHEN 'wire' THEN 1 ELSE 2 END, published_at, item_id) AS k FROM c)
SELECT cluster_id, max(item_id) FILTER (k = 1) AS canonical, min(published_at) AS first_seen, max(published_at) AS last_seen, count(*) AS n_items, count(DISTINCT lower(trim(publisher))) AS n_publishers, round(avg(sentiment), 9) AS sentiment FROM r GROUP BY 1""")
def _(spark, d):
    return rounded(N.rollup(kinds(spark, d)), "sentiment", digits=9)


@query("source_tier", f"""WITH {ITEMS}, k AS (SELECT item_id, {KINDS} AS kind, CASE item_id % 5 WHEN 0 THEN 'Reuters UK' WHEN 1 THEN ' Globes ' WHEN 2 THEN 'Some Blog' WHEN 3 THEN '' END AS publisher, CASE WHEN item_id % 2 = 0 THEN 'massive' ELSE 'rss' END AS src FROM items)
SELECT item_id, CASE WHEN kind <> 'news' THEN 1.0 WHEN publisher IN ('Reuters UK', ' Globes ') THEN 0.7 WHEN src = 'massive' AND publisher = 'Some Blog' THEN 0.55 ELSE 0.4 END::DOUBLE AS tier FROM k""")
def _(spark, d):
    k = F.col("item_id")
    publisher = F.when(k % 5 == 0, "Reuters UK").when(k % 5 == 1, " Globes ").when(k % 5 == 2, "Some Blog").when(k % 5 == 3, "")
    return kinds(spark, d).select("item_id", N.source_tier(F.col("kind"), publisher, F.when(k % 2 == 0, "massive").otherwise("rss")).cast("double").alias("tier"))


FORMS = ["8-K", "8-K/A", "10-K", "4", "SC 13G/A", "S-1", None]
FORM_ITEMS = [["2.02", "9.01"], ["7.01"], ["9.01"], None]


@query("filing_weight", """WITH f AS (SELECT o_orderkey, ['8-K', '8-K/A', '10-K', '4', 'SC 13G/A', 'S-1', NULL][o_orderkey % 7 + 1] AS form, o_orderkey % 4 AS i, o_custkey % 3 * 10000 AS size FROM orders)
SELECT o_orderkey, CASE WHEN form IS NULL THEN 0 WHEN form LIKE '8-K%' THEN CASE i WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.4 END WHEN form = '10-K' THEN 0.8 WHEN form = '4' THEN least(0.8, 0.4 + least(0.4, size / 100000.0)) WHEN form = 'SC 13G/A' THEN 0.4 ELSE 0.3 END::DOUBLE AS weight FROM f""")
def _(spark, d):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]) for v in values]), (i + 1).cast("int"))
    k = F.col("o_orderkey")
    return views.table(spark, d, "orders").select("o_orderkey", N.filing_weight(pick(FORMS, k % 7), pick(FORM_ITEMS, k % 4), F.col("o_custkey") % 3 * 10000).alias("weight"))


@query("importance", f"""WITH {BARS}, {EVENTS}, {REACTION}, i AS (SELECT event_id, event_id % 12 AS pubs, [0.4, 0.55, 0.7, 1.0][event_id % 4 + 1]::DOUBLE AS tier, CASE WHEN known THEN round(least(1, (rz + greatest(0, vz)) / 6), 3) ELSE 0 END AS market,
[0, 0.5, 1.0][event_id % 3 + 1]::DOUBLE AS filing, CASE WHEN event_id % 5 <> 0 THEN (event_id % 21 - 10) / 10.0::DOUBLE END AS sentiment FROM z)
SELECT event_id, greatest(0, least(100, round_even(100 * (25 * round(least(1, ln(1 + pubs) / ln(9)), 3) + 20 * tier + 25 * market + 20 * filing + 10 * round(least(1, abs(coalesce(sentiment, 0))), 3)) / 100, 0)))::INT AS importance FROM i""")
def _(spark, d):
    k = F.col("event_id")
    at = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i + 1).cast("int"))
    r = E.market_reaction(ticker_events(spark, d), views.bars(spark, d))
    return r.select("event_id", N.importance(k % 12, at([0.4, 0.55, 0.7, 1.0], k % 4), F.col("score"), at([0, 0.5, 1.0], k % 3), F.when(k % 5 != 0, (k % 21 - 10) / 10.0)).alias("importance"))


@query("daily_news_stats", f"WITH {ITEMS} SELECT ticker, published_at::DATE AS day, count(*) AS n, round(avg(CASE WHEN item_id % 5 <> 0 THEN (item_id % 21 - 10) / 10.0::DOUBLE END), 9) AS sentiment FROM items GROUP BY 1, 2")
def _(spark, d):
    return rounded(N.daily_stats(kinds(spark, d)), "sentiment", digits=9)


@query("news_rail", f"""WITH {ITEMS}, k AS (SELECT *, (item_id * 7) % 1000 AS cluster_id, item_id % 3 = 0 AS read, CASE WHEN item_id % 5 <> 0 THEN (item_id % 21 - 10) / 10.0::DOUBLE END AS sentiment FROM items),
h AS (SELECT ticker, date_trunc('hour', published_at) AS hour, count(*) AS n, avg(sentiment) AS s FROM k GROUP BY 1, 2), b AS (SELECT ticker, sum(n)::BIGINT AS n, count(*) AS hours, max(n) AS busiest, round(avg(s), 9) AS sentiment FROM h GROUP BY 1),
u AS (SELECT ticker, count(DISTINCT cluster_id) FILTER (NOT read) AS unread FROM k GROUP BY 1) SELECT * FROM b JOIN u USING (ticker)""")
def _(spark, d):
    return rounded(N.rail(kinds(spark, d).withColumn("read", F.col("item_id") % 3 == 0)), "sentiment", digits=9)


@query("source_counts", f"WITH {ITEMS} SELECT source_id, count(*) AS n, count(DISTINCT ticker) AS tickers FROM items GROUP BY 1")
def _(spark, d):
    return views.items(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"))


@query("news_feed_filter", f"WITH {ITEMS} SELECT item_id, ticker FROM items WHERE lang = 'en' AND snippet ILIKE '%the%' AND ticker IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(spark, d):
    held = views.table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return views.items(spark, d).where("lang = 'en'").where(F.col("snippet").ilike("%the%")).join(held, "ticker", "left_semi").select("item_id", "ticker")


ALIASES = [("S1", "the", 0.7), ("S2", "of", 0.6), ("S3", "de", 0.5)]


@query("entity_link", f"""WITH {ITEMS}, w AS (SELECT DISTINCT item_id, unnest(string_split_regex(regexp_replace(lower(title), '[^a-z0-9$ ]+', ' ', 'g'), ' +')) AS word FROM items),
a AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{a}', {w})" for t, a, w in ALIASES)}) t(ticker, alias, weight))
SELECT item_id, ticker, max(score) AS score FROM (SELECT item_id, ticker, weight::DOUBLE AS score FROM w JOIN a ON word = alias UNION ALL SELECT item_id, upper(substring(word, 2)), 0.9 FROM w WHERE regexp_full_match(word, '\\$[a-z]{{1,5}}')) GROUP BY 1, 2""")
def _(spark, d):
    return N.entity_links(views.items(spark, d), spark.createDataFrame(ALIASES, "ticker string, alias string, weight double"))


LEXICON = [("the", 1.0), ("on", -1.0), ("la", 0.5)]


@query("heuristic_sentiment", f"""WITH {ITEMS}, w AS (SELECT item_id, unnest(x) AS word, generate_subscripts(x, 1) AS place FROM (SELECT item_id, string_split_regex(lower(title), '[^\\p{{L}}]+') AS x FROM items)),
n AS (SELECT *, coalesce(lag(word) OVER (PARTITION BY item_id ORDER BY place) IN ('of', 'de'), false) AS neg FROM w), l AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {p})" for a, p in LEXICON)}) t(word, polarity)),
s AS (SELECT item_id, sum(CASE WHEN neg THEN -polarity ELSE polarity END)::DOUBLE AS s, count(*) AS hits FROM n JOIN l USING (word) GROUP BY 1) SELECT item_id, round(greatest(-1, least(1, s / sqrt(hits) / 1.5)), 6) AS sentiment, hits FROM s""")
def _(spark, d):
    return rounded(N.sentiment(views.items(spark, d), spark.createDataFrame(LEXICON, "word string, polarity double"), ["of", "de"]), "sentiment")


@query("search", f"WITH {ITEMS} SELECT item_id FROM items WHERE contains(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), 'the') ORDER BY item_id LIMIT 20")
def _(spark, d):
    return N.search(views.items(spark, d), "title", "the", 20).select("item_id")


@query("peer_ranking", """WITH t AS (SELECT c_nationkey AS n, c_acctbal AS cap FROM customer WHERE c_custkey = 1) SELECT c_custkey FROM customer, t WHERE c_custkey <> 1 AND c_acctbal BETWEEN 0.2 * cap AND 5 * cap ORDER BY (c_nationkey = n)::INT DESC, c_acctbal DESC, c_custkey LIMIT 10""")
def _(spark, d):
    c = views.table(spark, d, "customer")
    me = c.where("c_custkey = 1").select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("cap"))
    return c.where("c_custkey <> 1").join(F.broadcast(me), F.col("c_acctbal").between(0.2 * F.col("cap"), 5 * F.col("cap"))).orderBy(
        (F.col("c_nationkey") == F.col("n")).cast("int").desc(), F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey")


@query("movers", f"""WITH {BARS}, r AS (SELECT ticker, ts, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS chg FROM bars) SELECT ticker, ts, round(chg, 6) AS chg FROM r WHERE chg IS NOT NULL ORDER BY abs(r.chg) DESC, ticker, ts LIMIT 10""")
def _(spark, d):
    w = Window.partitionBy("ticker").orderBy("ts")
    r = views.bars(spark, d).select("ticker", "ts", (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("chg")).where("chg IS NOT NULL")
    return rounded(r.orderBy(F.abs("chg").desc(), "ticker", "ts").limit(10), "chg")


@query("union_all", "SELECT s_suppkey AS id, s_acctbal AS bal, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer")
def _(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return s.unionByName(c, allowMissingColumns=True)


@query("key_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(views.table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("llm_budget", "SELECT date_trunc('month', ts)::TIMESTAMP AS month, event_type AS purpose, sum(value::DECIMAL(18,4))::DOUBLE AS spent, count(*) AS calls FROM events GROUP BY 1, 2")
def _(spark, d):
    return views.table(spark, d, "events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), F.col("event_type").alias("purpose")).agg(
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("spent"), F.count("*").alias("calls"))
