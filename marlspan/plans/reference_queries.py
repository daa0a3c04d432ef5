"""Queries of catalog, calendar, filing and composition operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspan.functions.stats import ratio
from marlspan.operators import reference as C
from marlspan.operators import series as S
from marlspan.operators import valuation as V
from marlspan.operators.news import strip_html
from marlspan.operators import layered as Y
from marlspan.sources import views
from marlspan.sources.views import BARS, FACTS, ITEMS, OBS

from .company_queries import INPUTS, _dcf_sql, inputs
from .registry import Register
from .series_queries import rounded

reg = Register()
query = reg.query


@query("catalog_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), '12') OR contains(lower(p_type), '12') OR contains(lower(p_brand), '12')")
def _(spark, d):
    p = views.table(spark, d, "part").withColumn("tags", F.array("p_brand"))
    return C.catalog_filter(p, "12", ["p_name", "p_type"], "tags").select("p_partkey")


@query("relative_since", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '2024-02-01' - to_hours(c_custkey % 48 + 1) WHEN 1 THEN TIMESTAMP '2024-02-01' - to_days((c_custkey % 9 + 1)::INT) ELSE TIMESTAMP '2024-01-15' END AS since FROM customer""")
def _(spark, d):
    c = views.table(spark, d, "customer")
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat((k % 48 + 1).cast("string"), F.lit("h"))).when(k % 3 == 1, F.concat((k % 9 + 1).cast("string"), F.lit("d"))).otherwise("2024-01-15 00:00:00")
    return c.select("c_custkey", C.since(text, F.lit("2024-02-01").cast("timestamp_ntz")).alias("since"))


@query("freshness_state", """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'paused' WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'never' WHEN c_custkey % 100 > 40 THEN 'late' ELSE 'ok' END AS state FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    return views.table(spark, d, "customer").select("c_custkey", C.freshness(F.when(k % 5 != 0, k % 100), k % 11 != 0, k % 7 == 0, F.lit(40)).alias("state"))


@query("symbol_class", """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '^GSPC' WHEN 1 THEN 'EURUSD=X' WHEN 2 THEN 'CL=F' WHEN 3 THEN 'TEVA.TA' ELSE 'AAPL' END AS s FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'index' WHEN 1 THEN 'fx' WHEN 2 THEN 'future' WHEN 3 THEN 'tase' ELSE 'us' END AS kind FROM s""")
def _(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in ("^GSPC", "EURUSD=X", "CL=F", "TEVA.TA", "AAPL")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return views.table(spark, d, "supplier").select("s_suppkey", C.symbol_class(s).alias("kind"))


@query("spec_guessers", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'percent') THEN 'pct' WHEN contains(lower(p_name), 'index') THEN 'index' WHEN contains(lower(p_name), 'dollar') THEN 'usd' WHEN contains(lower(p_name), 'part') THEN 'count' ELSE 'level' END AS unit FROM part")
def _(spark, d):
    return views.table(spark, d, "part").select("p_partkey", C.guess(F.col("p_name"), C.UNIT_HINTS, "level").alias("unit"))


@query("url_resolve", "SELECT page_id, CASE WHEN regexp_extract(url, 'example\\.(?:com|net|org)/(\\w+/\\d+)', 1) <> '' THEN 'example:' || regexp_extract(url, 'example\\.(?:com|net|org)/(\\w+/\\d+)', 1) END AS key FROM pages")
def _(spark, d):
    return views.table(spark, d, "pages").select("page_id", C.provider_key(F.col("url")).alias("key"))


@query("nth_weekday", """WITH m AS (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2024-12-01', INTERVAL 1 MONTH))::DATE AS month)
SELECT month, (month + ((9 - isodow(month)) % 7)::INT + 7)::DATE AS second_tuesday, (last_day(month) - ((isodow(last_day(month)) + 6) % 7)::INT)::DATE AS last_monday FROM m""")
def _(spark, d):
    m = spark.range(1).select(F.explode(F.sequence(F.lit("2020-01-01").cast("date"), F.lit("2024-12-01").cast("date"), F.expr("interval 1 month"))).alias("month"))
    return m.select("month", C.nth_weekday(F.col("month"), "TUE", 2).alias("second_tuesday"), C.last_weekday(F.col("month"), "MON").alias("last_monday"))


@query("local_ts", "SELECT event_id, (ts::TIMESTAMP AT TIME ZONE 'Asia/Jerusalem' AT TIME ZONE 'UTC')::TIMESTAMP AS utc FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", F.convert_timezone(F.lit("Asia/Jerusalem"), F.lit("UTC"), "ts").alias("utc"))


@query("period_from_text", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE year(o_orderdate)::VARCHAR END AS period FROM orders""")
def _(spark, d):
    o = views.table(spark, d, "orders")
    y = F.year("o_orderdate").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("GDP Q"), F.quarter("o_orderdate"), F.lit(" "), y)) \
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format("o_orderdate", "MMM"), F.lit(" "), y, F.lit(" CPI"))).otherwise(F.concat(F.lit("Year "), y))
    return o.select("o_orderkey", C.period_of(text).alias("period"))


@query("peers_effective", """SELECT n_nationkey, array_to_string(list_filter(list_distinct_ordered, lambda x: x <> 'n3' AND x <> 'n' || n_nationkey), ',') AS peers
FROM (SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN ['n1', 'n2', 'n3', 'n4'] ELSE ['n2', 'n1', 'n3', 'n4'] END AS list_distinct_ordered FROM nation)""")
def _(spark, d):
    pins = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("n1"), F.lit("n2"))).otherwise(F.array(F.lit("n2"), F.lit("n1")))
    auto = F.array(*[F.lit(x) for x in ("n1", "n2", "n3", "n4")])
    got = C.peers(pins, auto, F.array(F.lit("n3")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    return views.table(spark, d, "nation").select("n_nationkey", F.array_join(got, ",").alias("peers"))


@query("snap_instants", f"""WITH {FACTS}, p AS (SELECT DISTINCT entity, period_end FROM facts), i AS (SELECT c_nationkey AS entity, c_custkey, TIMESTAMP '1995-01-01' + to_days((c_custkey % 2000)::INT) AS ts FROM customer)
SELECT i.entity, c_custkey, ts, p.period_end AS snapped FROM i ASOF JOIN p ON i.entity = p.entity AND i.ts >= p.period_end""")
def _(spark, d):
    p = views.facts(spark, d).select("entity", "period_end").distinct()
    i = views.table(spark, d, "customer").select(F.col("c_nationkey").alias("entity"), "c_custkey", (
        F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 2000).cast("int"))).alias("ts"))
    return C.snap(i, p).select("entity", "c_custkey", "ts", "snapped")


@query("xbrl_concept_series", """WITH f AS (SELECT l_suppkey, l_shipdate::DATE AS e, l_shipdate::DATE - (80 + l_partkey % 30)::INT AS s, l_extendedprice AS v, l_orderkey * 1e6::DOUBLE + l_extendedprice AS filed FROM lineitem)
SELECT l_suppkey, e AS period_end, arg_min(v, filed) AS value FROM f WHERE e - s BETWEEN 80 AND 100 GROUP BY 1, 2""")
def _(spark, d):
    x = views.table(spark, d, "lineitem")
    end = F.col("l_shipdate").cast("date")
    f = x.select("l_suppkey", end.alias("period_end"), F.date_sub(end, (80 + F.col("l_partkey") % 30).cast("int")).alias("start"), F.col("l_extendedprice").alias("v"),
                 (F.col("l_orderkey") * 1e6 + F.col("l_extendedprice")).alias("filed"))
    return f.where(F.datediff("period_end", "start").between(80, 100)).groupBy("l_suppkey", "period_end").agg(F.min_by("v", "filed").alias("value"))


@query("dominant_unit", """WITH u AS (SELECT l_returnflag AS field, l_linestatus AS unit, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, unit) AS k FROM u) SELECT field, unit FROM k WHERE k = 1""")
def _(spark, d):
    u = views.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("unit")).agg(F.countDistinct("l_shipdate").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "unit")
    return u.withColumn("k", F.row_number().over(w)).where("k = 1").select("field", "unit")


@query("classify_filer", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'us_10k' WHEN 1 THEN 'foreign_20f' ELSE 'unknown' END AS filer FROM supplier")
def _(spark, d):
    forms = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("10-K"), F.lit("8-K"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("20-F"))).otherwise(F.array(F.lit("S-1")))
    return views.table(spark, d, "supplier").select("s_suppkey", C.classify_forms(forms).alias("filer"))


@query("assumption_resolve", """WITH g AS (SELECT s_nationkey AS entity, year(l_shipdate)::INT AS y, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
c AS (SELECT entity, y, r / nullif(lag(r) OVER (PARTITION BY entity ORDER BY y), 0) - 1 AS g FROM g), m AS (SELECT entity, quantile_cont(g, 0.5) AS growth, count(g) AS n FROM c WHERE y BETWEEN 1996 AND 1998 GROUP BY 1)
SELECT entity, round(CASE WHEN n >= 2 THEN greatest(-0.2, least(0.3, growth)) ELSE 0.03 END, 6) AS growth, CASE WHEN n >= 2 THEN 'history' ELSE 'default' END AS provenance FROM m""")
def _(spark, d):
    x, s = views.table(spark, d, "lineitem"), views.table(spark, d, "supplier")
    g = x.join(s, x.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("entity"), F.year("l_shipdate").alias("y")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("r"))
    c = g.withColumn("g", ratio(F.col("r"), F.lag("r").over(Window.partitionBy("entity").orderBy("y"))) - 1).where("y BETWEEN 1996 AND 1998")
    m = c.groupBy("entity").agg(F.percentile("g", 0.5).alias("growth"), F.count("g").alias("n"))
    known = F.col("n") >= 2
    return m.select("entity", F.round(F.when(known, F.greatest(F.lit(-0.2), F.least(F.lit(0.3), "growth"))).otherwise(0.03), 6).alias("growth"), F.when(known, "history").otherwise("default").alias("provenance"))


@query("assumption_diff", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'growth' ELSE 'margin,tax' END AS changed FROM supplier")
def _(spark, d):
    base = F.create_map(F.lit("growth"), F.lit(0.1), F.lit("margin"), F.lit(0.2))
    other = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("growth"), F.lit(0.2), F.lit("margin"), F.lit(0.2))).otherwise(
        F.create_map(F.lit("growth"), F.lit(0.1), F.lit("margin"), F.lit(0.3), F.lit("tax"), F.lit(0.25)))
    return views.table(spark, d, "supplier").select("s_suppkey", F.array_join(C.map_diff(base, other), ",").alias("changed"))


@query("assumption_checksum", """SELECT s_suppkey, left(sha256('{"k":' || s_suppkey || ',"n":"' || s_name || '"}'), 16) AS sum FROM supplier""")
def _(spark, d):
    return views.table(spark, d, "supplier").select("s_suppkey", C.checksum(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))).alias("sum"))


@query("scenarios", f"""WITH {INPUTS}, a AS (SELECT * REPLACE (growth + s.dg AS growth, margin + s.dg AS margin, wacc + s.dw AS wacc), s.name AS scenario FROM inp, (VALUES ('bear', -0.02::DOUBLE, 0.01::DOUBLE), ('base', 0.0, 0.0), ('bull', 0.02, -0.01)) s(name, dg, dw)),
{_dcf_sql('a', 'ticker, scenario')} SELECT ticker, scenario, round((pv + terminal - net_debt) / shares, 5) AS value FROM v""")
def _(spark, d):
    s = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(g).alias("dg"), F.lit(w).alias("dw")) for n, g, w in (("bear", -0.02, 0.01), ("base", 0.0, 0.0), ("bull", 0.02, -0.01))])
    x = inputs(spark, d).select("*", F.inline(s)).withColumns({"growth": F.col("growth") + F.col("dg"), "margin": F.col("margin") + F.col("dg"), "wacc": F.col("wacc") + F.col("dw")})
    return rounded(V.fcff(x, ["ticker", "scenario"]).drop("pv", "terminal"), "value", digits=5)


@query("external_model", f"WITH {INPUTS}, {_dcf_sql('inp', 'ticker')} SELECT ticker, round(CASE WHEN ticker % 4 = 0 THEN 42.0 ELSE (pv + terminal - net_debt) / shares END, 5) AS value FROM v")
def _(spark, d):
    v = V.fcff(inputs(spark, d), ["ticker"])
    return rounded(v.select("ticker", F.when(F.col("ticker") % 4 == 0, 42.0).otherwise(F.col("value")).alias("value")), "value", digits=5)


@query("first_print", f"""WITH {OBS}, p AS (SELECT series_id, ts, (value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY ts), 0) - 1) * 100 AS v FROM obs) SELECT series_id, max(ts) AS period, round(arg_max(v, ts), 6) AS last FROM p WHERE v IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return rounded(S.transform(views.observations(spark, d), "pct").groupBy("series_id").agg(F.max("ts").alias("period"), F.max_by("value", "ts").alias("last")), "last")


@query("known_accessions", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    return views.table(spark, d, "orders").join(views.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("profile_dual_listing", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def _(spark, d):
    n = views.table(spark, d, "nation")
    half = n.select("n_regionkey", F.col("n_nationkey").alias("a")).join(n.select("n_regionkey", F.col("n_nationkey").alias("b")), "n_regionkey").where("a < b").select("a", "b")
    return half.union(half.select("b", "a"))


@query("strip_html", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'),
'\s+', ' ', 'g')) AS text FROM pages""")
def _(spark, d):
    return views.table(spark, d, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query("relink_diff", f"""WITH {ITEMS}, o AS (SELECT item_id, ticker FROM items WHERE item_id % 3 <> 0), n AS (SELECT item_id, ticker FROM items WHERE item_id % 5 <> 0)
SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN o.item_id IS NULL THEN 'added' ELSE 'removed' END AS change FROM o FULL JOIN n ON o.item_id = n.item_id AND o.ticker = n.ticker WHERE o.item_id IS NULL OR n.item_id IS NULL""")
def _(spark, d):
    i = views.items(spark, d).select("item_id", "ticker")
    o, n = i.where("item_id % 3 <> 0").withColumn("old", F.lit(True)), i.where("item_id % 5 <> 0").withColumn("new", F.lit(True))
    return o.join(n, ["item_id", "ticker"], "full").where("old IS NULL OR new IS NULL").select("item_id", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"))


@query("enrichment_blend", f"WITH {ITEMS} SELECT item_id, round(0.5 * (item_id % 100) + 0.5 * coalesce(CASE WHEN item_id % 2 = 0 THEN 60.0 END, item_id % 100), 4) AS importance FROM items")
def _(spark, d):
    own = (F.col("item_id") % 100).cast("double")
    return views.items(spark, d).select("item_id", F.round(0.5 * own + 0.5 * F.coalesce(F.when(F.col("item_id") % 2 == 0, 60.0), own), 4).alias("importance"))


# --- nested assumptions in layers


def assumption_layers(spark, d):  # noqa: ANN001, ANN201
    """Three layers for each supplier: house defaults, a sector's, which may put a
    number in the place of an object, and a user's, which may put an object back."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    house = text('{"wacc":{"beta":1.1,"rf":0.04},"growth":{"near":', n, ',"far":2},"note":"house","none":null}')
    sector = F.when(k % 3 == 0, '{"wacc":9}').when(k % 3 == 1, '{"wacc":{"beta":1.3,"size":{"small":true}},"growth":{}}').otherwise('{"growth":{"near":[1,2]},"note":null}')
    user = F.when(k % 2 == 0, text('{"wacc":{"rf":', n, '},"name":"', F.col("s_name"), '"}')).otherwise("{}")
    s = views.table(spark, d, "supplier")
    return s.select("s_suppkey", F.posexplode(F.array(house, sector, user)).alias("layer", "json"))


@query("assumption_deep_merge", """SELECT s_suppkey, '{"growth":{"far":2,"near":' || CASE WHEN s_suppkey % 3 = 2 THEN '[1,2]' ELSE s_suppkey::VARCHAR END || '},' || CASE WHEN s_suppkey % 2 = 0 THEN '"name":"' || s_name || '",' ELSE '' END || '"note":"house","wacc":' ||
CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN '{"rf":' || s_suppkey || '}' ELSE '9' END ELSE '{"beta":' || CASE WHEN s_suppkey % 3 = 1 THEN '1.3' ELSE '1.1' END || ',"rf":' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE '0.04' END || CASE WHEN s_suppkey % 3 = 1 THEN ',"size":{"small":true}' ELSE '' END || '}' END || '}' AS json FROM supplier""")
def _(spark, d):
    return Y.deep_merge(assumption_layers(spark, d), ["s_suppkey"])


@query("assumption_deep_diff", """SELECT s_suppkey, path, before, after FROM (SELECT s_suppkey, unnest(CASE s_suppkey % 3 WHEN 0 THEN [('wacc', NULL, '9'), ('wacc.beta', '1.1', NULL), ('wacc.rf', '0.04', NULL), ('growth.near', s_suppkey::VARCHAR, NULL), ('growth.far', '2', NULL), ('note', '"house"', NULL)]
WHEN 1 THEN [('wacc.beta', '1.1', '1.3'), ('wacc.size.small', NULL, 'true'), ('wacc.rf', '0.04', NULL), ('growth.near', s_suppkey::VARCHAR, NULL), ('growth.far', '2', NULL), ('note', '"house"', NULL)]
ELSE [('growth.near', s_suppkey::VARCHAR, '[1,2]'), ('growth.far', '2', NULL), ('wacc.beta', '1.1', NULL), ('wacc.rf', '0.04', NULL), ('note', '"house"', NULL)] END) AS x FROM supplier) t, LATERAL (SELECT x[1] AS path, x[2] AS before, x[3] AS after)""")
def _(spark, d):
    layers = assumption_layers(spark, d)
    return Y.deep_diff(layers.where("layer = 0").drop("layer"), layers.where("layer = 1").drop("layer"), ["s_suppkey"])
