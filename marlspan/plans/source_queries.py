"""Queries of source texts, lookups and relative valuation. Texts are made of the
driver's tables as the sources tell them, and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspan.operators import lookup as L
from marlspan.operators import valuation as V
from marlspan.sources import files, parsers, views
from marlspan.sources.views import BARS, OBS

from .registry import Register
from .series_queries import rounded
from .statement_queries import STATEMENT, statements

reg = Register()
query = reg.query


def iso(c: str):  # noqa: ANN201
    return F.date_format(c, "yyyy-MM-dd")


def texts(df, rows, shape) -> object:  # noqa: ANN001
    """One JSON text per series, the rows nested as ``shape`` says."""
    return df.groupBy("series_id").agg(F.to_json(shape(F.collect_list(rows))).alias("json"))


@query("fred_json", f"WITH {OBS} SELECT series_id, ts, round(value, 2) AS value FROM obs WHERE day(ts) <> 13")
def _(spark, d):
    o = views.observations(spark, d)
    told = F.when(F.dayofmonth("ts") == 13, ".").otherwise(F.round("value", 2).cast("decimal(18,2)").cast("string"))
    return parsers.dotted_json(texts(o, F.struct(iso("ts").alias("date"), told.alias("value")), lambda r: F.struct(r.alias("observations"))))


@query("boi_csv", f"WITH {OBS}, m AS (SELECT series_id, date_trunc('month', ts)::TIMESTAMP AS ts, round(max(value), 2) AS value FROM obs GROUP BY 1, 2) SELECT * FROM m WHERE month(ts) <> 7")
def _(spark, d):
    o = views.observations(spark, d).groupBy("series_id", F.date_trunc("month", "ts").alias("m")).agg(F.round(F.max("value"), 2).cast("decimal(18,2)").cast("string").alias("v"))
    when = F.when(F.month("m") % 3 == 1, F.concat(F.year("m").cast("string"), F.lit("-Q"), F.quarter("m").cast("string"))).otherwise(F.date_format("m", "yyyy-MM"))
    line = F.concat_ws(",", F.lit("BOI"), when, F.when(F.month("m") == 7, "NaN").otherwise(F.col("v")), F.lit("x"))
    csv = o.groupBy("series_id").agg(F.concat(F.lit("FLOW,TIME_PERIOD,OBS_VALUE,NOTE\n"), F.array_join(F.collect_list(line), "\n")).alias("csv"))
    return parsers.headed_csv(csv, ["TIME_PERIOD", "TIME"], "OBS_VALUE")


@query("cbs_json", f"WITH {OBS} SELECT series_id, date_trunc('month', ts)::TIMESTAMP AS ts, arg_max(round(value, 2), ts) AS value FROM obs GROUP BY 1, 2")
def _(spark, d):
    o = views.observations(spark, d).withColumn("v", F.round("value", 2))
    row = F.struct(F.col("ts").alias("at"), F.year("ts").alias("year"), F.month("ts").alias("month"), F.lit(0.5).alias("percent"), F.struct(F.col("v").alias("value")).alias("currBase"))
    sorted_rows = lambda r: F.struct(F.array(F.struct(F.transform(F.sort_array(r), lambda x: x.dropFields("at")).alias("date"))).alias("month"))
    return parsers.price_blocks_json(texts(o, row, sorted_rows))


@query("ons_json", f"""WITH {OBS}, k AS (SELECT *, ascii(series_id) % 3 AS k FROM obs) SELECT series_id, CASE k WHEN 0 THEN '1mo' WHEN 1 THEN '1q' ELSE '1y' END AS freq,
date_trunc(CASE k WHEN 0 THEN 'month' WHEN 1 THEN 'quarter' ELSE 'year' END, ts)::TIMESTAMP AS ts, round(max(value), 2) AS value FROM k GROUP BY 1, 2, 3""")
def _(spark, d):
    o, k = views.observations(spark, d), F.ascii("series_id") % 3
    layer = lambda unit, pattern, extra="": o.groupBy("series_id", F.date_trunc(unit, "ts").alias("t")).agg(F.round(F.max("value"), 2).alias("v")).groupBy("series_id").agg(
        F.collect_list(F.struct(F.expr(pattern).alias("date"), F.col("v").cast("decimal(18,2)").cast("string").alias("value"))).alias(unit))
    m, q, y = layer("month", "upper(date_format(t, 'yyyy MMM'))"), layer("quarter", "concat(year(t), ' Q', quarter(t))"), layer("year", "cast(year(t) AS string)")
    bad = F.array(F.struct(F.lit("bad").alias("date"), F.lit("1").alias("value")))
    both = m.join(q, "series_id").join(y, "series_id").select("series_id", F.to_json(F.struct(
        F.when(k == 0, F.col("month")).otherwise(bad).alias("months"), F.when(k <= 1, F.col("quarter")).alias("quarters"), F.col("year").alias("years"))).alias("json"))
    return parsers.layered_json(both)


@query("treasury_xml", f"WITH {OBS} SELECT ts::DATE AS day, unnest(['1m', '10y']) AS tenor, unnest([round(value / 10000, 2), round(value / 20000, 2)]) AS value FROM obs WHERE series_id = (SELECT min(series_id) FROM obs)")
def _(spark, d):
    o = views.observations(spark, d)
    first = o.groupBy().agg(F.min("series_id").alias("series_id"))
    number = lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string")
    entry = F.concat(F.lit("<entry><content><m:properties><d:NEW_DATE m:type=\"Edm.DateTime\">"), iso("ts"), F.lit("T00:00:00</d:NEW_DATE><d:BC_1MONTH>"), number(F.col("value") / 10000),
                     F.lit("</d:BC_1MONTH><d:BC_2MONTH m:null=\"true\"></d:BC_2MONTH><d:BC_10YEAR>"), number(F.col("value") / 20000), F.lit("</d:BC_10YEAR></m:properties></content></entry>"))
    xml = o.join(F.broadcast(first), "series_id", "left_semi").groupBy(F.year("ts").alias("y")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("xml"))
    return parsers.curve_xml(xml)


ICS = """ics AS (SELECT o_orderkey % 7 AS source, o_orderkey AS id, 'Release, part; ' || o_orderkey AS title, o_orderdate::TIMESTAMP + to_minutes((o_custkey % 1440)::BIGINT) AS ts, o_custkey % 3 AS k FROM orders)"""


@query("ics_parse", f"""WITH {ICS} SELECT source, title AS summary, CASE k WHEN 0 THEN ts WHEN 1 THEN (ts AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')::TIMESTAMP
ELSE ((date_trunc('day', ts) + INTERVAL 510 MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')::TIMESTAMP END AS ts FROM ics""")
def _(spark, d):
    k = F.col("o_custkey") % 3
    o = views.table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_custkey") % 1440).cast("int")))
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    start = F.when(k == 0, F.concat(F.lit("DTSTART:"), stamp, F.lit("Z"))).when(k == 1, F.concat(F.lit("DTSTART;TZID=US-Eastern:"), stamp)).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("ts", "yyyyMMdd")))
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:Release\\, pa\r\n rt\\; "), F.col("o_orderkey").cast("string")), start, F.lit("END:VEVENT"))
    raw = o.groupBy((F.col("o_orderkey") % 7).alias("source")).agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.collect_list(event), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("ics"))
    return parsers.calendar_text(raw)


@query("ics_export", f"WITH {ICS} SELECT source, title AS summary, ts FROM ics")
def _(spark, d):
    o = views.table(spark, d, "orders").select(
        (F.col("o_orderkey") % 7).alias("source"), F.col("o_orderkey").alias("id"), F.concat(F.lit("Release, part; "), F.col("o_orderkey").cast("string")).alias("title"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_custkey") % 1440).cast("int"))).alias("ts"), F.lit("kind: x\nperiod: -").alias("note"))
    return parsers.calendar_text(parsers.to_calendar(o, "source"))  # written, and read back


@query("csv_export", f"WITH {OBS} SELECT ts, round(value, 2) AS value FROM obs")
def _(spark, d):
    o = views.observations(spark, d).select(iso("ts").alias("date"), F.round("value", 2).cast("decimal(18,2)").alias("value"))
    return files.parse_csv_lines(o.select(F.concat_ws(",", "date", "value").alias("value")))


@query("sec_submissions", """SELECT c_custkey AS cik, ['8-K', '10-K', '4'][o_orderkey % 3 + 1] AS form, '00-' || o_orderkey AS accession, o_orderdate::DATE AS filed, CASE WHEN o_orderkey % 3 = 0 THEN ['2.02', '9.01'] ELSE [] END AS items, o_orderkey % 1000 AS size,
'https://www.sec.gov/Archives/edgar/data/' || c_custkey || '/00' || o_orderkey || '/' || CASE WHEN o_orderkey % 5 = 0 THEN '00-' || o_orderkey || '-index.htm' ELSE 'd.htm' END AS url FROM orders JOIN customer ON o_custkey = c_custkey""".replace("['2.02', '9.01'] ELSE [] END", "'2.02|9.01' ELSE '' END"))
def _(spark, d):
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer")
    k = F.col("o_orderkey")
    x = o.join(c, o.o_custkey == c.c_custkey).select("c_custkey", F.struct(
        F.element_at(F.array(F.lit("8-K"), F.lit("10-K"), F.lit("4")), (k % 3 + 1).cast("int")).alias("form"), F.concat(F.lit("00-"), k.cast("string")).alias("a"), iso("o_orderdate").alias("f"),
        F.when(k % 5 == 0, "").otherwise("d.htm").alias("p"), F.when(k % 3 == 0, "2.02, 9.01").otherwise("").alias("i"), (k % 1000).alias("s")).alias("r"))
    rows = x.groupBy(F.col("c_custkey").alias("cik")).agg(F.collect_list("r").alias("r"))
    side = lambda f, n: F.transform("r", lambda e: e[f]).alias(n)
    recent = F.struct(side("form", "form"), side("a", "accessionNumber"), side("f", "filingDate"), side("p", "primaryDocument"), side("i", "items"), side("s", "size"), side("f", "acceptanceDateTime"))
    got = parsers.submissions(rows.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json")))
    return got.withColumn("items", F.array_join("items", "|"))


@query("wire_feed", """SELECT o_custkey AS source, 'News & more ' || o_orderkey AS title, 'https://w.example/' || o_orderkey AS url, o_orderdate::TIMESTAMP + INTERVAL 9 HOUR AS published_at, CASE WHEN o_orderkey % 2 = 0 THEN 'ABC' || o_orderkey % 10 ELSE '' END AS tickers FROM orders""".replace("'ABC' || o_orderkey % 10", "'AB' || ['C', 'D', 'E'][o_orderkey % 3 + 1]"))
def _(spark, d):
    k = F.col("o_orderkey")
    ticker = F.concat(F.lit("Nasdaq: AB"), F.element_at(F.array(F.lit("c"), F.lit("d"), F.lit("e")), (k % 3 + 1).cast("int")))
    item = F.concat(F.lit("<item><title><![CDATA[News & more "), k.cast("string"), F.lit("]]></title><link>https://w.example/"), k.cast("string"), F.lit("</link><pubDate>"),
                    F.date_format(F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 9 hours"), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><category>Earnings</category>"),
                    F.when(k % 2 == 0, F.concat(F.lit("<category domain=\"x\">"), ticker, F.lit("</category>"))).otherwise(""), F.lit("</item>"))
    raw = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("xml"))
    return parsers.feed_xml(raw).withColumn("tickers", F.array_join("tickers", ","))


@query("vendor_sentiment", """WITH o AS (SELECT o_custkey % 20 AS source_id, o_orderkey AS k, o_orderdate::TIMESTAMP AS published_at FROM orders)
SELECT source_id, 'pub' AS publisher, 'T' || k AS title, 'u' || k AS url, published_at, k % 100 / 100.0::DOUBLE AS sentiment, CASE WHEN k % 4 < 2 THEN 'AAA' END AS ticker, CASE WHEN k % 4 < 2 THEN 0.5::DOUBLE END AS relevance, CASE WHEN k % 4 < 2 THEN k % 4 / 4.0::DOUBLE END AS ticker_sentiment FROM o
UNION ALL SELECT source_id, 'pub', 'T' || k, 'u' || k, published_at, k % 100 / 100.0::DOUBLE, 'BBB', 0.15, 0.0 FROM o WHERE k % 4 = 1""")
def _(spark, d):
    k = F.col("o_orderkey")
    t = lambda name, rel, score: F.struct(F.lit(name).alias("ticker"), F.lit(rel).alias("relevance_score"), score.cast("string").alias("ticker_sentiment_score"))
    tickers = F.when(k % 4 == 0, F.array(t("aaa", "0.5", k % 4 / 4), t("CRYPTO:X", "0.9", F.lit(1)))).when(k % 4 == 1, F.array(t("AAA", "0.5", k % 4 / 4), t("bbb", "0.15", F.lit("none")))) \
        .when(k % 4 == 2, F.array(t("CCC", "0.1499", F.lit(1))))
    row = F.struct(F.concat(F.lit("T"), k.cast("string")).alias("title"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss").alias("time_published"),
                   F.lit("pub").alias("source"), (k % 100 / 100.0).alias("overall_sentiment_score"), tickers.alias("ticker_sentiment"))
    raw = views.table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("source_id")).agg(F.to_json(F.struct(F.collect_list(row).alias("feed"))).alias("json"))
    return parsers.scored_json(raw)


@query("tone_timeline", f"WITH {OBS} SELECT series_id, ts, round(value, 2) AS value FROM obs")
def _(spark, d):
    o = views.observations(spark, d)
    point = F.struct(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("date"), F.round("value", 2).alias("value"))
    line = lambda name, data: F.struct(F.lit(name).alias("series"), data.alias("data"))
    return parsers.timeline_json(texts(o, point, lambda r: F.struct(F.array(line("Average Tone", r), line("Other", F.slice(r, 1, 3))).alias("timeline"))))


@query("plain_number", """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN -(c_custkey + 1000)::DOUBLE WHEN 1 THEN c_custkey + 0.5::DOUBLE WHEN 2 THEN 0 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN -c_custkey::DOUBLE ELSE NULL END AS value,
CASE c_custkey % 4 WHEN 0 THEN c_custkey / 10.0::DOUBLE WHEN 1 THEN c_custkey ELSE -c_custkey END::DOUBLE AS number, CASE c_custkey % 4 WHEN 0 THEN '%' WHEN 1 THEN 'k' WHEN 2 THEN 'bn' END AS unit FROM customer""")
def _(spark, d):
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    cell = F.when(k % 7 == 0, F.concat(F.lit("$ ("), F.format_number(k + 1000, 0), F.lit(")"))).when(k % 7 == 1, F.concat(t, F.lit(".5"))).when(k % 7 == 2, "—").when(k % 7 == 3, F.concat(t, F.lit("%"))) \
        .when(k % 7 == 4, "Note 3a").when(k % 7 == 5, F.concat(F.lit("-"), t)).otherwise("")
    told = F.when(k % 4 == 0, F.concat((k / 10.0).cast("decimal(18,1)").cast("string"), F.lit("%"))).when(k % 4 == 1, F.concat(t, F.lit("K"))).when(k % 4 == 2, F.concat(F.lit("-"), t, F.lit("B"))).otherwise(F.concat(F.lit("-"), t))
    s = parsers.suffixed(told)
    return views.table(spark, d, "customer").select("c_custkey", parsers.plain_number(cell).alias("value"), s["value"].alias("number"), s["unit"].alias("unit"))


# --- lookups

NAMES = """names AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'The ' || word || ' Holdings, Inc.' WHEN 1 THEN word || ' ' || word2 || ' Ltd' WHEN 2 THEN 'First ' || word || ' Co' ELSE word || ' Corp.' END AS name, word, word2 FROM
  (SELECT c_custkey, 'acme' || (c_custkey % 100) AS word, ['rail', 'bank', 'oil'][c_custkey % 3 + 1] AS word2 FROM customer))"""


def names(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    word, word2 = F.concat(F.lit("acme"), (k % 100).cast("string")), F.element_at(F.array(F.lit("rail"), F.lit("bank"), F.lit("oil")), (k % 3 + 1).cast("int"))
    name = F.when(k % 4 == 0, F.concat(F.lit("The "), word, F.lit(" Holdings, Inc."))).when(k % 4 == 1, F.concat(word, F.lit(" "), word2, F.lit(" Ltd"))).when(k % 4 == 2, F.concat(F.lit("First "), word, F.lit(" Co"))) \
        .otherwise(F.concat(word, F.lit(" Corp.")))
    return views.table(spark, d, "customer").select("c_custkey", name.alias("name"))


@query("company_names", f"WITH {NAMES} SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN word WHEN 1 THEN word || ' ' || word2 WHEN 2 THEN 'first ' || word ELSE word END AS plain, lower(replace(replace(name, ',', ''), '.', '')) AS mention FROM names")
def _(spark, d):
    return names(spark, d).select("c_custkey", L.company_name(F.col("name")).alias("plain"), L.mention_text(F.col("name")).alias("mention"))


@query("derived_aliases", f"""WITH {NAMES} SELECT c_custkey AS ticker, unnest(CASE c_custkey % 4 WHEN 0 THEN [word] WHEN 1 THEN [word || ' ' || word2, word] WHEN 2 THEN ['first ' || word] ELSE [word, word || ' corp'] END) AS alias,
unnest(CASE c_custkey % 4 WHEN 1 THEN [1.0, 0.7] WHEN 3 THEN [1.0, 1.0] ELSE [1.0] END)::DOUBLE AS weight FROM names""")
def _(spark, d):
    return L.aliases(names(spark, d).withColumnRenamed("c_custkey", "ticker"))


KNOWN = [("us.cpi", "US", "CPI m/m", 1), ("us.cpi", "US", "Consumer Price Index", 1), ("us.core", "US", "Core Consumer Price Index", 2), ("il.cpi", "IL", "Consumer Price Index", 3), ("us.gdp", "US", "GDP", 4)]
ASKED = [("CPI m/m", "US", "us.cpi", True), ("Consumer Price Index (Prel)", "US", "us.cpi", True), ("Flash Consumer Price Index", "IL", "il.cpi", True), ("Core Consumer Price Index", "US", "us.core", True),
         ("Final GDP", "US", "us.final_gdp", False), ("GDP", "US", "us.gdp", True), ("R&D m/m (Aug)", "IL", "il.r_and_d_mom", False)]


@query("indicator_lookup", f"SELECT c_custkey AS id, name, country, event_key, found FROM customer JOIN (VALUES {', '.join(f'({i}, {n!r}, {c!r}, {e!r}, {f})' for i, (n, c, e, f) in enumerate(ASKED))}) t(i, name, country, event_key, found) ON c_custkey % {len(ASKED)} = i")
def _(spark, d):
    k = F.col("c_custkey") % len(ASKED)
    at = lambda j: F.element_at(F.array(*[F.lit(a[j]) for a in ASKED]), (k + 1).cast("int"))
    asked = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), at(0).alias("name"), at(1).alias("country"))
    return L.indicators(asked, spark.createDataFrame(KNOWN, "event_key string, country string, alias string, rank int"))


RULES = [("IS", "^(total )?(net )?(revenues|sales)$", "revenue", 1, 1), ("IS", "^cost of (revenues|sales|goods sold)", "cost_of_revenue", 2, 1), ("*", "^net (income|loss)", "net_income", 3, 1), ("CF", "^purchase of property", "capex", 1, -1)]
ROWS = [("IS", "Total net revenues (Note 3)", "revenue", 1), ("IS", "Cost of sales", "cost_of_revenue", 1), ("CF", "Net income (loss)*", "net_income", 1), ("CF", "Purchase of property, plant and equipment", "capex", -1), ("BS", "Purchase of property", None, None), ("BS", "", None, None)]


@query("label_match", f"SELECT c_custkey, field, sign FROM customer JOIN (VALUES {', '.join(f'({i}, {repr(f) if f else chr(78) + chr(85) + chr(76) + chr(76)}, {g if g else chr(78) + chr(85) + chr(76) + chr(76)})' for i, (_, _, f, g) in enumerate(ROWS))}) t(i, field, sign) ON c_custkey % {len(ROWS)} = i")
def _(spark, d):
    k = F.col("c_custkey") % len(ROWS)
    at = lambda j: F.element_at(F.array(*[F.lit(a[j]) for a in ROWS]), (k + 1).cast("int"))
    return L.labels(views.table(spark, d, "customer").select("c_custkey", at(0).alias("statement"), at(1).alias("label")), RULES).select("c_custkey", "field", "sign")


@query("symbol_search", """WITH s AS (SELECT 'C' || c_custkey AS ticker, CASE WHEN c_custkey % 3 = 0 THEN 'C1 Company ' || c_custkey WHEN c_custkey % 3 = 1 THEN 'Best C1 ' || c_custkey ELSE 'Other' END AS name FROM customer)
SELECT ticker, CASE WHEN lower(ticker) = 'c1' THEN 100 WHEN starts_with(lower(ticker), 'c1') THEN 80 - length(ticker) WHEN starts_with(lower(name), 'c1') THEN 60 WHEN contains(' ' || lower(name), ' c1') THEN 40 ELSE 0 END AS score FROM s
WHERE starts_with(lower(ticker), 'c1') OR contains(' ' || lower(name), ' c1') ORDER BY score DESC, length(ticker), ticker LIMIT 40""")
def _(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("C1 Company "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("Best C1 "), k.cast("string"))).otherwise("Other")
    return L.symbols(views.table(spark, d, "customer").select(F.concat(F.lit("C"), k.cast("string")).alias("ticker"), name.alias("name")), "c1", 40).select("ticker", "score")


# --- relative valuation

FIGURES = f"""{STATEMENT}, fg AS (SELECT *, shares_basic_weighted AS shares, CASE WHEN entity % 9 <> 8 THEN revenue / 500 END AS price, CASE WHEN entity % 4 <> 3 THEN entity % 5 / 20.0::DOUBLE - 0.05 END AS growth, CASE WHEN entity % 10 <> 4 THEN eps_diluted END AS eps0 FROM st),
f AS (SELECT *, operating_income + coalesce(depreciation_amortization, 0) AS fe, coalesce(eps0, net_income / nullif(shares, 0)) AS feps, coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) + coalesce(long_term_lease_liabilities, 0) - coalesce(cash_and_equivalents, 0) - coalesce(short_term_investments, 0) AS fd, coalesce(minority_interest, 0) AS fm FROM fg),
m AS (SELECT *, (price * shares + fd + fm) / nullif(fe, 0) AS ev_ebitda, (price * shares + fd + fm) / nullif(revenue, 0) AS ev_sales, CASE WHEN feps > 0 THEN price / feps END AS pe, price * shares / nullif(revenue, 0) AS ps, CASE WHEN total_equity > 0 THEN price * shares / total_equity END AS pb,
  CASE WHEN feps > 0 AND growth > 0 THEN price / feps / (growth * 100) END AS peg FROM f)"""


def figures(spark, d):  # noqa: ANN001, ANN201
    e = F.col("entity")
    return V.company_figures(statements(spark, d).withColumns({
        "shares": F.col("shares_basic_weighted"), "price": F.when(e % 9 != 8, F.col("revenue") / 500), "growth": F.when(e % 4 != 3, e % 5 / 20.0 - 0.05), "eps_diluted": F.when(e % 10 != 4, F.col("eps_diluted"))}))


@query("multiples", f"WITH {FIGURES} SELECT entity, period_end, ev_ebitda, ev_sales, pe, ps, pb, peg FROM m")
def _(spark, d):
    return V.multiples(figures(spark, d)).select("entity", "period_end", *V.METRICS)


STATS = """lg AS (UNPIVOT (SELECT entity, period_end, ev_ebitda, ev_sales, pe, ps, pb, peg FROM m) ON ev_ebitda, ev_sales, pe, ps, pb, peg INTO NAME metric VALUE x),
hs AS (SELECT entity, metric, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, count(*) AS n FROM lg WHERE x > 0 GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("history_multiples", f"WITH {FIGURES}, {STATS} SELECT entity, metric, p25, median, p75, n FROM hs")
def _(spark, d):
    return V.multiple_stats(V.multiples(figures(spark, d)), ["entity"])


PEERS = f"""{FIGURES}, {STATS}, lt AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS k FROM m), pl AS (UNPIVOT (SELECT entity, ev_ebitda, ev_sales, pe, ps, pb, peg FROM lt WHERE k = 1) ON ev_ebitda, ev_sales, pe, ps, pb, peg INTO NAME metric VALUE x),
pp AS (SELECT a.entity, p.entity AS peer FROM lt a JOIN lt p ON a.k = 1 AND p.k = 1 AND a.entity % 3 = p.entity % 3 AND a.entity <> p.entity),
ps AS (SELECT pp.entity, metric, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, count(*) AS n FROM pp JOIN pl ON pl.entity = pp.peer WHERE x > 0 GROUP BY 1, 2 HAVING count(*) >= 2)"""


def latest(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("entity").orderBy(F.desc("period_end"))
    return V.multiples(figures(spark, d)).withColumn("k", F.row_number().over(w)).where("k = 1")


def peer_stats(spark, d):  # noqa: ANN001, ANN201
    x = latest(spark, d)
    pairs = x.select("entity", (F.col("entity") % 3).alias("g")).join(x.select(F.col("entity").alias("peer"), (F.col("entity") % 3).alias("g")), "g").where("entity <> peer")
    return V.multiple_stats(pairs.select("entity", "peer").join(x.withColumnRenamed("entity", "peer"), "peer"), ["entity"])


@query("peer_multiples", f"WITH {PEERS} SELECT entity, metric, p25, median, p75, n FROM ps")
def _(spark, d):
    return peer_stats(spark, d)


def _implied(q: str) -> str:
    return f"""CASE metric WHEN 'ev_ebitda' THEN CASE WHEN fe > 0 THEN ({q} * fe - fd - fm) / shares END WHEN 'ev_sales' THEN ({q} * nullif(revenue, 0) - fd - fm) / shares WHEN 'pe' THEN CASE WHEN feps > 0 THEN {q} * feps END
WHEN 'ps' THEN {q} * nullif(revenue, 0) / shares WHEN 'pb' THEN CASE WHEN total_equity > 0 THEN {q} * total_equity / shares END ELSE CASE WHEN growth > 0 AND feps > 0 THEN {q} * growth * 100 * feps END END"""


@query("relative_value", f"""WITH {PEERS}, b AS (SELECT coalesce(p.entity, h.entity) AS entity, coalesce(p.metric, h.metric) AS metric, {', '.join(f"CASE WHEN p.metric IS NULL THEN h.{q} WHEN h.metric IS NULL THEN p.{q} ELSE (p.{q} + h.{q}) / 2 END AS {q}" for q in ('p25', 'median', 'p75'))}
FROM ps p FULL JOIN hs h ON p.entity = h.entity AND p.metric = h.metric), v AS (SELECT lt.entity, {_implied('b.p25')} AS lo, {_implied('b.median')} AS ba, {_implied('b.p75')} AS hi FROM lt JOIN b ON b.entity = lt.entity WHERE k = 1)
SELECT entity, round(quantile_cont(lo, 0.5), 6) AS low, round(quantile_cont(ba, 0.5), 6) AS base, round(quantile_cont(hi, 0.5), 6) AS high, count(*) AS n_metrics FROM v WHERE ba IS NOT NULL GROUP BY 1""")
def _(spark, d):
    stats = V.blended_stats(peer_stats(spark, d), V.multiple_stats(V.multiples(figures(spark, d)), ["entity"]), ["entity"])
    return rounded(V.relative_value(latest(spark, d).drop("k"), stats, ["entity"]), "low", "base", "high")


@query("football_field", """WITH r AS (SELECT s_suppkey AS ticker, 'dcf' AS method, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 0.8 END AS low, s_acctbal AS base, s_acctbal * 1.3 AS high FROM supplier UNION ALL
SELECT s_suppkey, 'multiples', s_acctbal * 1.1, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal * 1.05 END, NULL FROM supplier UNION ALL SELECT s_suppkey, 'range', 10, 20, 30 FROM supplier),
f AS (SELECT ticker, method, base, least(coalesce(low, base), coalesce(high, base)) AS low, greatest(coalesce(low, base), coalesce(high, base)) AS high FROM r WHERE base IS NOT NULL)
SELECT *, base / 100 - 1 AS upside, row_number() OVER (PARTITION BY ticker ORDER BY base DESC, method) AS place FROM f""")
def _(spark, d):
    s, b = views.table(spark, d, "supplier"), F.col("s_acctbal")
    k = F.col("s_suppkey")
    row = lambda m, low, base, high: F.struct(F.lit(m).alias("method"), low.cast("double").alias("low"), base.cast("double").alias("base"), high.cast("double").alias("high"))
    rows = F.array(row("dcf", F.when(k % 3 == 0, b * 0.8), b, b * 1.3), row("multiples", b * 1.1, F.when(k % 5 != 0, b * 1.05), F.lit(None)), row("range", F.lit(10), F.lit(20), F.lit(30)))
    return V.football_field(s.select(k.alias("ticker"), F.inline(rows)), F.lit(100.0))


@query("user_models", "SELECT c_custkey AS ticker, 'graham' AS model, CASE WHEN c_acctbal > 0 THEN sqrt(22.5 * c_acctbal * 4) END AS value FROM customer UNION ALL SELECT c_custkey, 'twice', c_acctbal * 2 FROM customer")
def _(spark, d):
    models = V.Models()
    models.add("graham", lambda x: x.withColumn("value", V.graham(F.col("eps"), F.lit(4.0))))
    models.add("twice", lambda x: x.withColumn("value", F.col("eps") * 2))
    models.add("broken", lambda x: x.withColumn("value", F.col("no_such_input")))
    return models.values(views.table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_acctbal").alias("eps")), ["ticker"])


@query("implied_margin", """WITH i AS (SELECT c_custkey AS ticker, 1000.0::DOUBLE AS revenue, 0.02::DOUBLE AS g, 0.08 + c_custkey % 5 / 100.0::DOUBLE AS wacc, 1.0 + c_custkey % 40 AS price FROM customer),
v AS (SELECT ticker, price, sum(1000 * pow(1.02, t) * 0.75 * 0.7 / pow(1 + wacc, t - 0.5)) + 1000 * pow(1.02, 10) * 0.75 * 0.7 * 1.02 / any_value(wacc - 0.02) / pow(1 + any_value(wacc), 10) AS per FROM i, (SELECT unnest(range(1, 11)) AS t) GROUP BY 1, 2)
SELECT ticker, CASE WHEN price * 100 + 50 BETWEEN -0.5 * per AND 0.8 * per THEN round((price * 100 + 50) / per, 8) END AS implied_margin FROM v""")
def _(spark, d):
    k = F.col("c_custkey")
    x = views.table(spark, d, "customer").select(
        k.alias("ticker"), F.lit(1000.0).alias("revenue"), F.lit(0.02).alias("growth"), F.lit(0.02).alias("terminal_growth"), F.lit(0.1).alias("margin"), F.lit(0.25).alias("tax"), F.lit(0.3).alias("reinvestment"),
        (0.08 + k % 5 / 100.0).alias("wacc"), F.lit(50.0).alias("net_debt"), F.lit(100.0).alias("shares"), (1.0 + k % 40).alias("price"))
    return V.implied_margin(x).select("ticker", F.round("implied_margin", 8).alias("implied_margin"))


@query("asof_year_end_multiples", f"""WITH {BARS}, e AS (SELECT ticker, make_date(y, 12, 31) AS d FROM (SELECT DISTINCT ticker FROM bars), (SELECT unnest(range(1995, 2000))::INT AS y)),
p AS (SELECT e.ticker, e.d, arg_max(close, ts) AS price FROM e JOIN bars b ON b.ticker = e.ticker AND b.ts::DATE BETWEEN e.d - 14 AND e.d GROUP BY 1, 2), m AS (SELECT ticker, price / 1000 AS pe FROM p)
SELECT ticker, quantile_cont(pe, 0.25) AS p25, quantile_cont(pe, 0.5) AS median, quantile_cont(pe, 0.75) AS p75 FROM m GROUP BY 1 HAVING count(*) >= 2""")
def _(spark, d):
    from marlspan.operators import series as S

    b = views.bars(spark, d).select("ticker", "ts", "close")
    ends = b.select("ticker").distinct().withColumn("ts", F.explode(F.array(*[F.lit(f"{y}-12-31").cast("timestamp_ntz") for y in range(1995, 2000)])))
    p = S.asof_within(ends, b, ["ticker"], "close", 14).where("close IS NOT NULL")
    return p.groupBy("ticker").agg(*V.quartiles(F.col("close") / 1000)).where("p25 IS NOT NULL")
