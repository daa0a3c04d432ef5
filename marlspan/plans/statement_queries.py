"""Queries of statements: facts from filings, periods, ratios, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspan.operators import statements as T
from marlspan.sources import views

from .registry import Register

reg = Register()
query = reg.query

BASE = """base AS (SELECT s_nationkey AS entity, date_trunc('quarter', l_shipdate)::DATE AS q_start, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE - 1 AS period_end,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS rev, sum((l_extendedprice * l_discount)::DECIMAL(18,4))::DOUBLE AS disc, sum((l_extendedprice * l_tax)::DECIMAL(18,4))::DOUBLE AS tax,
  sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""
#: Fields of the statements by SQL that both engines read; some are not reported by some entities.
FIELDS = {
    "revenue": "rev", "cost_of_revenue": "CASE WHEN entity % 5 <> 4 THEN rev * 0.6 + disc END", "gross_profit": "CASE WHEN entity % 4 = 1 THEN rev * 0.4 - disc * 1.01 END",
    "operating_income": "rev * 0.2 - disc * 2", "depreciation_amortization": "CASE WHEN entity % 6 <> 2 THEN tax * 0.5 END", "ebitda": "CASE WHEN entity % 7 = 3 THEN rev * 0.25 END",
    "net_income": "rev * 0.15 - disc * 2.5", "pretax_income": "rev * 0.19 - disc * 2.5", "income_tax_expense": "CASE WHEN entity % 8 <> 6 THEN tax * 0.9 END",
    "interest_expense": "CASE WHEN entity % 9 = 7 THEN 0.0 ELSE disc * 0.1 END", "stock_based_comp": "CASE WHEN entity % 3 = 2 THEN qty * 3 END", "eps_diluted": "(rev * 0.15 - disc * 2.5) / 1000",
    "cfo": "rev * 0.18 - tax", "cfi": "rev * -0.1", "cff": "rev * -0.05 + disc", "fx_effect": "CASE WHEN entity % 4 = 3 THEN tax * 0.01 END",
    "net_change_in_cash": "rev * 0.03 - tax + disc + CASE WHEN entity % 10 = 1 THEN rev * 0.01 ELSE 0 END", "capex": "CASE WHEN entity % 3 <> 1 THEN qty * 2 END", "fcf": "CASE WHEN entity % 8 = 5 THEN rev * 0.1 END",
    "total_assets": "rev * 4 + qty", "total_liabilities": "CASE WHEN entity % 3 = 0 THEN rev * 2.5 END", "total_equity": "rev * 1.5 + qty + CASE WHEN entity % 6 = 0 THEN rev * -0.2 ELSE 0 END",
    "minority_interest": "CASE WHEN entity % 12 = 0 THEN rev * 0.2 END", "cash_and_equivalents": "CASE WHEN entity % 11 <> 10 THEN rev * 0.3 + tax END", "short_term_investments": "CASE WHEN entity % 2 = 0 THEN rev * 0.1 END",
    "accounts_receivable": "rev * 0.5", "inventory": "CASE WHEN entity % 4 <> 2 THEN qty * 100 END", "accounts_payable": "rev * 0.25 + disc", "short_term_debt": "CASE WHEN entity % 5 <> 1 THEN rev * 0.4 END",
    "long_term_debt": "CASE WHEN entity % 7 <> 2 THEN rev * 0.9 - disc END", "long_term_lease_liabilities": "CASE WHEN entity % 6 = 4 THEN rev * 0.15 END", "total_current_assets": "rev * 1.5 + qty",
    "total_current_liabilities": "CASE WHEN entity % 13 <> 12 THEN rev * 1.1 + tax END", "retained_earnings": "rev * 0.8 - tax", "shares_outstanding": "CASE WHEN entity % 3 <> 2 THEN qty END", "shares_basic_weighted": "qty * 0.98",
}
STATEMENT = f"{BASE}, st AS (SELECT entity, q_start, period_end, {', '.join(f'({e})::DOUBLE AS {f}' for f, e in FIELDS.items())} FROM base)"


def base(spark, d):  # noqa: ANN001, ANN201
    x, s = views.table(spark, d, "lineitem"), views.table(spark, d, "supplier")
    q = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    total = lambda c, k: F.sum(c.cast(f"decimal(18,{k})")).cast("double")
    p = F.col("l_extendedprice")
    return x.join(s, x.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("entity"), q.alias("q_start")).agg(
        total(p, 2).alias("rev"), total(p * F.col("l_discount"), 4).alias("disc"), total(p * F.col("l_tax"), 4).alias("tax"), total(F.col("l_quantity"), 2).alias("qty"),
    ).withColumn("period_end", F.date_sub(F.add_months("q_start", 3), 1))


def statements(spark, d):  # noqa: ANN001, ANN201
    return base(spark, d).select("entity", "q_start", "period_end", *[F.expr(f"cast({e} AS double)").alias(f) for f, e in FIELDS.items()])


def some(*c: str) -> str:
    return f"CASE WHEN {' OR '.join(f'({x}) IS NOT NULL' for x in c)} THEN {' + '.join(f'coalesce({x}, 0)' for x in c)} END"


def _ratio_sql(where: str, back: int, ann: int, days: int) -> str:
    """All ratios over ``st``; ``p_`` names the year-ago row."""
    div = lambda a, b: f"({a}) / nullif({b}, 0)"
    mean = lambda a, b: f"CASE WHEN ({b}) IS NULL THEN {a} ELSE (({a}) + ({b})) / 2 END"
    debt = lambda p: some(f"{p}short_term_debt", f"{p}long_term_debt", f"{p}long_term_lease_liabilities")
    liquid = lambda p: f"coalesce({p}cash_and_equivalents, 0) + coalesce({p}short_term_investments, 0)"
    invested = lambda p: f"({some(f'{p}total_equity', f'{p}minority_interest')}) + coalesce({debt(p)}, 0) - ({liquid(p)})"
    gm = lambda p: f"coalesce({p}gross_profit, {p}revenue - {p}cost_of_revenue) / nullif({p}revenue, 0)"
    share = lambda a, b, p: f"{p}{a} / nullif({p}{b}, 0)"
    sh = lambda p: f"coalesce({p}shares_outstanding, {p}shares_basic_weighted)"
    lev = lambda p: f"coalesce({p}long_term_debt, 0) / nullif({p}total_assets, 0)"
    cr, tl = "total_current_assets / nullif({p}total_current_liabilities, 0)", "coalesce(total_liabilities, total_assets - total_equity)"
    signals = [f"{share('net_income', 'total_assets', '')} > 0", "cfo > 0", f"{share('net_income', 'total_assets', '')} > {share('net_income', 'total_assets', 'p_')}", "cfo > net_income", f"{lev('')} <= {lev('p_')}",
               f"{cr.format(p='')} > p_{cr.format(p='p_')}", f"{sh('')} <= {sh('p_')}", f"{gm('')} > {gm('p_')}", f"{share('revenue', 'total_assets', '')} > {share('revenue', 'total_assets', 'p_')}"]
    known = " + ".join(f"(({s}) IS NOT NULL)::INT" for s in signals)
    held = " + ".join(f"coalesce(({s})::INT, 0)" for s in signals)
    net, ebit, growth = f"coalesce({debt('')}, 0) - ({liquid('')})", f"operating_income * {ann}", lambda c: f"({c} - p_{c}) / nullif(abs(p_{c}), 0)"
    tax = "CASE WHEN income_tax_expense IS NOT NULL AND pretax_income > 0 THEN greatest(0, least(0.35, income_tax_expense / pretax_income)) ELSE 0.21 END"
    wc, ebitda, fcf = "total_current_assets - total_current_liabilities", "coalesce(ebitda, operating_income + depreciation_amortization)", "coalesce(fcf, cfo - capex)"
    out = {
        "gross_margin": gm(""), "operating_margin": div("operating_income", "revenue"), "ebitda_margin": div(ebitda, "revenue"), "net_margin": div("net_income", "revenue"), "fcf_margin": div(fcf, "revenue"),
        "roe": div(f"net_income * {ann}", mean("total_equity", "p_total_equity")), "roa": div(f"net_income * {ann}", mean("total_assets", "p_total_assets")),
        "roic": div(f"{ebit} * (1 - ({tax}))", mean(invested(""), invested("p_"))), "fcf": fcf, "fcf_conversion": f"CASE WHEN net_income > 0 THEN {div(fcf, 'net_income')} END",
        "capex_intensity": div("capex", "revenue"), "sbc_pct_revenue": div("stock_based_comp", "revenue"),
        "net_debt": f"CASE WHEN cash_and_equivalents IS NOT NULL OR ({debt('')}) IS NOT NULL THEN {net} END",
        "net_debt_to_ebitda": div(f"CASE WHEN cash_and_equivalents IS NOT NULL OR ({debt('')}) IS NOT NULL THEN {net} END", f"{ebitda} * {ann}"), "debt_to_equity": div(debt(""), "total_equity"),
        "interest_coverage": div("operating_income", "interest_expense"), "working_capital": wc, "current_ratio": div("total_current_assets", "total_current_liabilities"),
        "quick_ratio": div(some("cash_and_equivalents", "short_term_investments", "accounts_receivable"), "total_current_liabilities"), "dso": f"{div('accounts_receivable', 'revenue')} * {days}",
        "dio": f"{div('inventory', 'cost_of_revenue')} * {days}", "dpo": f"{div('accounts_payable', 'cost_of_revenue')} * {days}", "asset_turnover": div(f"revenue * {ann}", mean("total_assets", "p_total_assets")),
        "altman_z": f"1.2 * ({wc}) / total_assets + 1.4 * retained_earnings / total_assets + 3.3 * {ebit} / total_assets + 0.6 * market_cap / nullif({tl}, 0) + revenue * {ann} / total_assets",
        "altman_z2": f"6.56 * ({wc}) / total_assets + 3.26 * retained_earnings / total_assets + 6.72 * {ebit} / total_assets + 1.05 * total_equity / nullif({tl}, 0)",
        "piotroski_f": f"CASE WHEN ago AND {known} >= 5 THEN {held} END", "revenue_yoy": growth("revenue"), "net_income_yoy": growth("net_income"), "eps_yoy": growth("eps_diluted"), "effective_tax_rate": tax,
    }
    prior = ", ".join(f"lag({f}, {back}) OVER w AS p_{f}" for f in FIELDS)
    return (f"WITH {STATEMENT}, p AS (SELECT *, CASE WHEN entity % 2 = 0 THEN revenue * 3 END AS market_cap, lag(true, {back}) OVER w IS NOT NULL AS ago, {prior} FROM st {where} WINDOW w AS (PARTITION BY entity ORDER BY period_end)) "
            f"SELECT entity, period_end, {', '.join(f'({e}) AS {k}' for k, e in out.items())} FROM p")


def market_cap():  # noqa: ANN201
    return F.when(F.col("entity") % 2 == 0, F.col("revenue") * 3)


@query("ratios", _ratio_sql("", 4, 4, 91))
def _(spark, d):
    return T.ratios(statements(spark, d), "Q", market_cap())


@query("ratios_yearly", _ratio_sql("WHERE month(period_end) = 12", 1, 1, 365))
def _(spark, d):
    return T.ratios(statements(spark, d).where(F.month("period_end") == 12), "FY", market_cap())


@query("ratios_half_yearly", _ratio_sql("WHERE month(period_end) IN (6, 12)", 2, 2, 182))
def _(spark, d):
    return T.ratios(statements(spark, d).where(F.month("period_end").isin(6, 12)), "H", market_cap())


@query("derived_fields", f"""WITH {STATEMENT} SELECT entity, period_end, coalesce(gross_profit, revenue - cost_of_revenue) AS gross_profit,
coalesce(total_liabilities, total_assets - total_equity - CASE WHEN entity % 2 = 0 THEN coalesce(minority_interest, 0) ELSE 0 END) AS total_liabilities,
coalesce(ebitda, operating_income + depreciation_amortization) AS ebitda, coalesce(fcf, cfo - capex) AS fcf FROM st""")
def _(spark, d):
    return T.with_derived(statements(spark, d), F.col("entity") % 2 == 0).select("entity", "period_end", *T.DERIVED)


@query("validate_extraction", f"""WITH {STATEMENT}, x AS (SELECT *, coalesce(gross_profit, CASE WHEN entity % 5 = 2 THEN revenue END) AS gp, coalesce(total_liabilities, CASE WHEN entity % 5 = 3 THEN total_assets - total_equity END) AS tl FROM st),
o AS (SELECT entity, period_end, abs(total_assets - (tl + total_equity)) / greatest(abs(total_assets), abs(tl + total_equity), 1) AS b, abs(total_assets - (tl + total_equity + minority_interest)) / greatest(abs(total_assets), abs(tl + total_equity + minority_interest), 1) AS bm,
  abs(gp - (revenue - cost_of_revenue)) / greatest(abs(gp), abs(revenue - cost_of_revenue), 1) AS g, abs(net_change_in_cash - (cfo + cfi + cff + coalesce(fx_effect, 0))) / greatest(abs(net_change_in_cash), abs(cfo + cfi + cff + coalesce(fx_effect, 0)), 1) AS c,
  CASE WHEN entity % 2 = 0 THEN entity % 4 = 0 END AS k FROM x),
r AS (SELECT entity, period_end, CASE WHEN b IS NOT NULL THEN b <= 0.005 OR coalesce(bm <= 0.005, false) END AS balance, g <= 0.005 AS gross, c <= 0.01 AS cash, k AS comparatives FROM o)
SELECT *, (balance IS NOT NULL)::INT + (gross IS NOT NULL)::INT + (cash IS NOT NULL)::INT + (comparatives IS NOT NULL)::INT AS n_checks,
coalesce(balance, true) AND coalesce(gross, true) AND coalesce(cash, true) AND coalesce(comparatives, true) AND (balance IS NOT NULL OR gross IS NOT NULL OR cash IS NOT NULL OR comparatives IS NOT NULL) AS passed FROM r""")
def _(spark, d):
    e = F.col("entity")
    s = statements(spark, d).withColumns({
        "gross_profit": F.coalesce("gross_profit", F.when(e % 5 == 2, F.col("revenue"))), "total_liabilities": F.coalesce("total_liabilities", F.when(e % 5 == 3, F.col("total_assets") - F.col("total_equity"))),
        "was_revenue": F.when(e % 2 == 0, F.col("revenue") * F.when(e % 4 == 0, 1.005).otherwise(1.02)), "was_cfo": F.when(e % 4 == 0, F.col("cfo"))})
    return T.checked(s)


LONG = f"""{STATEMENT}, long AS (SELECT entity, 'Q' AS period_type, period_end, field, value, false AS restated, 0.5 + entity % 5 / 10.0::DOUBLE + length(field) / 1000.0::DOUBLE AS confidence, length(field) % 7 <> 3 AS approved, period_end + length(field)::INT AS filed
  FROM (UNPIVOT st ON {', '.join(FIELDS)} INTO NAME field VALUE value)), again AS (SELECT * REPLACE (value * 1.1 AS value, true AS restated, filed + 300 AS filed) FROM long WHERE entity % 4 = 2 AND field IN ('revenue', 'cfo')),
facts AS (SELECT * FROM long UNION ALL SELECT * FROM again)"""


def long_facts(spark, d):  # noqa: ANN001, ANN201
    n = F.length("field")
    x = statements(spark, d).unpivot(["entity", "period_end"], list(FIELDS), "field", "value").where("value IS NOT NULL").select(
        "entity", F.lit("Q").alias("period_type"), "period_end", "field", "value", F.lit(False).alias("restated"), (0.5 + F.col("entity") % 5 / 10.0 + n / 1000.0).alias("confidence"),
        (n % 7 != 3).alias("approved"), F.date_add("period_end", n).alias("filed"))
    again = x.where((F.col("entity") % 4 == 2) & F.col("field").isin("revenue", "cfo")).withColumns({"value": F.col("value") * 1.1, "restated": F.lit(True), "filed": F.date_add("filed", 300)})
    return x.unionByName(again)


@query("recompute_derived", f"""WITH {LONG}, r AS (SELECT entity, period_type, period_end, view, field, arg_max(struct_pack(v := value, c := confidence, a := approved, f := filed), (view AND restated)::INT) AS e
  FROM facts, (SELECT unnest([false, true]) AS view) WHERE view OR NOT restated GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT a.entity, a.period_type, a.period_end, a.view, n.field, CASE n.op WHEN '+' THEN a.e.v + b.e.v ELSE a.e.v - b.e.v END AS value, least(a.e.c, b.e.c) AS confidence, a.e.a AND b.e.a AS approved, greatest(a.e.f, b.e.f) AS filed
  FROM (VALUES ('gross_profit', 'revenue', 'cost_of_revenue', '-'), ('total_liabilities', 'total_assets', 'total_equity', '-'), ('ebitda', 'operating_income', 'depreciation_amortization', '+'), ('fcf', 'cfo', 'capex', '-')) n(field, x, y, op)
  JOIN r a ON a.field = n.x JOIN r b ON b.field = n.y AND b.entity = a.entity AND b.period_end = a.period_end AND b.view = a.view
  WHERE NOT EXISTS (FROM r k WHERE k.field = n.field AND k.entity = a.entity AND k.period_end = a.period_end AND k.view = a.view))
SELECT entity, period_type, period_end, field, value, confidence, approved, filed, view AS restated FROM d WHERE NOT view
UNION ALL SELECT l.entity, l.period_type, l.period_end, l.field, l.value, l.confidence, l.approved, l.filed, true FROM d l LEFT JOIN d f ON NOT f.view AND f.entity = l.entity AND f.period_end = l.period_end AND f.field = l.field
WHERE l.view AND (f.value IS NULL OR abs(f.value - l.value) > 1e-6 * greatest(1, abs(l.value)))""")
def _(spark, d):
    return T.recomputed(long_facts(spark, d))


@query("coverage", f"""WITH {LONG}, c AS (SELECT *, 'src' || (length(field) % 3) AS source FROM facts WHERE entity % 6 <> 1 OR field <> 'revenue'),
p AS (SELECT entity, period_type, period_end, source, count(*) AS n, count(*) FILTER (approved) AS a, max(filed) AS f, bool_or(field = 'revenue') AS core FROM c GROUP BY 1, 2, 3, 4)
SELECT entity, period_type, period_end, sum(n)::BIGINT AS facts, sum(a)::BIGINT AS approved, array_to_string(list_sort(list(source || ':' || n)), ',') AS sources, max(f) AS last_filed, (sum(n) - sum(a))::BIGINT AS pending FROM p GROUP BY 1, 2, 3 HAVING bool_or(core)""")
def _(spark, d):
    x = long_facts(spark, d).withColumn("source", F.concat(F.lit("src"), (F.length("field") % 3).cast("string")))
    return T.coverage(x.where("entity % 6 <> 1 OR field <> 'revenue'"), ["revenue"])


@query("period_meta", f"""WITH {LONG}, m AS (SELECT entity, period_end, year(period_end) - (length(field) % 5 = 0)::INT AS fy, CASE WHEN length(field) % 3 = 0 THEN 'Q' || quarter(period_end) ELSE 'X' END AS fp, CASE WHEN length(field) % 4 < 2 THEN 'USD' ELSE 'EUR' END AS cur, period_end - (length(field) * 3)::INT AS s FROM long),
y AS (SELECT entity, period_end, fy, row_number() OVER (PARTITION BY entity, period_end ORDER BY count(*) DESC, fy) AS k FROM m GROUP BY 1, 2, 3), p AS (SELECT entity, period_end, fp, row_number() OVER (PARTITION BY entity, period_end ORDER BY count(*) DESC, fp) AS k FROM m GROUP BY 1, 2, 3),
c AS (SELECT entity, period_end, cur, row_number() OVER (PARTITION BY entity, period_end ORDER BY count(*) DESC, cur) AS k FROM m GROUP BY 1, 2, 3), s AS (SELECT entity, period_end, min(s) AS period_start FROM m GROUP BY 1, 2)
SELECT entity, period_end, fy::INT AS fiscal_year, fp AS fiscal_period, cur AS currency, period_start FROM y JOIN p USING (entity, period_end) JOIN c USING (entity, period_end) JOIN s USING (entity, period_end) WHERE y.k = 1 AND p.k = 1 AND c.k = 1""")
def _(spark, d):
    n = F.length("field")
    x = long_facts(spark, d).where("NOT restated").select(
        "entity", "period_end", (F.year("period_end") - (n % 5 == 0).cast("int")).alias("fiscal_year"), F.when(n % 3 == 0, F.concat(F.lit("Q"), F.quarter("period_end").cast("string"))).otherwise("X").alias("fiscal_period"),
        F.when(n % 4 < 2, "USD").otherwise("EUR").alias("currency"), F.date_sub("period_end", n * 3).alias("start"))
    return T.period_meta(x)


@query("periods", """WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS e, (o_custkey % 12 + 1)::INT AS fye, (o_custkey % 400)::INT AS days FROM orders), b AS (SELECT *, CASE WHEN day(e) <= 4 THEN date_trunc('month', e)::DATE - 1 ELSE e END AS b FROM x),
f AS (SELECT *, (year(b) + CASE WHEN month(b) > fye THEN 1 ELSE 0 END)::INT AS fy, ((month(b) - fye - 1 + 24) % 12 // 3 + 1)::INT AS fq FROM b)
SELECT o_orderkey, fy, fq, CASE WHEN fq <= 2 THEN 1 ELSE 2 END AS fh, CASE WHEN days BETWEEN 75 AND 105 THEN 3 WHEN days BETWEEN 165 AND 200 THEN 6 WHEN days BETWEEN 255 AND 290 THEN 9 WHEN days BETWEEN 350 AND 380 THEN 12 END AS months,
(CASE WHEN e = last_day(e) THEN last_day(e - INTERVAL 6 MONTH) ELSE (e - INTERVAL 6 MONTH)::DATE END + 1)::DATE AS start6, 'Q' || fq || ' FY' || right(fy::VARCHAR, 2) AS label FROM f""")
def _(spark, d):
    e, fye = F.to_date("o_orderdate"), (F.col("o_custkey") % 12 + 1).cast("int")
    y, q = T.fiscal_year(e, fye), T.fiscal_quarter(e, fye)
    return views.table(spark, d, "orders").select(
        "o_orderkey", y.alias("fy"), q.alias("fq"), T.fiscal_half(e, fye).alias("fh"), T.months_of(F.date_sub(e, (F.col("o_custkey") % 400 - 1).cast("int")), e).alias("months"),
        T.approx_start(e, 6).alias("start6"), T.period_label(F.lit("Q"), y, F.concat(F.lit("Q"), q.cast("string")), e).alias("label"))


# --- filings: cumulative durations, discrete quarters where some are told, instants, cover instants, later restatements

FILINGS = f"""{BASE}, ytd AS (SELECT entity, year(period_end) AS y, quarter(period_end) AS q, period_end AS e, rev, qty, sum(rev) OVER c AS cum, avg(qty) OVER c AS mean, count(*) OVER c AS n FROM base WINDOW c AS (PARTITION BY entity, year(period_end) ORDER BY period_end)),
told AS (SELECT entity, 'us-gaap' AS taxonomy, 'Revenues' AS concept, 'USD' AS unit, make_date(y, 1, 1) AS s, e, cum AS val FROM ytd WHERE n = q AND NOT (entity % 4 = 1 AND q = 3) AND NOT (entity % 4 = 2 AND q = 2)
  UNION ALL SELECT entity, 'us-gaap', 'Revenues', 'USD', make_date(y, q * 3 - 2, 1), e, rev FROM ytd WHERE q > 1 AND (entity % 4 IN (1, 2) AND q = 3 OR entity % 4 = 2 AND q = 2 OR entity % 4 = 3)
  UNION ALL SELECT entity, 'us-gaap', 'WeightedShares', 'shares', make_date(y, 1, 1), e, mean FROM ytd WHERE n = q
  UNION ALL SELECT entity, 'us-gaap', 'Assets', CASE WHEN q = 2 AND entity % 3 = 0 THEN 'EUR' ELSE 'USD' END, NULL, e, rev * 4 FROM ytd
  UNION ALL SELECT entity, 'dei', 'SharesOutstanding', 'shares', NULL, e + 17, qty FROM ytd
  UNION ALL SELECT entity, 'us-gaap', 'Assets', 'USD', NULL, e - 12, rev FROM ytd WHERE entity % 5 = 0),
filed AS (SELECT *, e + 40 AS filed FROM told UNION ALL SELECT * REPLACE (val * 1.25 AS val), e + 400 FROM told WHERE entity % 5 = 2 AND concept = 'Revenues'),
cm AS (SELECT * FROM (VALUES ('us-gaap', 'Revenues', 'revenue', 1, 1, NULL, NULL, NULL), ('us-gaap', 'Revenues', 'turnover', 2, -1, DATE '1996-01-01', DATE '1997-06-30', NULL), ('us-gaap', 'Assets', 'total_assets', 1, 1, NULL, NULL, NULL),
  ('us-gaap', 'WeightedShares', 'shares_basic_weighted', 1, 1, NULL, NULL, NULL), ('dei', 'SharesOutstanding', 'shares_outstanding', 1, 1, NULL, NULL, NULL), ('us-gaap', 'Revenues', 'revenue', 5, -1, NULL, NULL, 7)) t(taxonomy, concept, field, priority, sign, valid_from, valid_to, entity_override))"""
CONCEPTS = [
    ("us-gaap", "Revenues", "revenue", 1, 1, None, None, None), ("us-gaap", "Revenues", "turnover", 2, -1, "1996-01-01", "1997-06-30", None), ("us-gaap", "Assets", "total_assets", 1, 1, None, None, None),
    ("us-gaap", "WeightedShares", "shares_basic_weighted", 1, 1, None, None, None), ("dei", "SharesOutstanding", "shares_outstanding", 1, 1, None, None, None), ("us-gaap", "Revenues", "revenue", 5, -1, None, None, 7),
]
KINDS = [("revenue", "flow"), ("turnover", "flow"), ("total_assets", "stock"), ("shares_basic_weighted", "avg"), ("shares_outstanding", "stock")]


def concepts(spark):  # noqa: ANN001, ANN201
    c = spark.createDataFrame(CONCEPTS, "taxonomy string, concept string, field string, priority int, sign int, valid_from string, valid_to string, entity_override long")
    return c.withColumns({k: F.col(k).cast("date") for k in ("valid_from", "valid_to")})


def filings(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    w = Window.partitionBy("entity", F.year("period_end")).orderBy("period_end")
    y = base(spark, d).select("entity", F.year("period_end").alias("y"), F.quarter("period_end").alias("q"), F.col("period_end").alias("e"), "rev", "qty",
                              F.sum("rev").over(w).alias("cum"), F.avg("qty").over(w).alias("mean"), F.count("*").over(w).alias("n"))
    one = lambda taxonomy, concept, unit, start, end, val, cond: F.when(F.expr(cond), F.struct(
        F.lit(taxonomy).alias("taxonomy"), F.lit(concept).alias("concept"), unit.alias("unit"), start.cast("date").alias("start"), end.alias("end"), val.alias("val")))
    c, year = F.col, F.make_date("y", F.lit(1), F.lit(1))
    none = F.lit(None)
    rows = F.array(
        one("us-gaap", "Revenues", F.lit("USD"), year, c("e"), c("cum"), "n = q AND NOT (entity % 4 = 1 AND q = 3) AND NOT (entity % 4 = 2 AND q = 2)"),
        one("us-gaap", "Revenues", F.lit("USD"), F.make_date("y", c("q") * 3 - 2, F.lit(1)), c("e"), c("rev"), "q > 1 AND (entity % 4 IN (1, 2) AND q = 3 OR entity % 4 = 2 AND q = 2 OR entity % 4 = 3)"),
        one("us-gaap", "WeightedShares", F.lit("shares"), year, c("e"), c("mean"), "n = q"),
        one("us-gaap", "Assets", F.when(F.expr("q = 2 AND entity % 3 = 0"), "EUR").otherwise("USD"), none, c("e"), c("rev") * 4, "true"),
        one("dei", "SharesOutstanding", F.lit("shares"), none, F.date_add("e", 17), c("qty"), "true"),
        one("us-gaap", "Assets", F.lit("USD"), none, F.date_sub("e", 12), c("rev"), "entity % 5 = 0"))
    told = y.select("entity", F.explode(rows).alias("x")).where("x IS NOT NULL").select("entity", "x.*").withColumn("filed", F.date_add("end", 40))
    again = told.where("entity % 5 = 2 AND concept = 'Revenues'").withColumns({"val": F.col("val") * 1.25, "filed": F.date_add("end", 400)})
    return told.unionByName(again)


def company_json(spark, d):  # noqa: ANN001, ANN201
    """The filings nested as the source tells them, one text per entity."""
    f = filings(spark, d).withColumn("item", F.struct(*[F.col(k).cast("string").alias(k) for k in ("start", "end", "filed")], "val", F.lit("a-1").alias("accn")))
    units = f.groupBy("entity", "taxonomy", "concept", "unit").agg(F.collect_list("item").alias("items"))
    by_concept = units.groupBy("entity", "taxonomy", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "items"))).alias("units"))
    by_taxonomy = by_concept.groupBy("entity", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units").alias("body")))).alias("concepts"))
    return by_taxonomy.groupBy("entity").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("taxonomy", "concepts"))).alias("facts"))).alias("json"))


@query("company_facts", f"WITH {FILINGS} SELECT entity, taxonomy, concept, unit, s AS start, e AS \"end\", val, 'a-1' AS accn, filed FROM filed WHERE unit <> 'EUR'")
def _(spark, d):
    return T.company_facts(company_json(spark, d), ["EUR"])


MAPPED = """mapped AS (SELECT entity, f.taxonomy, f.concept, unit, s, e, val, filed, field, prio, sign FROM (SELECT f.*, cm.field, cm.sign, cm.priority - CASE WHEN entity_override IS NOT NULL THEN 1000 ELSE 0 END AS prio,
  row_number() OVER (PARTITION BY f.entity, f.taxonomy, f.concept, f.unit, f.s, f.e, f.filed, cm.field ORDER BY cm.priority - CASE WHEN entity_override IS NOT NULL THEN 1000 ELSE 0 END) AS k FROM filed f JOIN cm ON f.taxonomy = cm.taxonomy AND f.concept = cm.concept
  AND (entity_override IS NULL OR entity_override = entity) AND (valid_from IS NULL OR e >= valid_from) AND (valid_to IS NULL OR e <= valid_to)) f WHERE k = 1)"""


@query("range_join_validity", f"WITH {FILINGS}, {MAPPED} SELECT entity, concept, s AS start, e AS \"end\", filed, unit, field, prio AS priority, sign FROM mapped")
def _(spark, d):
    return T.mapped(filings(spark, d), concepts(spark)).select("entity", "concept", "start", "end", "filed", "unit", "field", "priority", "sign")


SNAPPED = """ends AS (SELECT entity, e, bool_or(s IS NOT NULL) AS dur, bool_or(s IS NOT NULL OR taxonomy <> 'dei' AND (day(e) >= 24 OR day(e) <= 4)) AS real FROM mapped GROUP BY 1, 2),
snap AS (SELECT m.* REPLACE (CASE WHEN m.s IS NULL AND NOT x.dur AND (m.taxonomy = 'dei' OR NOT (day(m.e) >= 24 OR day(m.e) <= 4)) THEN (SELECT max(r.e) FROM ends r WHERE r.entity = m.entity AND r.real AND r.e <= m.e) ELSE m.e END AS e) FROM mapped m JOIN ends x ON x.entity = m.entity AND x.e = m.e)"""
VIEWS = """unit_n AS (SELECT entity, field, unit, count(DISTINCT (s, e)) AS n FROM snap WHERE e IS NOT NULL GROUP BY 1, 2, 3), dom AS (SELECT entity, field, unit, row_number() OVER (PARTITION BY entity, field ORDER BY n DESC, unit) AS k FROM unit_n),
vw AS (SELECT m.entity, m.field, m.s, m.e, arg_min(val * sign, filed) AS first_value, arg_max(val * sign, filed) AS last_value FROM snap m JOIN dom ON dom.k = 1 AND dom.entity = m.entity AND dom.field = m.field AND dom.unit = m.unit WHERE m.e IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("snap_cover_instants", f"WITH {FILINGS}, {MAPPED}, {SNAPPED} SELECT entity, concept, s AS start, e AS \"end\", filed, unit, field FROM snap WHERE e IS NOT NULL")
def _(spark, d):
    return T.snapped(T.mapped(filings(spark, d), concepts(spark))).select("entity", "concept", "start", "end", "filed", "unit", "field")


def _period_sql(value: str, name: str) -> str:
    """Period rows of ``vw`` for one view; calendar years."""
    avg, stock = "field = 'shares_basic_weighted'", "field IN ('total_assets', 'shares_outstanding')"
    less = lambda n, cur, prev: f"CASE WHEN {avg} THEN {n} * {cur} - {n - 1} * ({prev}) ELSE {cur} - ({prev}) END"
    mean = lambda *q: f"({' + '.join(q)}) / CASE WHEN {avg} THEN {len(q)} ELSE 1 END"
    return f"""{name}_x AS MATERIALIZED (SELECT entity, field, {stock} AS stock, {avg} AS av, year(e) AS fy, quarter(e) AS q, e - s + 1 AS days, s, e, {value} AS v FROM vw),
{name}_w AS MATERIALIZED (SELECT entity, field, stock, av, fy, {', '.join(f"max(v) FILTER (q = {n} AND (stock AND s IS NULL AND last OR days BETWEEN 75 AND 105)) AS q{n}" for n in (1, 2, 3, 4))},
  max(v) FILTER (q = 4 AND (stock AND s IS NULL AND last OR days BETWEEN 350 AND 380)) AS yr, max(v) FILTER (q = 2 AND days BETWEEN 165 AND 200) AS y2, max(v) FILTER (q = 3 AND days BETWEEN 255 AND 290) AS y3,
  {', '.join(f"max(e) FILTER (q = {n}) AS e{n}" for n in (1, 2, 3, 4))} FROM (SELECT *, e = max(e) OVER (PARTITION BY entity, field, fy, q) AS last FROM {name}_x) GROUP BY 1, 2, 3, 4, 5),
{name}_2 AS MATERIALIZED (SELECT * REPLACE (coalesce(q2, CASE WHEN NOT stock THEN {less(2, 'y2', 'q1')} END) AS q2), q2 IS NULL AS d2 FROM {name}_w),
{name}_3 AS MATERIALIZED (SELECT * REPLACE (coalesce(q3, CASE WHEN NOT stock THEN {less(3, 'y3', f'coalesce(y2, {mean("q1", "q2")})')} END) AS q3), q3 IS NULL AS d3 FROM {name}_2),
{name}_4 AS MATERIALIZED (SELECT * REPLACE (coalesce(q4, CASE WHEN NOT stock THEN {less(4, 'yr', f'coalesce(y3, {mean("q1", "q2", "q3")}, CASE WHEN {avg} THEN (2 * y2 + q3) / 3 ELSE y2 + q3 END)')} END) AS q4), q4 IS NULL AS d4 FROM {name}_3),
{name}_q AS MATERIALIZED (SELECT entity, field, stock, av, 'Q' AS period_type, fy, 'Q1' AS fp, 1 AS n, e1 AS pe, q1 AS value, false AS derived FROM {name}_4 WHERE q1 IS NOT NULL
  {' '.join(f"UNION ALL SELECT entity, field, stock, av, 'Q', fy, 'Q{n}', {n}, e{n}, q{n}, d{n} FROM {name}_4 WHERE q{n} IS NOT NULL" for n in (2, 3, 4))}),
{name}_t AS MATERIALIZED (SELECT *, count(value) OVER w AS c, fy * 4 + n - min(fy * 4 + n) OVER w AS span, sum(value) OVER w AS total FROM {name}_q WINDOW w AS (PARTITION BY entity, field ORDER BY fy * 4 + n ROWS 3 PRECEDING)),
{name} AS MATERIALIZED (SELECT entity, field, period_type, fy, fp, pe, value, derived FROM {name}_q UNION ALL SELECT entity, field, 'FY', fy, 'FY', e4, yr, false FROM {name}_4 WHERE yr IS NOT NULL
  UNION ALL SELECT entity, field, 'TTM', fy, 'TTM', pe, CASE WHEN stock THEN value WHEN av THEN total / 4 ELSE total END, NOT stock FROM {name}_t WHERE stock OR c = 4 AND span = 3)"""


@query("companyfacts_to_facts", f"""WITH {FILINGS}, {MAPPED}, {SNAPPED}, {VIEWS}, {_period_sql('first_value', 'f')}, {_period_sql('last_value', 'l')}
SELECT entity, field, period_type, fy::INT AS fiscal_year, fp AS fiscal_period, pe AS period_end, round(value, 4) AS value, derived, false AS restated FROM f
UNION ALL SELECT f.entity, f.field, f.period_type, f.fy::INT, f.fp, f.pe, round(l.value, 4), f.derived, true FROM f JOIN l ON f.entity = l.entity AND f.field = l.field AND f.period_type = l.period_type AND f.pe = l.pe
WHERE abs(l.value - f.value) > greatest(1e-9, 1e-6 * greatest(abs(l.value), abs(f.value)))""")
def _(spark, d):
    raw = T.company_facts(company_json(spark, d), [])
    kinds = spark.createDataFrame(KINDS, "field string, kind string")
    fye = raw.select("entity").distinct().withColumn("fye", F.lit(12))
    out = T.facts_of(raw, concepts(spark), kinds, fye)
    return out.select("entity", "field", "period_type", "fiscal_year", "fiscal_period", "period_end", F.round("value", 4).alias("value"), "derived", "restated")


@query("year_end_month", f"WITH {FILINGS} SELECT DISTINCT entity, 12 AS fye FROM filed WHERE e - s + 1 BETWEEN 350 AND 380")
def _(spark, d):
    return T.year_end_month(filings(spark, d))


@query("half_year_derivation", f"""WITH {BASE}, y AS (SELECT entity, year(period_end) AS fy, sum(rev) FILTER (quarter(period_end) <= 2) AS h1, sum(rev) AS v, count(*) AS n, max(period_end) AS e, max(period_end) FILTER (quarter(period_end) = 2) AS e2 FROM base GROUP BY 1, 2)
SELECT entity, fy::INT AS fiscal_year, 'H1' AS fiscal_period, e2 AS period_end, round(h1, 4) AS value FROM y WHERE n = 4 UNION ALL SELECT entity, fy::INT, 'H2', e, round(v - h1, 4) FROM y WHERE n = 4""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("entity", F.year("period_end"))
    b = base(spark, d).withColumns({"n": F.count("*").over(w), "cum": F.sum("rev").over(w.orderBy("period_end"))}).where("n = 4 AND quarter(period_end) IN (2, 4)")
    told = b.select("entity", F.lit("revenue").alias("field"), F.lit("flow").alias("kind"), F.lit(12).alias("fye"), F.trunc("period_end", "year").alias("start"), F.col("period_end").alias("end"), F.col("cum").alias("v"))
    return T.period_rows(told, "v", halves=True).where("period_type = 'H'").select("entity", "fiscal_year", "fiscal_period", "period_end", F.round("value", 4).alias("value"))


OIM = r"""o AS (SELECT entity, period_end, q_start, rev FROM base)"""


@query("xbrl_json_to_facts", f"""WITH {BASE} SELECT entity AS report, 'ifrs' AS taxonomy, 'Revenue' AS concept, 'ILS' AS unit, q_start AS start, period_end AS "end", rev AS val FROM base
UNION ALL SELECT entity, 'ifrs', 'Assets', 'ILS', NULL, period_end, rev * 4 FROM base""")
def _(spark, d):
    b = base(spark, d)
    at = lambda c: F.date_format(c, "yyyy-MM-dd")
    period = F.concat(at("q_start"), F.lit("T00:00:00/"), at(F.date_add("period_end", 1)), F.lit("T00:00:00"))
    instant = F.concat(at(F.date_add("period_end", 1)), F.lit("T00:00:00"))

    def fact(concept, when, value, *more):  # noqa: ANN001, ANN202
        dims = F.create_map(F.lit("concept"), F.lit(concept), F.lit("entity"), F.lit("lei:1"), F.lit("period"), when, F.lit("unit"), F.lit("iso4217:ILS"), *map(F.lit, more))
        return F.struct(value.alias("value"), dims.alias("dimensions"))

    every = F.array(fact("ifrs:Revenue", period, F.col("rev").cast("string")), fact("ifrs:Assets", instant, (F.col("rev") * 4).cast("string")),
                    fact("ifrs:Revenue", period, F.lit("1"), "ifrs:Segment", "x:North"), fact("ifrs:Name", period, F.lit("no number")))
    x = b.select("entity", F.posexplode(every).alias("k", "fact"), "period_end").withColumn("id", F.concat(at("period_end"), F.lit("-"), F.col("k").cast("string")))
    json = x.groupBy(F.col("entity").alias("report")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("id", "fact"))).alias("facts"))).alias("json"))
    return T.report_facts(json)
