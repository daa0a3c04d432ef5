"""Queries over filings' pages: statement tables to facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspan.operators import filing_tables as T
from marlspan.operators import statement_pages as P
from marlspan.sources import views

from .registry import Register

reg = Register()
query = reg.query

# Quarterly figures of nations in whole thousands, as the pages print them.
FIGURES = """figures AS (SELECT s_nationkey AS entity, last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS pe, floor(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / 1000)::BIGINT AS rev,
  floor(sum((l_extendedprice * l_discount)::DECIMAL(18,4))::DOUBLE / 1000)::BIGINT AS cost, floor(sum((l_extendedprice * l_tax)::DECIMAL(18,4))::DOUBLE / 1000)::BIGINT AS sm, sum(l_quantity::DECIMAL(18,2))::BIGINT AS units, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
told AS (SELECT f.*, p.rev AS rev0, p.cost AS cost0, p.sm AS sm0, p.units AS units0, p.n AS n0, p.pe AS pe0, y.rev AS rev1, y.pe AS pe1, f.entity % 2 = 0 AS usd
  FROM figures f LEFT JOIN figures p ON p.entity = f.entity AND p.pe = last_day(f.pe - INTERVAL 1 YEAR) LEFT JOIN figures y ON y.entity = f.entity AND y.pe = make_date(year(f.pe) - 1, 12, 31))"""


def figures(spark, d):  # noqa: ANN001, ANN201
    x, s = views.table(spark, d, "lineitem"), views.table(spark, d, "supplier")
    whole = lambda c, t: F.expr(f"cast(floor(sum(cast({c} AS {t})) / 1000) AS bigint)")
    pe = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2))
    f = x.join(s, x.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("entity"), pe.alias("pe")).agg(
        whole("l_extendedprice", "decimal(18,2)").alias("rev"), whole("l_extendedprice * l_discount", "decimal(18,4)").alias("cost"),
        whole("l_extendedprice * l_tax", "decimal(18,4)").alias("sm"), F.expr("cast(sum(cast(l_quantity AS decimal(18,2))) AS bigint)").alias("units"), F.count("*").alias("n"))
    before = f.select("entity", F.last_day(F.add_months("pe", 12)).alias("pe"), *[F.col(c).alias(f"{c}0") for c in ("rev", "cost", "sm", "units", "n")], F.col("pe").alias("pe0"))
    year = f.where("month(pe) = 12").select("entity", (F.year("pe") + 1).alias("y"), F.col("rev").alias("rev1"), F.col("pe").alias("pe1"))
    return f.join(before, ["entity", "pe"], "left").withColumn("y", F.year("pe")).join(year, ["entity", "y"], "left")


def pages(spark, d):  # noqa: ANN001, ANN201
    """A filing for each nation and quarter: its page with an income statement
    under spanning headers, a balance sheet, a cash flow statement, and a table
    that is no statement."""
    f = figures(spark, d)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda c: F.coalesce(F.format_number(F.col(c), 0), F.lit(""))
    less = lambda c: F.coalesce(F.concat(F.lit("("), F.format_number(F.col(c), 0), F.lit(")")), F.lit(""))
    sign, day = F.when(F.col("entity") % 2 == 0, "$").otherwise("NIS"), F.date_format("pe", "MMMM d")
    dollars = lambda label, a, b: text(f"<tr><td>{label}</td><td>", sign, "</td><td>", a, "</td><td>", sign, "</td><td>", b, "</td></tr>")
    plain = lambda label, a, b: text(f"<TR><TD>{label}<TD></TD><TD>", a, "<TD></TD><TD>", b, "</TR>")
    both = lambda c: (number(c), number(f"{c}0"))
    spoken = F.when(F.col("entity") % 2 == 0, "U.S. dollars in thousands, except share and per share data").otherwise("NIS in thousands")
    heads = text("<tr><td rowspan=2></td><td colspan=2>Three months ended ", day, ",</td><td colspan='2'>Three months ended ", day, ",</td></tr><tr><td colspan=2>",
                 F.year("pe").cast("string"), "</td><td colspan=2>", (F.year("pe") - 1).cast("string"), "</td></tr>")
    instants = text("<tr><td></td><td colspan=2>", F.date_format("pe", "MMMM d, yyyy"), "</td><td colspan=2>December 31, ", (F.year("pe") - 1).cast("string"), "</td></tr>")
    per_share = lambda r, u: F.coalesce(F.format_number(F.floor(F.col(r) * 1000 / F.col(u)) / 100, 2), F.lit(""))
    html = text(
        "<html><body><h1>Report &amp; results</h1><style>td { content: 'in millions' }</style><table><tr><td>Contact</td><td>12</td></tr><tr><td>a</td><td>3</td></tr><tr><td>b</td><td>4</td></tr></table>"
        "<p><b>CONSOLIDATED STATEMENTS OF INCOME</b></p><p>", spoken, "</p><table>", heads, dollars("Total revenues&nbsp;(Note 3)", *both("rev")), plain("Cost of revenues", *both("cost")),
        plain("Selling and marketing", *both("sm")), plain("General and administrative*", *both("sm")), plain("Financial expenses, net", less("cost"), less("cost0")), plain("Of which: abroad", *both("n")),
        "<tr><td>Weighted average number of shares outstanding:</td></tr>", plain("Basic", *both("n")), "<tr><td>Earnings per share:</td><td></td></tr>",
        plain("Basic", per_share("rev", "units"), per_share("rev0", "units0")), "</table><p>CONSOLIDATED BALANCE SHEETS</p><p>", spoken, "</p><table>", instants, dollars("Total assets", number("rev"), number("rev1")),
        plain("Goodwill", F.lit("&#8212;"), F.lit("—")), plain("Inventories", number("rev"), number("rev1")), "</table><p>CONSOLIDATED STATEMENTS OF CASH FLOWS</p><p>", spoken, "</p><table>", heads,
        plain("Net cash provided by operating activities", *both("rev")), plain("Purchase of property and equipment", less("cost"), less("cost0")), plain("Dividends paid", less("sm"), less("sm0")), "</table></body></html>")
    return f.select("entity", text(F.col("entity").cast("string"), "-", F.date_format("pe", "yyyyMMdd")).alias("accession"), F.lit(12).alias("fye"), html.alias("html"))


def _facts_sql() -> str:
    """What the pages print, as facts: a flow of the quarter and of the one a year before, an instant also for the year it ends."""
    flow = [("revenue", "rev * 1000.0", "rev0 * 1000.0"), ("cost_of_revenue", "cost * 1000.0", "cost0 * 1000.0"), ("sga_expense", "2 * sm * 1000.0", "2 * sm0 * 1000.0"),
            ("other_nonoperating_income", "cost * 1000.0", "cost0 * 1000.0"), ("shares_basic_weighted", "n * CASE WHEN usd THEN 1 ELSE 1000 END", "n0 * CASE WHEN usd THEN 1 ELSE 1000 END"),
            ("eps_basic", "floor(rev * 1000 / units::DOUBLE) / 100", "floor(rev0 * 1000 / units0::DOUBLE) / 100"), ("cfo", "rev * 1000.0", "rev0 * 1000.0"), ("capex", "cost * 1000.0", "cost0 * 1000.0"),
            ("dividends_paid", "sm * 1000.0", "sm0 * 1000.0")]
    stock = [("total_assets", "rev * 1000.0", "rev1 * 1000.0"), ("goodwill", "0", "0"), ("inventory", "rev * 1000.0", "rev1 * 1000.0")]
    rows = [f"SELECT entity, pe AS of, '{f}' AS field, 'Q' AS t, {e} AS pe, {v} AS v, usd FROM told" for f, now, ago in flow for e, v in (("pe", now), ("last_day(pe - INTERVAL 1 YEAR)", ago))]
    rows += [f"SELECT entity, pe, '{f}', {t!r}, {e}, {v}, usd FROM told {w}" for f, now, ago in stock for e, v, t, w in (
        ("pe", now, "Q", ""), ("make_date(year(pe) - 1, 12, 31)", ago, "Q", ""), ("pe", now, "FY", "WHERE month(pe) = 12"), ("make_date(year(pe) - 1, 12, 31)", ago, "FY", ""))]
    return f"""WITH {FIGURES}, x AS ({' UNION ALL '.join(rows)})
SELECT entity, entity || '-' || strftime(of, '%Y%m%d') AS accession, field, t AS period_type, CASE WHEN field NOT IN ('total_assets', 'goodwill', 'inventory') THEN date_trunc('quarter', pe)::DATE END AS period_start, pe AS period_end,
  year(pe)::INT AS fiscal_year, CASE WHEN t = 'FY' THEN 'FY' ELSE 'Q' || quarter(pe) END AS fiscal_period, round(v::DOUBLE, 4) AS value, CASE WHEN field = 'shares_basic_weighted' THEN '' WHEN usd THEN 'USD' ELSE 'ILS' END AS currency,
  CASE WHEN field = 'eps_basic' THEN 0 ELSE 3 END AS unit_scale FROM x WHERE v IS NOT NULL"""


@query("sixk_tables_to_facts", _facts_sql())
def _(spark, d):
    lines = T.statement_lines(T.statement_tables(pages(spark, d)))
    facts = T.table_facts(lines, ["entity", "accession"])
    return facts.withColumn("value", F.round("value", 4)).drop("concept", "source", "confidence")


@query("statement_table_report", f"""WITH {FIGURES}, f AS (SELECT entity || '-' || strftime(pe, '%Y%m%d') AS accession, usd FROM told)
SELECT accession, table_no::INT AS table_no, statement, 3 AS unit_scale, CASE WHEN usd THEN 'USD' ELSE 'ILS' END AS currency, n::BIGINT AS n_lines, k::BIGINT AS n_known, unknown
FROM f, (VALUES (1, 'IS', 8, 7, 'Of which: abroad'), (2, 'BS', 3, 3, ''), (3, 'CF', 3, 3, '')) t(table_no, statement, n, k, unknown)""")
def _(spark, d):
    found = T.table_report(T.statement_lines(T.statement_tables(pages(spark, d))), ["accession"])
    return found.withColumn("unknown", F.array_join("unknown", "; "))


def report_pages(spark, d):  # noqa: ANN001, ANN201
    """A report for each nation: contents, a letter, an auditor's page that names
    all statements, a balance sheet of two pages, an income statement in English
    or in Hebrew written backwards, notes. Figures are the nation's."""
    f = figures(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list("rev")).alias("rev")).where(F.size("rev") >= 12)
    numbers = F.array_join(F.transform("rev", lambda v: F.format_number(v + 1000, 0)), " ")
    k = F.col("entity")
    unit = F.when(k % 3 == 0, "NIS in thousands").when(k % 3 == 1, "U.S.  dollars in thousands").otherwise("no unit")
    hebrew = F.reverse(F.lit("דוחות מאוחדים על הרווח הכולל"))
    texts = F.array(
        F.lit("Table of Contents\nBalance sheets 3\nStatements of cash flows 5"), F.concat(F.lit("Dear holders, "), F.array_join(F.slice("rev", 1, 3), " ")),
        F.lit("We audited the balance sheets, income statements and statements of cash flows."), F.concat(F.lit("Consolidated Balance Sheets\n"), unit, F.lit("\n"), numbers),
        F.concat(F.lit("continued\nin millions\n"), numbers), F.concat(F.when(k % 2 == 0, "Statements of Operations").otherwise(hebrew), F.lit("\n"), numbers), F.concat(F.lit("Note 1\n"), F.when(k % 4 == 0, numbers).otherwise("")),
        F.concat(F.lit("Note 2\n"), numbers), F.lit(None).cast("string"))
    return f.select(F.col("entity").alias("doc_id"), F.posexplode(texts).alias("page", "text"))


@query("statement_pages", f"""WITH {FIGURES}, e AS (SELECT entity, count(*) AS n FROM figures GROUP BY 1 HAVING count(*) >= 12)
SELECT entity AS doc_id, page::INT AS page, kinds, CASE WHEN entity % 3 = 2 THEN 6 ELSE 3 END AS unit_scale, CASE entity % 3 WHEN 0 THEN 'ILS' WHEN 1 THEN 'USD' END AS currency
FROM e, (VALUES (3, 'BS'), (4, ''), (5, 'IS'), (6, '')) t(page, kinds) WHERE page <> 6 OR entity % 4 = 0""")
def _(spark, d):
    return P.statement_pages(report_pages(spark, d)).withColumn("kinds", F.array_join("kinds", ","))
