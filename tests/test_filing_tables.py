"""Grids of awkward tables, and a filing read as a person would read it."""

from datetime import date

import pytest

from marlspan.operators import filing_tables as T
from marlspan.sources.html_tables import grids


def test_spans_fill_the_grid():
    html = ("<p>before</p><table><tr><th rowspan=2>a<th colspan=2>b</tr><tr><td>c<td>d</tr><tr><td></td></tr><tr><td colspan='x'>e &amp;&nbsp;f</td><td rowspan='0'>g</td></tr></table>"
            "<script>no</script><p>between</p><table><tr><td>h<table><tr><td>inner</td></tr></table></td><td>i</td></tr>")
    first, second, inner = grids(html)
    assert first == (0, "before", [["a", "b", "b"], ["a", "c", "d"], ["e & f", "g"]])
    assert second[2] == [["h inner", "i"]] and inner[2] == [["inner"]]
    assert second[1].endswith("g between") and "no" not in second[1]  # cells of the table before are context too
    assert grids("") == [] and grids("<table>") == [(0, "", [])]


PAGE = """<h1>Example reports</h1><p><b>CONSOLIDATED STATEMENTS OF INCOME</b></p><p>U.S. dollars in thousands, except per share data</p>
<table><tr><td></td><td colspan='2'>Three months ended June 30,</td><td colspan='2'>Six months ended June 30,</td><td>% change</td></tr>
<tr><td></td><td colspan='2'>2024</td><td colspan='2'>2024</td><td>2024</td></tr>
<tr><td>Revenues</td><td>$</td><td>1,500</td><td>$</td><td>2,900</td><td>7%</td></tr><tr><td>Cost of revenues (Note 4)</td><td></td><td>(900)</td><td></td><td>(1,700)</td><td></td></tr>
<tr><td>Operating income</td><td></td><td></td><td></td><td></td><td></td><td>270</td><td>540</td></tr><tr><td>Unheard of</td><td></td><td>3</td><td></td><td>4</td></tr>
<tr><td>Earnings per share attributable to shareholders:</td><td></td></tr><tr><td>Basic</td><td>$</td><td>0.21</td><td>$</td><td>0.40</td></tr>
<tr><td>Weighted average number of shares outstanding:</td><td></td></tr><tr><td>Basic</td><td></td><td>1,000,000</td><td></td><td>1,000,500</td></tr></table>
<p>BALANCE SHEETS</p><p>in millions</p><table><tr><td></td><td>30 June 2024</td><td>31 December 2023</td></tr>
<tr><td>Total assets</td><td>1,800</td><td>1,700</td></tr><tr><td>Cash and cash equivalents</td><td>—</td><td>5</td></tr><tr><td>Goodwill</td><td>12.5</td><td>-3</td></tr></table>
<p>Contacts</p><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr><tr><td>c</td><td>3</td></tr></table>"""


@pytest.fixture(scope="module")
def facts(spark):
    filings = spark.createDataFrame([("x", 12, PAGE), ("null", 12, None), ("none", 12, "<p>no tables")], "filing string, fye int, html string")
    lines = T.statement_lines(T.statement_tables(filings)).persist()
    return lines, {(r["field"], r["period_type"], r["period_end"]): r for r in T.table_facts(lines, ["filing"]).collect()}


def test_periods_units_and_signs(facts):
    _, by = facts
    q, h = date(2024, 6, 30), date(2023, 12, 31)
    rev = by["revenue", "Q", q]
    assert (rev["value"], rev["period_start"], rev["fiscal_period"], rev["unit_scale"], rev["currency"]) == (1_500_000, date(2024, 4, 1), "Q2", 3, "USD")
    assert by["revenue", "H", q]["value"] == 2_900_000 and by["revenue", "H", q]["period_start"] == date(2024, 1, 1) and by["revenue", "H", q]["fiscal_period"] == "H1"
    assert by["cost_of_revenue", "Q", q]["value"] == 900_000  # stored without its sign
    assert by["operating_income", "H", q]["value"] == 540_000  # two values for two periods, out of their columns
    assert by["eps_basic", "Q", q]["value"] == 0.21 and by["eps_basic", "Q", q]["unit_scale"] == 0
    # "except per share data" leaves share counts in thousands
    assert by["shares_basic_weighted", "Q", q]["value"] == 1_000_000_000 and by["shares_basic_weighted", "Q", q]["currency"] == ""
    assert by["total_assets", "FY", h]["value"] == 1_700e6 and by["total_assets", "Q", h]["fiscal_period"] == "Q4" and ("total_assets", "FY", q) not in by
    assert by["cash_and_equivalents", "Q", q]["value"] == 0 and by["goodwill", "FY", h]["value"] == -3e6


def test_report_names_unknown_labels(facts):
    lines, _ = facts
    report = {r["table_no"]: (r["statement"], r["n_lines"], r["n_known"], r["unknown"]) for r in T.table_report(lines, ["filing"]).collect()}
    assert report == {0: ("IS", 6, 5, ["Unheard of"]), 1: ("BS", 3, 3, [])}


def test_words(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        T.last_told(F.lit("Three months ended, and six months"), T.DURATION_WORDS).alias("months"), T.last_told(F.lit("nothing"), T.KINDS).alias("kind"),
        T.clamped_date(F.lit(2023), T.month_day(F.lit("as of February 31"))).alias("day"), T.month_day(F.lit("on 7 sep")).alias("md"), T.clamped_date(F.lit(2023), T.month_day(F.lit("May 0"))).alias("zero")).first()
    assert (row["months"], row["kind"], row["day"], tuple(row["md"]), row["zero"]) == (6, None, date(2023, 2, 28), (9, 7), None)
