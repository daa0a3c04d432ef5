"""Statement tables in filings' pages to canonical facts.

A page's tables come as grids (:mod:`marlspan.sources.html_tables`), one row a
table. What a table is (statement, unit, currency, periods and the columns that
belong to them) is read from its header rows and the text before it by columns
over the grid, without a shuffle; its rows are then labelled, scaled and signed,
and facts of a filing that several rows tell are settled by one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspan.sources.html_tables import page_tables
from marlspan.sources.parsers import MONTHS, plain_number

from .label_rules import LABEL_RULES
from .lookup import labels, row_label
from .statements import approx_start, boundary, fiscal_half, fiscal_quarter, fiscal_year

# Words that tell a table's statement, unit, currency and duration, the first listed of those that end last.
KINDS = [
    ("IS", "statements? of (operations|income|earnings|profit or loss|profit and loss|comprehensive (income|loss))|income statements?|statements? of profit"),
    ("BS", "balance sheets?|statements? of financial position"),
    ("CF", "statements? of cash flows?|cash flows? statements?"),
]
UNITS = [
    (3, "in thousands|thousands of|\\(thousands\\)|\\b000s\\b|in nis thousands|nis in thousands"),
    (6, "in millions|millions of|\\(millions\\)|in nis millions|nis in millions"),
    (9, "in billions|billions of"),
]
CURRENCIES = [("USD", "u\\.?s\\.? ?dollars?|usd|\\bus\\$|\\$"), ("ILS", "\\bnis\\b|shekel|₪|\\bils\\b"), ("EUR", "\\beuros?\\b|\\beur\\b|€")]
DURATION_WORDS = [
    (3, "three months|3 months|quarter ended|quarterly|three month"),
    (6, "six months|6 months|half[- ]year|six month"),
    (9, "nine months|9 months|nine month"),
    (12, "twelve months|12 months|years? ended|fiscal year|year ending|full year|twelve month|year$"),
]
PLAIN_SHARES = "except (per share and )?share|except share|share and per share data|share amounts"
MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december"
#: Fields by how they add up where not as a flow or stock, and fields stored without their sign.
PER_SHARE = ["eps_basic", "eps_diluted"]
SHARE_COUNTS = ["shares_basic_weighted", "shares_diluted_weighted", "shares_outstanding"]
UNSIGNED = ["cost_of_revenue", "rnd_expense", "sga_expense", "other_operating_expense", "depreciation_amortization", "stock_based_comp", "interest_expense",
            "income_tax_expense", "capex", "acquisitions", "dividends_paid", "share_repurchases", "debt_repaid"]
#: A field that is the sum of two parts where no row tells it, and what it is called then.
SUMS = {"sga_expense": ("_selling_marketing", "_general_admin", "selling and marketing + general and administrative")}
#: Share counts from here on are whole numbers already; a "basic" figure beyond this one is a count.
WHOLE_SHARES, LEAST_COUNT = 1e8, 1e4
SOURCE, CONFIDENCE = "6k_parsed", 0.7


def last_told(text: Column, words: list[tuple]) -> Column:
    """The value whose pattern's last match in ``text`` ends last; null where none matches."""
    ends = [F.struct(F.length(F.regexp_extract(text, f"(?is)^.*(?:{p})", 0)).alias("end"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, (v, p) in enumerate(words)]
    best = F.array_max(F.array(*ends))
    return F.when(best["end"] > 0, best["v"])


def first_told(text: Column, words: list[tuple]) -> Column:
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), v) for v, p in words])


def _given(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once, however often lambdas in ``body`` use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed once per row. A plain projection would be
    written out anew into each later expression and filter that uses it; through
    a generator nothing is."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), " ")


_NAMES = sorted((n for m in MONTH_NAMES.split("|") for n in (m, m[:3])), key=lambda n: -len(n))
MONTH_DAY = f"(?i)\\b({'|'.join(_NAMES)})\\.?\\s+(\\d{{1,2}})\\b|\\b(\\d{{1,2}})\\s+({'|'.join(_NAMES)})\\b"


def month_day(text: Column) -> Column:
    """``struct(month, day)`` of the first month with a day, in either order."""
    part = lambda k: F.nullif(F.regexp_extract(text, MONTH_DAY, k), F.lit(""))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.coalesce(part(1), part(4)), 1, 3))).cast("int")
    day = F.coalesce(part(2), part(3)).try_cast("int")
    return F.when(month > 0, F.struct(month.alias("month"), day.alias("day")))


def clamped_date(year: Column, md: Column) -> Column:
    """The day of ``year``, or the month's last where it has no such day; no date for day 0."""
    first = F.make_date(year, md["month"], F.lit(1))
    return F.when(md["day"] > 0, F.date_add(first, F.least(md["day"], F.dayofmonth(F.last_day(first))) - 1))


def _rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def _told_periods(columns: Column) -> Column:
    """Columns ``(c, end, months)`` in order to periods ``(cols, end, months)``:
    a column goes to the period of the one beside it if they agree; a period
    that comes again elsewhere is left out."""
    empty = F.expr("cast(array() AS array<struct<cols: array<int>, `end`: date, months: int>>)")
    same = lambda p, x: (p["end"] == x["end"]) & p["months"].eqNullSafe(x["months"])
    one = lambda cols, x: F.struct(cols.alias("cols"), x["end"].alias("end"), x["months"].alias("months"))

    def step(found: Column, x: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        beside = last.isNotNull() & same(last, x) & (F.element_at(last["cols"], -1) == x["c"] - 1)
        longer = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(one(F.concat(last["cols"], F.array(x["c"])), x)))
        return F.when(beside, longer).when(F.exists(found, lambda p: same(p, x)), found).otherwise(F.concat(found, F.array(one(F.array(x["c"]), x))))

    return F.aggregate(columns, empty, step)


def statement_tables(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """The statement tables in ``filings``, a row each: the filing's columns and
    ``table_no, statement, unit_scale, currency, shares_scaled, periods, lines``
    (label and one value per period). Tables of fewer than three rows, without
    a statement's name or periods, or with fewer than three rows of values are
    none."""
    t = page_tables(filings, html_col).where(F.size("grid") >= 3)
    t = _with(t, nums=F.transform("grid", lambda r: F.transform(r, plain_number)))
    filled = lambda r, v: (F.get(r, 0) != "") & F.get(v, 0).isNull() & ~F.get(r, 0).rlike("^(19|20)\\d{2}$") & F.exists(_rest(v), lambda x: x != 0)
    t = _with(t, first=F.array_position(F.zip_with("grid", "nums", lambda r, v: F.coalesce(filled(r, v), F.lit(False))), True).cast("int"))
    t = _with(t, n_header=F.when(F.col("first") > 0, F.col("first") - 1).otherwise(F.size("grid"))).where("n_header > 0")
    t = _with(t, header=F.slice("grid", F.lit(1), F.col("n_header")))
    t = _with(t, told=_joined(F.col("header")))
    t = _with(t, statement=F.coalesce(last_told(F.col("told"), KINDS), last_told(F.col("context"), KINDS))).where("statement IS NOT NULL")
    t = _with(t, unit_scale=F.coalesce(last_told(F.col("told"), UNITS), last_told(F.col("context"), UNITS), F.lit(0)),
              currency=F.coalesce(first_told(F.col("told"), CURRENCIES), first_told(F.col("context"), CURRENCIES), F.lit("USD")),
              shares_scaled=~F.concat_ws(" ", "told", "context").rlike(f"(?i){PLAIN_SHARES}"),
              any_day=month_day(F.col("told")), any_months=last_told(F.col("told"), DURATION_WORDS), wide=F.array_max(F.transform("grid", lambda r: F.size(r))))
    years = lambda text: F.regexp_extract_all(text, F.lit("\\b((?:19|20)\\d{2})\\b"), F.lit(1))
    own = F.struct(F.col("header"), F.col("any_day"), F.col("any_months"), F.filter(F.sequence(F.lit(0), F.col("wide") - 1), lambda c: c > 0).alias("columns"))

    def periods(x: Column) -> Column:
        above = lambda c: F.array_join(F.filter(F.transform(x["header"], lambda r: F.get(r, c)), lambda v: v != ""), " ")
        texts = F.transform(x["columns"], lambda c: F.struct(c.alias("c"), above(c).alias("text")))
        dated = F.filter(texts, lambda y: (F.size(years(y["text"])) > 0) & ~F.contains(y["text"], F.lit("%")) & ~y["text"].rlike("(?i)\\bchange\\b"))
        ends = F.transform(dated, lambda y: F.struct(
            y["c"].alias("c"), clamped_date(F.element_at(years(y["text"]), -1).cast("int"), F.coalesce(month_day(y["text"]), x["any_day"])).alias("end"),
            F.coalesce(last_told(y["text"], DURATION_WORDS), x["any_months"]).alias("months")))
        return _told_periods(F.filter(ends, lambda y: y["end"].isNotNull()))

    t = _with(t, found=_given(own, periods)).where(F.size("found") > 0)

    def row(x: Column, cells: Column, nums: Column) -> Column:
        def one(p: Column) -> Column:
            inside = F.get(F.filter(F.transform(p["cols"], lambda c: F.get(nums, c)), lambda v: v.isNotNull()), 0)
            after = F.element_at(p["cols"], -1) + 1
            claimed = F.exists(x, lambda q: F.array_contains(q["cols"], after))
            return F.coalesce(inside, F.when(~claimed, F.get(nums, after)))

        return F.struct(F.get(cells, 0).alias("label"), F.transform(x, one).alias("values"), F.filter(_rest(nums), lambda v: v.isNotNull()).alias("every"))

    below = lambda c: F.slice(c, F.col("n_header") + 1, F.greatest(F.size(c) - F.col("n_header"), F.lit(0)))
    placed = _given(F.col("found"), lambda x: F.zip_with(below("grid"), below("nums"), lambda r, v: row(x, r, v)))
    # where columns don't meet their headers, values that are as many as the periods go to them in order
    none = lambda x: F.forall(x["values"], lambda v: v.isNull())
    labelled = F.filter(placed, lambda x: x["label"] != "")
    t = _with(t, lines=F.transform(labelled, lambda x: F.struct(
        x["label"].alias("label"), F.when(none(x) & (F.size(x["every"]) == F.size(x["values"])), x["every"]).otherwise(x["values"]).alias("values"))))
    t = t.where(F.size(F.filter("lines", lambda x: ~none(x))) >= 3)
    months = lambda p: F.when(F.col("statement") != "BS", p["months"])
    t = t.withColumn("periods", F.transform("found", lambda p: F.struct(p["end"].alias("end"), months(p).alias("months"))))
    return t.select(*[c for c in filings.columns if c != html_col], "table_no", "statement", "unit_scale", "currency", "shares_scaled", "periods", "lines")


def statement_lines(tables: DataFrame, rules: list[tuple] = LABEL_RULES) -> DataFrame:
    """A row for each line of the tables that has values: ``line, label, values``
    and by the rules ``field, sign``, null where no rule fits. A bare "basic" or
    "diluted" is told by the heading above it, or by its size."""
    keys = [c for c in tables.columns if c != "lines"]
    lines = tables.select(*keys, F.posexplode("lines").alias("line", "x")).select(*keys, "line", "x.*")
    empty = F.forall("values", lambda v: v.isNull())
    w = Window.partitionBy(*keys[:keys.index("table_no") + 1]).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("section", F.last(F.when(empty, F.col("label")), ignorenulls=True).over(w)).where(~empty)
    told = labels(lines, rules)
    plain, under = row_label(F.col("label")), row_label(F.coalesce("section", F.lit("")))
    value = F.get(F.filter("values", lambda v: v.isNotNull()), 0)
    counts = F.contains(under, F.lit("share")) & ~F.contains(under, F.lit("per")) | (F.abs(value) > LEAST_COUNT)
    bare = F.when(plain.isin("basic", "diluted"), F.when(counts, F.concat(F.lit("shares_"), plain, F.lit("_weighted"))).otherwise(F.concat(F.lit("eps_"), plain)))
    return told.withColumns({"field": F.coalesce(bare, "field"), "sign": F.when(bare.isNotNull(), 1).otherwise(F.col("sign"))}).drop("section")


def _scaled(value: Column) -> Column:
    by_unit = value * F.pow(F.lit(10.0), F.col("unit_scale"))
    count = F.when(F.col("shares_scaled") & (F.abs(value) < WHOLE_SHARES), by_unit).otherwise(value)
    scaled = F.when(F.col("field").isin(PER_SHARE), value).when(F.col("field").isin(SHARE_COUNTS), count).otherwise(by_unit)
    return F.when(F.col("field").isin(UNSIGNED), F.abs(scaled)).otherwise(scaled)


def _periods(end: Column, months: Column, fye: Column) -> Column:
    """What a column of a table reports: a quarter, half or year, and an instant the quarter and, at its end, the year."""
    last = F.month(boundary(end)) == fye
    one = lambda cond, kind, period, n: F.when(cond, F.struct(
        F.lit(kind).alias("period_type"), period.alias("fiscal_period"), (approx_start(end, n) if n else F.lit(None).cast("date")).alias("period_start")))
    quarter = F.concat(F.lit("Q"), fiscal_quarter(end, fye).cast("string"))
    half = F.concat(F.lit("H"), fiscal_half(end, fye).cast("string"))
    every = F.array(one(months.isNull(), "Q", quarter, 0), one(months.isNull() & last, "FY", F.lit("FY"), 0), one(months == 3, "Q", quarter, 3),
                    one(months == 6, "H", half, 6), one((months == 12) & last, "FY", F.lit("FY"), 12))
    return F.filter(every, lambda x: x.isNotNull())


def table_facts(lines: DataFrame, keys: list[str], fye_col: str = "fye") -> DataFrame:
    """The labelled lines of filings ``keys`` as facts: ``field, period_type,
    period_start, period_end, fiscal_year, fiscal_period, value, currency,
    unit_scale, concept, source, confidence``. Income statements come before
    balance sheets and cash flows, earlier tables and rows before later ones; a
    fact is told by the first. Parts of a sum make it where no row does."""
    known = lines.where("field IS NOT NULL")
    cells = known.select(*keys, fye_col, "field", "currency", "unit_scale", "shares_scaled", "label", "sign", F.arrays_zip("values", "periods").alias("cells"),
                         F.when(F.col("statement") == "IS", 0).when(F.col("statement") == "BS", 1).otherwise(2).alias("s"), "table_no", "line")
    cells = cells.select(*[c for c in cells.columns if c != "cells"], F.posexplode("cells").alias("at", "cell")).where("cell.values IS NOT NULL")
    end = F.col("cell.periods.end")
    x = cells.withColumn("period_end", end).select("*", F.posexplode(_periods(end, F.col("cell.periods.months"), F.col(fye_col))).alias("nth", "p"))
    count = F.col("field").isin(SHARE_COUNTS)
    x = x.select(
        *keys, "field", "p.period_type", "period_end", F.struct("s", "table_no", "line", "at", "nth").alias("order"), F.struct(
            "p.period_start", fiscal_year(F.col("period_end"), F.col(fye_col)).alias("fiscal_year"), "p.fiscal_period",
            _scaled(F.col("cell.values") * F.col("sign")).alias("value"), F.when(count, "").otherwise(F.col("currency")).alias("currency"),
            F.when(F.col("field").isin(PER_SHARE), 0).otherwise(F.col("unit_scale")).alias("unit_scale"), F.concat(F.lit("label:"), "label").alias("concept")).alias("fact"))
    parts = F.col("field").startswith("_")
    told = x.groupBy(*keys, "field", "period_type", "period_end").agg(
        F.min("order").alias("order"), F.when(parts, F.max_by("fact", "order")).otherwise(F.min_by("fact", "order")).alias("fact"))
    # per period: the parts, and the first fact, whose currency, unit and start a sum takes over
    period = [*keys, "period_type", "period_end"]
    by_period = told.groupBy(*period).agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("order", "fact").alias("x")))).alias("facts"),
        F.min_by("fact", F.when(~parts, F.col("order"))).alias("first"))

    def total(name: str, a: str, b: str, called: str) -> Column:
        at = lambda k: F.try_element_at("facts", F.lit(k))
        first = F.col("first")
        return F.when(at(name).isNull() & at(a).isNotNull() & at(b).isNotNull() & first.isNotNull(), F.struct(
            F.lit(name).alias("field"), first["period_start"].alias("period_start"), first["fiscal_year"].alias("fiscal_year"), first["fiscal_period"].alias("fiscal_period"),
            (at(a)["fact"]["value"] + at(b)["fact"]["value"]).alias("value"), first["currency"].alias("currency"), first["unit_scale"].alias("unit_scale"),
            F.lit(f"label:{called}").alias("concept")))

    own = F.transform(F.filter(F.map_entries("facts"), lambda e: ~e["key"].startswith("_")), lambda e: F.struct(e["key"].alias("field"), *[
        e["value"]["fact"][c].alias(c) for c in ("period_start", "fiscal_year", "fiscal_period", "value", "currency", "unit_scale", "concept")]))
    sums = F.filter(F.array(*[total(k, *v) for k, v in SUMS.items()]), lambda e: e.isNotNull())
    return by_period.select(*period, F.inline(F.concat(own, sums))).withColumns({"source": F.lit(SOURCE), "confidence": F.lit(CONFIDENCE)})


def table_report(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per table what was found: rows with values, rows that rules know, and the labels that none knows."""
    return lines.groupBy(*keys, "table_no", "statement", "unit_scale", "currency").agg(
        F.count("*").alias("n_lines"), F.count("field").alias("n_known"), F.sort_array(F.collect_list(F.when(F.col("field").isNull(), F.col("label")))).alias("unknown"))
