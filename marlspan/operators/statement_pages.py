"""Pages of reports that hold financial statements, from the pages' texts.

What a page is follows from its own text: headings of statements, figures,
contents. Which pages belong to a document's statements follows from windows
over its pages in order. Extractors may give Hebrew lines in visual order, so a
page is read as it is and with each line turned around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings of statements, notes of units with scale and currency in the order in which they are tried, words of contents pages.
HEADINGS = {
    "BS": ["דוח(?:ות)?(?:\\s+\\S+){0,3}\\s+על\\s+ה?מצב\\s+ה?כספי", "מאזן(?:ים)?(?:\\s+מאוחד(?:ים)?)?\\b", "statements? of financial position", "balance sheets?"],
    "IS": ["דוח(?:ות)?(?:\\s+\\S+){0,3}\\s+(?:רווח\\s+והפסד|רווח\\s+או\\s+הפסד|על\\s+ה?רווח\\s+(?:ה?כולל|או\\s+ה?הפסד|והפסד))", "דוח(?:ות)?\\s+רווח\\s+והפסד",
           "statements? of profit or loss", "statements? of comprehensive income", "income statements?", "statements? of operations"],
    "CF": ["דוח(?:ות)?(?:\\s+\\S+){0,3}\\s+על\\s+תזרימי\\s+ה?מזומנים", "דוח(?:ות)?\\s+תזרימי\\s+מזומנים", "statements? of cash flows?"],
}
UNIT_NOTES = [
    ('באלפי ש"ח', 3, "ILS"), ('אלפי ש"ח', 3, "ILS"), ('במיליוני ש"ח', 6, "ILS"), ('מיליוני ש"ח', 6, "ILS"), ("באלפי שקלים", 3, "ILS"), ("במיליוני שקלים", 6, "ILS"), ("באלפי דולר", 3, "USD"),
    ("אלפי דולר", 3, "USD"), ("במיליוני דולר", 6, "USD"), ("nis in thousands", 3, "ILS"), ("nis in millions", 6, "ILS"), ("u.s. dollars in thousands", 3, "USD"), ("usd in thousands", 3, "USD"),
    ("in thousands", 3, None), ("in millions", 6, None),
]
CONTENTS = ["תוכן עניינים", "תוכן העניינים", "table of contents"]
NUMBER = "\\(?\\d{1,3}(?:,\\d{3})+\\)?|\\(?\\d{4,}\\)?"
#: Figures that a page of a statement has at least, statements that a contents page names at least, pages that a document gives at most.
LEAST_FIGURES, LISTED, MOST_PAGES = 12, 3, 14


def _plain(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), "״׳“” ", "\"'\"\" ")
    t = F.regexp_replace(F.replace(t, F.lit("''"), F.lit('"')), "[\\u0591-\\u05c7]", "")
    return F.lower(F.regexp_replace(t, "[ \\t]+", " "))


def _either(test, plain: Column, turned: Column) -> Column:  # noqa: ANN001
    return test(plain) | test(turned)


def page_facts(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, text)`` as ``doc_id, page, figures, kinds, contents,
    unit``: figures on the page, statements that it heads, whether it is a page
    of contents, and its note of units."""
    p = pages.select("doc_id", "page", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NUMBER)).alias("figures"), F.inline(F.array(F.struct(_plain(F.col("text")).alias("plain")))))
    p = p.withColumn("turned", F.array_join(F.transform(F.split("plain", "\n"), lambda x: F.reverse(x)), "\n"))
    both = lambda test: _either(test, F.col("plain"), F.col("turned"))
    heads = lambda patterns: both(lambda t: t.rlike("|".join(f"(?:{x})" for x in patterns)))
    kinds = F.filter(F.array(*[F.when(heads(v), k) for k, v in HEADINGS.items()]), lambda k: k.isNotNull())
    note = lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(n)), F.struct(F.lit(s).alias("scale"), F.lit(c).cast("string").alias("currency"))) for n, s, c in UNIT_NOTES])
    contents = both(lambda t: F.lit(False) if not CONTENTS else t.rlike("|".join(CONTENTS)))
    p = p.select("doc_id", "page", "figures", F.inline(F.array(F.struct(kinds.alias("kinds"), contents.alias("named"), F.coalesce(note(F.col("plain")), note(F.col("turned"))).alias("unit")))))
    listing = (F.size("kinds") >= LISTED) & (F.col("figures") < LEAST_FIGURES)
    return p.select("doc_id", "page", "figures", "kinds", (F.col("named") | listing).alias("contents"), "unit")


def statement_pages(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """The statements' pages of each document, at most ``most``: ``doc_id, page,
    kinds, unit_scale, currency``. A page counts that heads a statement and has
    figures, and the one after it if it has figures and heads none itself. Unit
    and currency are the document's: the first that a heading page tells, else
    the first that any of its pages does."""
    order = Window.partitionBy("doc_id").orderBy("page")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = page_facts(pages).withColumn("heads", (F.size("kinds") > 0) & ~F.col("contents") & (F.col("figures") >= LEAST_FIGURES))
    p = p.withColumn("follows", F.lag("heads", 1, False).over(order) & (F.lag("page").over(order) == F.col("page") - 1) & ~F.col("heads") & (F.col("figures") >= LEAST_FIGURES))
    p = p.withColumn("by_heading", F.first(F.when(F.col("heads"), F.col("unit")), ignorenulls=True).over(whole)).where("heads OR follows")
    p = p.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    unit = F.coalesce("by_heading", F.first("unit", ignorenulls=True).over(whole))
    return p.select("doc_id", "page", F.when(F.col("heads"), F.col("kinds")).otherwise(F.array().cast("array<string>")).alias("kinds"), unit.alias("unit")).select(
        "doc_id", "page", "kinds", F.col("unit.scale").alias("unit_scale"), F.col("unit.currency").alias("currency"))
