"""Names to keys: companies and their aliases, indicators, labels of statement
rows, symbols. Dictionaries are tables; a lookup is an equi join, with a second
one on the words at either end where names are qualified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .news import FINALS, PLAIN

# Words that end company names, and first words that don't stand for a company.
LEGAL = ["incorporated", "corporation", "company", "limited", "holdings", "holding", "group", "inc", "corp", "ltd", "plc", "llc", "co", "nv", "sa", "ag", "se", "lp", "adr", "ads", "the"]
COMMON_FIRST = ["nice", "check", "first", "united", "american", "general", "national", "international", "global", "new", "north", "south", "west", "east", "bank", "capital", "energy", "digital", "micro", "advanced", "applied",
                "alpha", "beta", "target", "gap", "ford", "visa", "block", "match", "snap", "square", "box", "zoom", "shell", "ball", "dollar", "tree", "monday", "wix"]


def _blank(text: Column, but: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s{but}]+", " "), "\\s+", " "))


def company_name(name: Column) -> Column:
    """Lower case without punctuation, legal forms at the end and articles in front."""
    plain = _blank(F.translate(F.lower(F.coalesce(name, F.lit(""))), FINALS, PLAIN), "")
    ends = "|".join(LEGAL)
    return F.regexp_replace(F.regexp_replace(plain, f"(?:^|\\s+)(?:{ends})(?:\\s+(?:{ends}))*$", ""), "^(?:the\\s+)+", "")


def mention_text(text: Column) -> Column:
    """Lower case with plain letters and quotes, other punctuation but $ to blanks."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), FINALS + "’׳", PLAIN + "''")
    return _blank(t, "$'")


def aliases(companies: DataFrame, common: list[str] = COMMON_FIRST) -> DataFrame:
    """``companies(ticker, name)`` as ``ticker, alias, weight``: the plain name; a
    one-word name with its legal form; and, lighter, a first word of four letters
    that isn't a common one."""
    n, raw = company_name(F.col("name")), F.split(_blank(F.lower("name"), ""), " ")
    words = F.split(n, " ")
    formed = (F.size(words) == 1) & (F.size(raw) > 1) & (F.get(raw, 0) == F.get(words, 0)) & F.get(raw, 1).isin([x for x in LEGAL if x != "the"])
    first = F.get(words, 0)
    short = (F.size(words) > 1) & (F.length(first) >= 4) & ~first.isin(common) & ~first.rlike("^\\d+$")
    one = lambda alias, weight: F.struct(alias.alias("alias"), F.lit(weight).alias("weight"))
    every = F.array(one(n, 1.0), one(F.when(formed, F.concat_ws(" ", first, F.get(raw, 1))), 1.0), one(F.when(short, first), 0.7))
    return companies.where(n != "").select("ticker", F.inline(every)).where("alias IS NOT NULL")


def indicator_name(name: Column) -> Column:
    """Lower case without brackets, ``m/m`` and the like as words, punctuation to blanks."""
    s = F.regexp_replace(F.lower(F.trim(name)), "\\([^)]*\\)", " ")
    for short, word in (("m/m", " mom "), ("y/y", " yoy "), ("q/q", " qoq "), ("q/y", " qoy "), ("&", " and ")):
        s = F.replace(s, F.lit(short), F.lit(word))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    s = F.substring(F.replace(indicator_name(name), F.lit(" "), F.lit("_")), 1, 60)
    return F.when(s == "", "event").otherwise(s)


def indicators(names: DataFrame, known: DataFrame) -> DataFrame:
    """``names(id, name, country)`` with ``event_key`` by ``known(event_key,
    country, alias, rank)``: an equal alias of the country first; else, of six
    letters on, one that the name begins or ends with, as whole words, the first
    by rank; else the country and the name's slug, ``found`` false. The name's
    beginnings and ends by words are its candidates, so both are equi joins."""
    k = known.select("country", indicator_name(F.col("alias")).alias("part"), F.struct("rank", "event_key").alias("hit")).groupBy("country", "part").agg(F.min("hit").alias("hit"))
    n = names.withColumn("plain", indicator_name(F.col("name")))
    words = F.split("plain", " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array(F.array_join(F.slice(words, F.lit(1), i), " "), F.array_join(F.slice(words, -i, i), " ")))
    parts = n.select("id", "country", "plain", F.explode(F.array_distinct(F.flatten(ends))).alias("part")).where((F.col("part") == F.col("plain")) | (F.length("part") >= 6))
    found = parts.join(k, ["country", "part"]).groupBy("id").agg(F.min(F.struct((F.col("part") != F.col("plain")).alias("partly"), "hit")).alias("best"))
    key = F.coalesce("best.hit.event_key", F.concat(F.lower("country"), F.lit("."), slug(F.col("name"))))
    return n.join(found, "id", "left").select("id", "name", "country", key.alias("event_key"), F.col("best").isNotNull().alias("found"))


def row_label(label: Column) -> Column:
    """A statement row's label: lower case, without bracketed qualifiers, notes, marks and punctuation."""
    s = F.translate(F.coalesce(label, F.lit("")), "’‘“”", "''\"\"")
    for pattern, by in (("\\([^()]*\\)", " "), ("\\[[^\\]]*\\]", " ")):
        s = F.regexp_replace(s, pattern, by)
    s = F.lower(s)
    for pattern, by in (("[*†‡]+", " "), ("[,'\":;.]", ""), ("[-–—/]", " "), ("\\bnote\\s*\\d+[a-z]?\\b", " "), ("\\s+", " ")):
        s = F.regexp_replace(s, pattern, by)
    return F.trim(s)


def labels(rows: DataFrame, rules: list[tuple[str, str, str, int, int]]) -> DataFrame:
    """``rows(statement, label)`` with ``field`` and ``sign`` by ``rules(statement
    or *, pattern, field, priority, sign)``: the first by priority that fits. A
    rule list is short and becomes one expression; nothing is joined."""
    plain = row_label(F.col("label"))
    hits = [F.when((plain != "") & (F.lit(s == "*") | (F.col("statement") == s)) & plain.rlike(p), F.struct(F.lit(f).alias("field"), F.lit(sign).alias("sign")))
            for s, p, f, _, sign in sorted(rules, key=lambda r: r[3])]
    return rows.withColumn("hit", F.coalesce(*hits)).select(*rows.columns, "hit.field", "hit.sign")


def symbol_score(query: str, ticker: Column, name: Column) -> Column:
    """How well a symbol answers a query: its ticker, the ticker's start, the name's start, a word's start."""
    q, t, n = F.lit(query.strip().lower()), F.lower(ticker), F.lower(name)
    return F.when(t == q, 100).when(t.startswith(q), 80 - F.length(t)).when(n.startswith(q), 60).when(F.contains(F.concat(F.lit(" "), n), F.concat(F.lit(" "), q)), 40).otherwise(0)


def symbols(df: DataFrame, query: str, limit: int) -> DataFrame:
    """``df(ticker, name)``: the best answers, shorter tickers first among equals."""
    if not query.strip():
        return df.withColumn("score", F.lit(0)).limit(0)
    scored = df.withColumn("score", symbol_score(query, F.col("ticker"), F.col("name"))).where("score > 0")
    return scored.orderBy(F.desc("score"), F.length("ticker"), "ticker").limit(limit)
