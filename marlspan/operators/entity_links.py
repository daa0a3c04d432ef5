"""Links from news items to the companies that their whole texts name.

Aliases are a table and meet the items in an equi join on one word of theirs,
the one that fewest aliases have; only items that have such a word, with the
aliases they may name, go on. There a text is a list of tokens (words, blanks,
other separators, apostrophes), aliases are matched as runs of tokens, from left
to right and the longest first, and names that are ordinary words count only
where they are capitalised and words near them speak of business.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from unicodedata import category

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import COMMON_FIRST, mention_text
from .news import FINALS, PLAIN

# Company names that are ordinary words too, and words near them that make them a company's.
COMMON_NAMES = COMMON_FIRST + [
    "icl", "tower", "apple", "amazon", "alphabet", "oracle", "meta", "intel", "adobe", "unity", "arm", "crown", "pool", "delta", "chase", "discover", "coach", "progressive", "southern",
    "dominion", "paramount", "fox", "ally", "citizens", "regions", "carrier", "republic", "nova", "partner", "phoenix", "best buy", "check point", "waste management",
]
COMMON_HEBREW = ["טבע", "לאומי", "הפועלים", "דלק", "בזק", "מזרחי", "דיסקונט", "פרטנר", "הפניקס", "נובה", "כיל"]
CONTEXT_WORDS = """
shares share shareholder shareholders stock stocks equity earnings eps revenue revenues sales profit profits
margin margins guidance outlook forecast results quarter quarterly q1 q2 q3 q4 fiscal ceo cfo coo executive
executives chairman analyst analysts investor investors invest invests invested investing investment stake
valuation overvalued undervalued overpriced trillion billion rating ratings upgrade upgrades upgraded downgrade
downgrades downgraded outperform underperform overweight underweight nasdaq nyse tase dow market markets
dividend dividends buyback buybacks repurchase ipo acquisition acquire acquires acquired merger takeover
lawsuit lawsuits sues sued antitrust regulator regulators regulatory settlement court doj ftc sec fda eu
penalty fined tariff tariffs supplier suppliers layoffs chipmaker
מניה מניות בורסה בורסת דוח דוחות רבעון הכנסות רווח רווחים הפסד הפסדים מכירות תחזית אנליסט אנליסטים משקיע
משקיעים דיבידנד רכישה רכישת מיזוג הנפקה שווי דולר מיליארד תביעה ייצוגית המלצה המלצת רגולטור מנכ"ל נאסד"ק ת"א
""".split()
CONTEXT_PHRASES = ["price target", "target price", "market cap", "market value", "chief executive", "wall street", "tech giant", "all time high", "מחיר יעד", "שווי שוק", "וול סטריט", "תל אביב 35"]
ACTION_VERBS = """
says said announces announced unveils unveiled launches launched reports reported releases released sues sued
files filed plans prepares acquires acquired buys bought sells sold hires appoints names cuts recalls faces
wins loses beats misses raises lowers agrees settles partners invests confirms denies delays expands warns posts
tops slips falls rises gains jumps drops slides surges soars tumbles plunges rallies climbs sinks hits touches
takes pulls moves bets debuts introduces reveals ships halts pauses explores
מדווחת דיווחה מודיעה הודיעה משיקה השיקה רוכשת רכשה מוכרת מכרה תובעת נתבעה מפטרת פיטרה מגייסת גייסה
מזנקת זינקה צונחת צנחה חותמת חתמה מציגה הציגה מעדכנת עדכנה
""".split()
ADVERBS = ["just", "now", "reportedly", "also", "quietly", "finally", "officially", "still"]
#: Letters that Hebrew puts before a name, and how many words around a name count.
PREFIX_LETTERS, WINDOW = "בלהומשכ", 8
QUOTE_PAGE = "\\b[A-Z]{1,6}\\d{6}[CP]\\d{8}\\b"
SYMBOL = "[A-Za-z]{1,6}(?:\\.[A-Za-z]{1,3})?"
EXCHANGES = "NASDAQ|NYSE|TASE|AMEX|NYSE\\s*American|NYSE\\s*Arca|OTC(?:QB|QX)?|LSE|TSX"
_WORD = "\\p{L}\\p{M}\\p{N}_"
_HEBREW = "[\\u0590-\\u05ff]"
#: Tokens around a name in which the words that count are looked for.
_REACH = 6 * WINDOW


@dataclass(frozen=True)
class Vocabulary:
    """The words that decide about names which are ordinary words."""

    common: list[str] = field(default_factory=lambda: COMMON_NAMES)
    common_hebrew: list[str] = field(default_factory=lambda: COMMON_HEBREW)
    context: list[str] = field(default_factory=lambda: CONTEXT_WORDS)
    phrases: list[str] = field(default_factory=lambda: CONTEXT_PHRASES)
    verbs: list[str] = field(default_factory=lambda: ACTION_VERBS)
    adverbs: list[str] = field(default_factory=lambda: ADVERBS)


def _plain(word: str) -> str:
    return word.lower().translate(str.maketrans(FINALS, PLAIN))


def _plain_letters(text: Column) -> Column:
    marks = FINALS + "’׳"
    return F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, PLAIN + "''")).otherwise(F.coalesce(text, F.lit("")))


def token_text(text: Column) -> Column:
    """Letters as they are, runs of separators as one ``","``, or ``" "`` for white space alone."""
    t = F.regexp_replace(_plain_letters(text), f"[^{_WORD}\\s$']+", ",")
    return F.regexp_replace(F.regexp_replace(t, "\\s+", " "), " ?,[ ,]*", ",")


def words(text: Column) -> Column:
    """The distinct words of a text, a dollar sign before one belonging to it; letters as they are."""
    t = F.regexp_replace(_plain_letters(text), f"[^{_WORD}$]+", " ")
    parted = F.when(F.contains(t, F.lit("$")), F.regexp_replace(t, "(?<=[^$ ])\\$", " \\$")).otherwise(t)
    return F.filter(F.array_distinct(F.split(parted, " ")), lambda w: w != "")


def alias_table(aliases: DataFrame) -> DataFrame:
    """``aliases(ticker, alias, weight)`` by their plain text: ``key, anchor,
    links``. The anchor is the word that fewest aliases have, the longest of those."""
    plain = aliases.select(F.upper("ticker").alias("ticker"), mention_text(F.col("alias")).alias("key"), "weight").where("key <> ''")
    known = plain.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ticker", "weight"))).alias("links"))
    parts = known.select("key", F.explode(words(F.col("key"))).alias("word"))
    often = parts.groupBy("word").agg(F.count("*").alias("n"))
    anchor = parts.join(often, "word").groupBy("key").agg(F.min_by("word", F.struct("n", -F.length("word"), "word")).alias("anchor"))
    return known.join(anchor, "key")


#: The tokens of a ``token_text``, whose separators are these three alone.
_TOKEN = re.compile(r"\$*[^$' ,]+|\$+|[' ,]")


class Matcher:
    """Where aliases stand among the tokens of a text, and whether they count there."""

    def __init__(self, v: Vocabulary):
        self.everyday = {*map(_plain, v.common), *map(_plain, v.common_hebrew)}
        self.context, self.phrases, self.verbs, self.adverbs = ({_plain(w) for w in x} for x in (v.context, v.phrases, v.verbs, v.adverbs))
        self.parts: dict[str, list[str]] = {}

    def _parts(self, key: str) -> list[str]:
        if key not in self.parts:
            self.parts[key] = _TOKEN.findall(key)
        return self.parts[key]

    def keys(self, text: str, known: Iterable[str]) -> list[tuple[str, str]]:
        """``(key, method)`` of the aliases ``known`` that a scan from the left
        takes, the longest at each place; an everyday name if any place of it counts."""
        told = _TOKEN.findall(text)
        low = [t.lower() for t in told]
        begins: dict[str, list[str]] = {}
        for key in sorted(known, key=lambda k: (-len(k), k)):
            begins.setdefault(self._parts(key)[0], []).append(key)
        prefixed = {w for w, keys in begins.items() if any(map(_is_hebrew, keys))}
        taken: dict[str, None] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        last = 0
        for i, word in enumerate(low):
            found = begins.get(word, ())
            if prefixed:
                # letters that Hebrew puts before a name
                cut = [word[k:] for k in (1, 2) if word[k:] in prefixed and all(c in PREFIX_LETTERS for c in word[:k])]
                if cut:
                    found = sorted([*found, *(key for w in cut for key in begins[w] if _is_hebrew(key))], key=lambda k: (-len(k), k))
            for key in found:
                parts = self._parts(key)
                end = i + len(parts)
                if end > len(low) or any(t != p and (t, p) != (",", " ") for t, p in zip(low[i + 1:end], parts[1:])):
                    continue
                if key in self.everyday:
                    places.setdefault(key, []).append((i, end))
                if i >= last:
                    taken[key] = None
                    last = end
        out = []
        for key in taken:
            if key not in self.everyday:
                out.append((key, "alias"))
            elif any(self.counts(told, *place, key) for place in places[key]):
                out.append((key, "context"))
        return out

    def counts(self, told: list[str], start: int, end: int, key: str) -> bool:
        """An everyday name needs its words parted by white space, a capital, and words of business near it."""
        first = told[start]
        if "," in told[start:end]:
            return False
        if _is_hebrew(key):
            # of the letters that Hebrew puts before words a name that is one takes these only
            if not re.fullmatch("ו?[בלש]?", first[:max(len(first) - len(key.split(" ")[0]), 0)]):
                return False
        elif category(first[0]) != "Lu":
            return False
        return self.speaks_of_business(told, start, end, key)

    def speaks_of_business(self, told: list[str], start: int, end: int, key: str) -> bool:
        """Whether the words around a name make it a company's: a verb of action
        right after it, or a word or phrase of business within ``WINDOW`` words,
        unless the name is itself a part of such a phrase."""
        left, right = _words(told[max(start - _REACH, 0):start])[-WINDOW:], _words(told[end:end + _REACH])[:WINDOW]
        genitive = right[:1] in (["'s"], ["s"])
        before, following, name = _bare(left), _bare(right), key.split(" ")
        after = following[1:] if genitive else following
        if before and f"{before[-1]} {name[0]}" in self.phrases or following and f"{name[-1]} {following[0]}" in self.phrases:
            return False
        if after and not genitive and after[1 if after[0] in self.adverbs and len(after) > 1 else 0] in self.verbs:
            return True
        return any(any(map(self._told, side)) or any(f"{a} {b}" in self.phrases for a, b in zip(side, side[1:])) for side in (before, after))

    def _told(self, word: str) -> bool:
        return word in self.context or _is_hebrew(word) and any(len(word) - k >= 2 and word[k:] in self.context for k in (1, 2))


def _is_hebrew(word: str) -> bool:
    return not word.isascii() and any("\u0590" <= c <= "\u05ff" for c in word)


def _words(told: list[str]) -> list[str]:
    """Tokens as the words between blanks."""
    return "".join(told).lower().replace(",", " ").split()


def _bare(words: list[str]) -> list[str]:
    """Words without the apostrophes at their ends and a genitive s."""
    return [w.strip("'").removesuffix("'s") for w in words]


def alias_links(items: DataFrame, aliases: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``items(item_id, text)`` and ``aliases(ticker, alias, weight)``:
    ``item_id, ticker, score, method``, method ``alias``, or ``context`` for
    names that are ordinary words, whose score is .8 at most."""
    v = vocabulary or Vocabulary()
    known = alias_table(aliases)
    own = items.select("item_id", F.explode(words(F.col("text"))).alias("token")).select("item_id", F.lower("token").alias("word"))
    bare = lambda k: F.when(F.substring("word", 1, k).rlike(f"^[{PREFIX_LETTERS}]{{{k}}}$"), F.substring("word", F.lit(k + 1), F.length("word")))
    forms = F.when(F.col("word").rlike(_HEBREW), F.filter(F.array(F.col("word"), bare(1), bare(2)), lambda w: w.isNotNull())).otherwise(F.array("word"))
    asked = own.select("item_id", F.explode(forms).alias("anchor"))
    may = asked.join(known.select("anchor", "key"), "anchor").groupBy("item_id").agg(F.collect_set("key").alias("known"))
    told = items.select("item_id", token_text(F.col("text")).alias("text")).join(may, "item_id")
    matcher = Matcher(v)

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *found) for i, text, known in zip(b["item_id"], b["text"], b["known"]) for found in matcher.keys(text, known)]
            yield pd.DataFrame(rows, columns=["item_id", "key", "method"])

    keys = told.mapInPandas(matched, f"item_id {dict(items.dtypes)['item_id']}, key string, method string")
    hits = keys.join(known.select("key", "links"), "key").select("item_id", "method", F.inline("links"))
    return hits.select("item_id", "ticker", F.when(F.col("method") == "context", F.least("weight", F.lit(0.8))).otherwise(F.col("weight")).alias("score"), "method")


def symbol_links(items: DataFrame, known: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Tickers of ``known(ticker)`` that texts name as such: with an exchange .95,
    as a cashtag or in brackets .9, and as a bare word of four capitals .6 where
    the text has small letters and the ticker is no ordinary word."""
    v = vocabulary or Vocabulary()
    raw = F.when(F.col("text").rlike("[’׳]"), F.translate("text", "’׳", "''")).otherwise(F.col("text"))
    found = lambda p, k=1: F.regexp_extract_all(raw, F.lit(p), F.lit(k))
    marked = lambda mark, p: F.when(F.contains("text", F.lit(mark)), found(p))
    bare = F.filter(found("[A-Za-z][A-Za-z.]{0,7}", 0), lambda w: (w == F.upper(w)) & (F.length(F.translate(w, ".", "")) >= 4) & ~F.lower(w).isin(v.common))
    kinds = [(marked(":", f"(?i)(?=[{''.join(sorted({x[0] for x in EXCHANGES.split('|')}))}])\\b(?:{EXCHANGES})\\s*:\\s*({SYMBOL})\\b"), 0.95, "cashtag"), (marked("$", f"(?<![{_WORD}$])\\$({SYMBOL})\\b"), 0.9, "cashtag"),
             (marked("(", "\\(([A-Z]{1,6}(?:\\.[A-Z]{1,3})?)\\)"), 0.9, "cashtag"), (F.when(raw.rlike("\\p{Ll}"), bare), 0.6, "alias")]
    scored = lambda tickers, score, method: F.transform(F.coalesce(tickers, F.array().cast("array<string>")), lambda t: F.struct(
        F.upper(t).alias("ticker"), F.lit(score).alias("score"), F.lit(method).alias("method")))
    every = F.flatten(F.array(*[scored(*kind) for kind in kinds]))
    return items.select("item_id", F.explode(F.array_distinct(every)).alias("x")).select("item_id", "x.*").join(known.select(F.upper("ticker").alias("ticker")).distinct(), "ticker", "left_semi")


def link_entities(items: DataFrame, aliases: DataFrame, known: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``items(item_id, text, provided)``, ``provided`` a map of tickers to scores
    or null: ``item_id, ticker, score, method``, one row for each item and
    ticker, the best score; of equal ones a provider's, then a symbol's, an
    alias's and a context's. Pages of option quotes have their provider's links only."""
    told = items.where(~F.coalesce(F.col("text").rlike(QUOTE_PAGE), F.lit(True)))
    given = items.select("item_id", F.explode("provided").alias("ticker", "score")).where("ticker <> ''").select(
        "item_id", F.upper("ticker").alias("ticker"), F.coalesce("score", F.lit(0.8)).alias("score"), F.lit("provider").alias("method"))
    every = reduce(DataFrame.unionByName, [given, symbol_links(told, known, vocabulary), alias_links(told, aliases, vocabulary)])
    rank = F.array_position(F.array(*map(F.lit, ("provider", "cashtag", "alias", "context"))), F.col("method"))
    best = every.groupBy("item_id", "ticker").agg(F.max_by(F.struct("score", "method"), F.struct("score", -rank)).alias("x"))
    return best.select("item_id", "ticker", F.round(F.least(F.lit(1.0), F.col("x.score")), 3).alias("score"), "x.method")
