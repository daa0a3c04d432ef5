"""News: URL and title normalising, language, simhash and clustering, entity
links, importance, rails."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspan.sources.files import kept, shared

# Query parameters that say how a link was reached, not what it is.
TRACKING = [
    "fbclid", "gclid", "dclid", "yclid", "msclkid", "igshid", "ref", "ref_src", "ref_url", "mc_cid", "mc_eid", "_ga", "_gl", "ocid",
    "cmpid", "ncid", "sref", "srnd", "oc", "output", "guccounter", "guce_referrer", "guce_referrer_sig",
]
# Letters of one sound or shape, as they are and as they are compared.
FINALS, PLAIN = "ךםןףץ", "כמנפצ"
QUOTES, STRAIGHT = "’‘“”״׳", "''\"\"\"'"
# Character references that feeds leave in texts, in the order in which they are decoded.
REFERENCES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]


def decoded_link(url: Column) -> Column:
    """The address that a link of the old article format holds in base64, else null."""
    token = F.translate(F.regexp_extract(url, "news\\.google\\.com/(?:rss/)?articles/([A-Za-z0-9_-]+)", 1), "-_", "+/")
    padded = F.rpad(token, (F.ceil(F.length(token) / 4) * 4).cast("int"), "=")
    inside = F.regexp_extract(F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1"), "http[\\x21-\\x7e]*", 0)
    return F.when(inside.rlike("^https?://") & F.contains(inside, F.lit(".")), inside)


def canonical_url(url: Column) -> Column:
    """https for http, lower-case host without www, no fragment, no tracking or
    blank parameters, the others sorted, no closing slash; nested links decoded."""
    u = F.trim(F.coalesce(decoded_link(url), url))
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(u, "\\?([^#]*)", 1), "&")
    parts = F.transform(query, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
                                                  F.try_url_decode(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).alias("v")))
    kept = F.array_sort(F.filter(parts, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(TRACKING) & ~F.lower(p["k"]).startswith("utm_")))
    line = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    whole = F.concat(F.when(scheme.isin("http", "https"), "https").otherwise(scheme), F.lit("://"), host, F.when(path == "", "/").otherwise(path),
                     F.when(F.size(kept) > 0, F.concat(F.lit("?"), line)).otherwise(""))
    return F.when(F.coalesce(u, F.lit("")) == "", "").otherwise(whole)


def url_hash(url: Column) -> Column:
    """The first 40 hex digits of the canonical address's digest; empty for none."""
    c = canonical_url(url)
    return F.when(c == "", "").otherwise(F.substring(F.sha2(c.cast("binary"), 256), 1, 40))


def normalize_title(title: Column, publisher: Column | None = None) -> Column:
    """Lower case with plain quotes and letters, a publisher's name of up to five
    words after a dash, bar or colon taken off the end of titles that keep 20
    characters, punctuation but $ and % to blanks."""
    t = F.trim(F.translate(F.translate(F.coalesce(title, F.lit("")), QUOTES, STRAIGHT), FINALS, PLAIN))
    if publisher is not None:
        named = F.lower(F.trim(publisher))
        tail = F.lower(F.regexp_extract(t, "\\s+[-–—|:]\\s+(.*?)\\s*$", 1))
        t = F.when((named != "") & (tail == named), F.regexp_replace(t, "\\s+[-–—|:]\\s+.*?\\s*$", "")).otherwise(t)
    end = "\\s+[-–—|:]\\s+([^-–—|]{2,40})$"
    name, rest = F.regexp_extract(t, end, 1), F.regexp_replace(t, end, "")
    cut = (name != "") & (F.length(F.trim(rest)) >= 20) & (F.size(F.split(F.trim(name), "\\s+")) <= 5)
    t = F.lower(F.when(cut, rest).otherwise(t))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^\\p{L}\\p{M}\\p{N}_\\s$%]+", " "), "\\s+", " "))


def strip_html(text: Column) -> Column:
    """Tags to blanks, the common character references decoded, white space to single blanks."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def detect_lang(text: Column) -> Column:
    """``he`` where more than 30 % of the letters are Hebrew, else ``en``."""
    hebrew, letters = F.regexp_count(text, F.lit("[\\u0590-\\u05ff]")), F.regexp_count(text, F.lit("\\p{L}"))
    return F.when((letters > 0) & (hebrew > 0.3 * letters), "he").otherwise("en")


_WORD = re.compile(r"[\w$%]+")
_TO_PLAIN = str.maketrans(FINALS, PLAIN)


def _features(text: str | None) -> Counter:
    """Words (weight 1) and pairs of neighbouring words (2); words of one letter don't count."""
    words = [w for w in _WORD.findall((text or "").lower().translate(_TO_PLAIN)) if len(w) > 1]
    weights = Counter(words)
    for p in zip(words, words[1:]):
        weights[" ".join(p)] += 2
    return weights


def simhashes(texts: Iterable[str | None]) -> np.ndarray:
    """Signed 64-bit simhashes. Every feature of the batch is hashed once; the
    votes of all texts' features on all bits are one sum of an unpacked matrix."""
    known: dict[str, bytes] = {}
    digests, weights, counts = [], [], []
    for text in texts:
        found = _features(text)
        for f in found:
            raw = known.get(f)
            if raw is None:
                raw = known[f] = hashlib.blake2b(f.encode(), digest_size=8).digest()
            digests.append(raw)
        weights.extend(found.values())
        counts.append(len(found))
    n, out = np.array(counts, np.int64), np.zeros(len(counts), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        signed = np.where(bits == 1, 1, -1).astype(np.int32) * np.array(weights, np.int32)[:, None]
        votes = np.add.reduceat(signed, (np.cumsum(n) - n)[some], axis=0)
        out[some] = np.ascontiguousarray(np.packbits(votes > 0, axis=1)).view(">u8").astype(np.uint64).view(np.int64).reshape(-1)
    return out


#: Texts whose votes are summed up together.
SIMHASH_TEXTS = 64


@F.pandas_udf(T.LongType())
def simhash64(text: pd.Series) -> pd.Series:
    """Signed 64-bit simhash over words (weight 1) and word pairs (2)."""
    parts = [simhashes(text.iloc[i:i + SIMHASH_TEXTS]) for i in range(0, len(text), SIMHASH_TEXTS)]
    return pd.Series(np.concatenate(parts) if parts else np.empty(0, np.int64))


def hamming_pairs(df: DataFrame, most: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs ``(a, b, distance)`` of ``df(id, hash)`` at most ``most`` bits apart;
    empty texts (hash 0) are near nothing.

    The 64 bits are ``blocks`` blocks; of two near hashes ``blocks - most`` blocks
    agree, so pairs meet by each choice of that many: 20 keys of 32 bits for six
    blocks, which few hashes share by chance. Equal hashes are collapsed first,
    their pairs given to the smallest id. ``df`` is read several times: where the
    hash is worked out, write it down first.
    """
    df = df.where("hash <> 0")
    hashes = df.groupBy("hash").agg(F.min("id").alias("id"))
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("hash", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    choices = F.array(*[F.array(*[F.lit(k) for k in chosen]) for chosen in combinations(range(blocks), blocks - most)])
    dealt = hashes.select("id", "hash", F.array(*part).alias("parts"), F.posexplode(choices).alias("choice", "chosen"))
    banded = dealt.select("id", "hash", "choice", F.xxhash64(F.transform("chosen", lambda k: F.get("parts", k))).alias("bits"))
    # from the size of a table of numbers Spark can't tell that this is 20 rows for each: no side may be broadcast
    other = banded.select(F.col("id").alias("b"), F.col("hash").alias("hash_b"), "choice", "bits").hint("merge")
    near = banded.withColumnRenamed("id", "a").join(other, ["choice", "bits"]).where("a < b")
    near = near.withColumn("distance", F.bit_count(F.col("hash").bitwiseXOR(F.col("hash_b")))).where(F.col("distance") <= most)
    copies = df.join(hashes.withColumnRenamed("id", "a").hint("merge"), "hash").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near.select("a", "b", "distance").distinct().unionByName(copies)


def _common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence, a bit of an integer for each character of ``x``."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(x)) - 1
    row = whole
    for c in y:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(x) - row.bit_count()


def title_ratio(x: str | None, y: str | None, least: float = 0.0) -> float:
    """Similarity of two titles by their shared and remaining words, 0 to 100.
    Comparisons that their lengths keep below ``least`` are not made."""
    p, q = set((x or "").split()), set((y or "").split())
    if not p or not q:
        return 0.0
    both, left, right = " ".join(sorted(p & q)), " ".join(sorted(p - q)), " ".join(sorted(q - p))
    if both and (not left or not right):
        return 100.0
    u, v = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = 0.0
    for a, b in ((u, v), (both, u), (both, v)):
        total = len(a) + len(b)
        if a and b and 200.0 * min(len(a), len(b)) / total >= max(least, best):
            best = max(best, 200.0 * _common_length(a, b) / total)
    return best


def _worded(title: str | None) -> tuple[frozenset[str], int]:
    """A title's words and their length in one line."""
    words = frozenset((title or "").split())
    return words, sum(map(len, words)) + len(words) - 1


def _alike(x: tuple[frozenset[str], int], y: tuple[frozenset[str], int], least: float) -> bool:
    """Whether two titles' ``title_ratio`` is ``least`` or more. The shared words
    begin both lines compared, so only the remaining ones need a subsequence."""
    (p, m), (q, n) = x, y
    if not p or not q:
        return least <= 0.0
    both = p & q
    if len(both) == len(p) or len(both) == len(q):
        return least <= 100.0
    begun = sum(map(len, both)) + len(both)
    if both and 200.0 * (begun - 1) / (begun - 1 + min(m, n)) >= least:
        return True
    if 200.0 * min(m, n) / (m + n) < least:
        return False
    return 200.0 * (begun + _common_length(" ".join(sorted(p - q)), " ".join(sorted(q - p)))) / (m + n) >= least


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_ratio(x, y) for x, y in zip(a, b)])


#: Clusters are worked out in blocks of so many times the hours that an item looks back.
CLUSTER_BLOCK = 8


def cluster_in_order(items: DataFrame, hours: int = 48, most: int = 3, least_ratio: float = 90.0, block: int = CLUSTER_BLOCK) -> DataFrame:
    """Greedy clusters per ticker in order of arrival, ``ticker, item_id, cluster_id``.

    ``items(ticker, item_id, published_at, kind, url_hash, title, hash)``. An
    item joins the cluster of the latest earlier item within ``hours`` that has
    its address, else of the latest whose title is similar, else of the latest
    whose simhash is near; otherwise, and for every filing, it starts one.

    Which item one joins depends on no cluster, so a ticker's history is cut into
    blocks that get the items of the ``hours`` before them too. In a block items
    are led to the first of their cluster or to an item of an earlier block; the
    latter are led on by joins, each of which doubles the blocks gone back.
    Items without a time start clusters of their own.
    """
    timed = items.where(F.col("published_at").isNotNull())
    # seconds by the clock, whatever the zone of the session
    when = F.col("published_at")
    second = F.datediff(F.to_date(when), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(when) * 3600 + F.minute(when) * 60 + F.second(when)
    length = block * hours * 3600
    own = F.floor(second / F.lit(length))
    dealt = timed.withColumn("at", second).select("*", F.explode(F.array_distinct(F.array(own, F.floor((F.col("at") + F.lit(hours * 3600)) / F.lit(length))))).alias("block"))

    def grouped(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["published_at", "item_id"]).reset_index(drop=True)
        at = g["at"].to_numpy("int64")
        hashes = g["hash"].to_numpy("int64").astype("uint64")
        ids, kinds, urls, titles = g["item_id"].tolist(), g["kind"].tolist(), g["url_hash"].tolist(), [_worded(t) for t in g["title"]]
        begin = int(np.searchsorted(at, key[1] * length))
        lead, open_ = list(ids), np.arange(len(g)) < begin
        first, last_of = 0, {}
        for i in range(len(g)):
            while at[first] < at[i] - hours * 3600:
                first += 1
            found = None
            if i >= begin and kinds[i] != "filing":
                found = last_of.get(urls[i]) if urls[i] else None
                if found is None or found < first:
                    found = next((k for k in range(i - 1, first - 1, -1) if _alike(titles[k], titles[i], least_ratio)), None)
                if found is None and hashes[i]:
                    near = np.flatnonzero((np.bitwise_count(hashes[first:i] ^ hashes[i]) <= most) & (hashes[first:i] != 0))
                    found = first + int(near[-1]) if len(near) else None
            if found is not None:
                lead[i], open_[i] = lead[found], open_[found]
            last_of[urls[i]] = i
        return g.assign(cluster_id=lead, open=open_)[["ticker", "item_id", "cluster_id", "open"]].iloc[begin:]

    # the rows are small and the work on them is not: as many tasks as the session asks for
    dealt = dealt.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker", "block")
    led = dealt.groupBy("ticker", "block").applyInPandas(grouped, "ticker string, item_id long, cluster_id long, open boolean")
    path = f"{shared(items.sparkSession)}/clusters"
    led = kept(led, path)
    while not led.where("open").isEmpty():
        on = led.groupBy(F.col("ticker").alias("of"), F.col("item_id").alias("at")).agg(F.min_by(F.struct("cluster_id", "open"), "cluster_id").alias("next"))
        further = led.where("open").join(on, F.col("ticker").eqNullSafe(F.col("of")) & (F.col("cluster_id") == F.col("at")))
        led = kept(led.where("not open").unionByName(further.select("ticker", "item_id", "next.*")), path)
    untimed = items.where(F.col("published_at").isNull()).select("ticker", F.col("item_id").cast("long"), F.col("item_id").cast("long").alias("cluster_id"))
    return led.drop("open").unionByName(untimed)


def earlier_within(items: DataFrame, hours: int) -> DataFrame:
    """``item_id, other_id``: the earlier items (by time, then id) of the same
    ticker within ``hours``. An equi join on blocks of that length and the block
    before, no range join."""
    block = F.floor(F.unix_micros(F.col("published_at").cast("timestamp")) / F.lit(hours * 3_600_000_000))
    a = items.select("ticker", "item_id", "published_at", block.alias("block"))
    b = items.select("ticker", F.col("item_id").alias("other_id"), F.col("published_at").alias("other_at"), F.explode(F.array(block, block + 1)).alias("block"))
    later = (F.col("other_at") < F.col("published_at")) | (F.col("other_at") == F.col("published_at")) & (F.col("other_id") < F.col("item_id"))
    return a.join(b, ["ticker", "block"]).where(later & (F.col("other_at") >= F.col("published_at") - F.make_dt_interval(F.lit(0), F.lit(hours)))).select("item_id", "other_id")


def daily_stats(items: DataFrame) -> DataFrame:
    """Items and mean sentiment per ticker and day."""
    return items.groupBy("ticker", F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"), F.avg("sentiment").alias("sentiment"))


def rail(items: DataFrame) -> DataFrame:
    """Per ticker of ``items(ticker, published_at, cluster_id, read, sentiment)``:
    items, hours that have any, the most in one hour, distinct unread clusters,
    and the mean of the hours' mean sentiments."""
    hours = items.groupBy("ticker", F.date_trunc("hour", "published_at").alias("hour")).agg(F.count("*").alias("n"), F.avg("sentiment").alias("s"))
    buckets = hours.groupBy("ticker").agg(F.sum("n").alias("n"), F.count("*").alias("hours"), F.max("n").alias("busiest"), F.avg("s").alias("sentiment"))
    unread = items.groupBy("ticker").agg(F.countDistinct(F.when(~F.col("read"), F.col("cluster_id"))).alias("unread"))
    return buckets.join(unread, "ticker")


def rollup(df: DataFrame) -> DataFrame:
    """Per cluster of ``df(cluster_id, item_id, kind, published_at, publisher,
    sentiment)``: the canonical item (a filing before a wire before the rest,
    then the earliest), span, items, publishers, mean sentiment."""
    rank = F.when(F.col("kind") == "filing", 0).when(F.col("kind") == "wire", 1).otherwise(2)
    return df.groupBy("cluster_id").agg(
        F.min_by("item_id", F.struct(rank.alias("rank"), "published_at", "item_id")).alias("canonical"), F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("last_seen"), F.count("*").alias("n_items"), F.countDistinct(F.lower(F.trim("publisher"))).alias("n_publishers"),
        F.avg("sentiment").alias("sentiment"))


# What the five parts of importance weigh, outlets of the second tier, what a form or an item of it weighs.
WEIGHTS = {"coverage": 25.0, "tier": 20.0, "market": 25.0, "filing": 20.0, "sentiment": 10.0}
OUTLETS = [
    "reuters", "bloomberg", "wall street journal", "wsj", "financial times", "ft", "cnbc", "associated press", "ap news", "marketwatch",
    "barron's", "barrons", "the new york times", "nytimes", "the economist", "yahoo finance", "seeking alpha", "themarker", "globes",
    "calcalist", "bizportal", "haaretz", "the information", "axios", "techcrunch", "the verge",
]
VENDORS = ["finnhub_news", "massive", "alphavantage"]
HIGH_ITEMS = ["2.02", "1.01", "2.01", "5.02", "1.03", "4.02", "2.06", "3.01", "1.05"]
MIDDLE_ITEMS = ["7.01", "8.01", "3.02", "5.03", "5.07"]
FORMS = {"10-K": 0.8, "10-Q": 0.8, "20-F": 0.8, "6-K": 0.5, "SC 13D": 1.0, "SC 13D/A": 0.8, "SC 13G": 0.6, "SC 13G/A": 0.4, "DEF 14A": 0.3, "4": 0.4}


def source_tier(kind: Column, publisher: Column, source_id: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(publisher, F.lit(""))))
    return F.when(kind.isin("filing", "wire"), 1.0).when(p.isin(OUTLETS) | p.startswith("reuters") | p.startswith("bloomberg"), 0.7) \
        .when(source_id.isin(VENDORS) & (p != ""), 0.55).otherwise(0.4)


def filing_weight(form: Column, items: Column, size: Column) -> Column:
    has = lambda names: F.arrays_overlap(F.coalesce(items, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))
    by_form = None
    for name, weight in FORMS.items():
        by_form = F.when(form == name, weight) if by_form is None else by_form.when(form == name, weight)
    base = by_form.otherwise(0.3)
    grown = F.least(F.lit(0.8), base + F.least(F.lit(0.4), size / 100_000))
    return F.when(F.coalesce(form, F.lit("")) == "", 0.0) \
        .when(form.startswith("8-K"), F.when(has(HIGH_ITEMS), 1.0).when(has(MIDDLE_ITEMS), 0.5).otherwise(0.4)) \
        .when((form == "4") & (F.coalesce(size, F.lit(0)) > 0), grown).otherwise(base)


def importance(n_publishers: Column, tier: Column, market: Column, filing: Column, sentiment: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Coverage, source tier, market reaction, filing and strength of sentiment,
    each 0 to 1 and rounded, weighted into 0..100."""
    coverage = F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0), n_publishers)) / F.log1p(F.lit(8.0)))
    parts = {"coverage": coverage, "tier": tier, "market": market, "filing": filing, "sentiment": F.least(F.lit(1.0), F.abs(F.coalesce(sentiment, F.lit(0.0))))}
    raw = sum((F.round(F.coalesce(parts[k], F.lit(0.0)), 3) * w for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 * raw / (sum(weights.values()) or 1.0)))).cast("int")


def entity_links(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tickers by cashtag (.9) or by an alias word (its weight); the best per item and ticker."""
    words = items.select("item_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("title"), "[^a-z0-9$ ]+", " "), " +"))).alias("word"))
    known = words.join(aliases, words["word"] == F.lower(aliases["alias"])).select("item_id", "ticker", F.col("weight").alias("score"))
    tags = words.where("word rlike '^\\\\$[a-z]{1,5}$'").select("item_id", F.upper(F.expr("substring(word, 2)")).alias("ticker"), F.lit(0.9).alias("score"))
    return known.unionByName(tags).groupBy("item_id", "ticker").agg(F.max("score").alias("score"))


def sentiment(items: DataFrame, lexicon: DataFrame, negators: list[str]) -> DataFrame:
    """Lexicon sum, a negator before a word turning it round, by the root of hits, held to ±1."""
    words = items.select("item_id", F.posexplode(F.split(F.lower("title"), "[^\\p{L}]+")).alias("at", "word"))
    w = Window.partitionBy("item_id").orderBy("at")
    before = words.withColumn("negated", F.coalesce(F.lag("word").over(w).isin(negators), F.lit(False)))
    hits = before.join(lexicon, "word").groupBy("item_id").agg(
        F.sum(F.when(F.col("negated"), -F.col("polarity")).otherwise(F.col("polarity"))).alias("s"), F.count("*").alias("hits"))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / F.sqrt("hits") / 1.5))
    return hits.select("item_id", F.when(F.col("s").isNotNull(), score).alias("sentiment"), "hits")


def search(df: DataFrame, column: str, text: str, limit: int) -> DataFrame:
    """Substring search over normalised text, queries of three letters on."""
    if len(text) < 3:
        return df.limit(0)
    return df.where(F.contains(normalize_title(F.col(column)), F.lit(text.lower()))).orderBy("item_id").limit(limit)
