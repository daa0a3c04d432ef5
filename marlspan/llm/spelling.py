"""Spelling variants of words: near words by rare q-grams.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. An edit touches at most two of a word's bigrams. So if bigrams
are ordered by frequency, rarest first (over all words, then by their code
points, then by place), near words have a bigram in common that is among the
three rarest of both, and the edit lies wholly after it or wholly before it: its
place is the same counted from the start, or counted from the end. Words meet
in an equi join on such a bigram with its side, all that the word has on that
side, and the longer length; what meets is verified. Keys that more words have
than ``TILE`` are joined in tiles, so no task gets all pairs of a key.

The frequencies are a table of at most as many rows as there are pairs of
letters (:data:`MOST_BIGRAMS`), which is broadcast; all else is shuffled by key.

Defined results: null and empty texts have no words; a null id counts as an
empty one in the hash; repeated rows count as often as they stand there; a very
long run is a word like any other; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, join_facts

LETTERS = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many is given an error.
ERROR_EVERY = 97
LEAST_CHARS = 5
LEAST_COUNT = 3
#: Bigrams of a word that are joined: an edit touches two, one more is whole.
RAREST = 3
#: Pairs of the 26 small letters and the 64 code points above.
MOST_BIGRAMS = (26 + 64) ** 2
#: Words of one key that a tile holds.
TILE = 1024


def planted_error(run: Column, h: Column, every: int = ERROR_EVERY) -> Column:
    """``run`` without its code point ``h % length`` where ``every`` divides ``h``."""
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = ERROR_EVERY,
                least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text_col, F.lit(LETTERS), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    words = hashed.select(planted_error(F.col("run"), F.col("h"), every).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _bigrams(words: DataFrame) -> DataFrame:
    """``word, gram, at``: every bigram of every word with its place from 0."""
    chars = words.select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("c"))
    grams = F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda x, i: F.concat(F.col("c")[i], x))
    return chars.select("word", F.posexplode(grams).alias("at", "gram"))


def rare_bigrams(words: DataFrame, k: int = RAREST) -> DataFrame:
    """``word, gram, at``: each word's ``k`` rarest bigrams in the global order."""
    grams = _bigrams(words)
    often = durable(grams.groupBy("gram").agg(F.count("*").alias("often")), "bigrams")
    # words of another alphabet have no such bound, and no broadcast
    ranked = grams.join(F.broadcast(often) if often.count() <= MOST_BIGRAMS else often, "gram")
    least = F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))), 1, k)
    return ranked.groupBy("word").agg(least.alias("least")).select("word", F.inline("least")).select("word", "gram", "at")


def letters(word: Column) -> Column:
    """Which letters ``word`` has, as bits by their code points modulo 64."""
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(one(c)))


def _keys(rare: DataFrame) -> DataFrame:
    """``key, long, word``: what a word and its near words share. ``long`` is
    the length of the longer one of a pair: a word comes under its own length
    (``role`` 0) and as the shorter one under the next (``role`` 1)."""
    length = F.length("word")
    after = F.xxhash64(F.lit("<"), F.substring("word", F.lit(1), F.col("at") + 2))  # the edit is after the bigram
    before = F.xxhash64(F.lit(">"), F.substring("word", F.col("at") + 1, length))  # the edit is before it
    sides = rare.select("word", F.explode(F.array(after, before)).alias("key"))
    return sides.select("key", "word", F.posexplode(F.array(F.length("word"), F.length("word") + 1)).alias("role", "long")).distinct() \
        .withColumn("letters", letters(F.col("word")))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b``: every ordered pair of near words of ``words(word)``, once."""
    keys = durable(_keys(rare_bigrams(words)), "keys")
    n_rows = keys.count()
    counted = keys.groupBy("key", "long").agg(F.count("*").alias("n"), F.count("*").alias("members"), F.min("role").alias("least"))
    sizes = durable(counted.where("n > 1 AND least = 0").drop("least"), "sizes")
    met = join_facts(keys, sizes, ["key", "long"], n_rows)
    tiles = met.withColumn("tiles", F.ceil(F.col("members") / tile).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    # longer words go down the rows of tiles, those as long or one shorter go across
    left = tiles.where("role = 0").select("key", "long", own.alias("i"), F.explode(every).alias("j"), F.col("word").alias("a"), F.col("letters").alias("a_letters"))
    right = tiles.select("key", "long", F.explode(every).alias("i"), own.alias("j"), F.col("word").alias("b"), "role", "letters")
    # an edit changes two bits at most; what has more need not be compared letter by letter
    near = (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("letters"))) <= 2) & ((F.col("role") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    found = left.join(right.hint("merge"), ["key", "long", "i", "j"]).where(near).select("a", "b").distinct()
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word that has a form, by pointer doubling: a
    form's count is at least twice the word's, so the ways are short."""
    ways = durable(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        n = ways.count()
        asked = ways.groupBy("root").agg(F.count("*").alias("n"))
        steps = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        facts = durable(asked.join(steps, "root"), "steps")
        if facts.isEmpty():
            return ways
        moved = join_facts(ways, facts, ["root"], n).select("word", F.col("next").alias("root"))
        before, ways = ways, durable(ways.join(moved.select("word"), "word", "left_anti").unionByName(moved), "ways")
        discard(before)
        discard(facts)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = ERROR_EVERY,
                      least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, tile: int = TILE) -> DataFrame:
    """Per word: ``word, n, n_near, form, form_n, root``. A word's form is its
    near word of largest count (ties: smallest) if that has at least twice the
    word's count; its root is where forms lead."""
    words = durable(word_counts(docs, id_col, text_col, every, least_chars, least_count), "words")
    pairs = near_words(words.select("word"), tile)
    counted = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("best"))
    known = words.join(best, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    formed = durable(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
