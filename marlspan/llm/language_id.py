"""Language identification with word-first backoff.

Training counts the words of labelled texts per language, and from those the
character n-grams of padded words. A word that training has seen is scored by
its smoothed log frequency in each language. An unseen word backs off: at each
of its positions the longest known n-gram that starts there is scored, four
characters first, then three, two, one. The language with the largest mean word
score wins; ``score`` is the share of the winner when the mean scores are
turned into probabilities.

Training may be held to about ``max_train_rows`` labelled rows, picked by a
hash of the text; a prediction reads the whole text.

Defined results: null texts and texts without a letter give ``und`` with score
0; with no training row every text gives ``und``; ties go to the language
first by code point; rows with null text or null language train nothing; ids
may be null or repeat; other columns are carried untouched, and columns named
like the two results are replaced; symbols and digits that are no letters
(superscripts, fractions) don't make a text; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, let_go, remembered, slices

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: Longer runs of letters are counted and scored by their n-grams only, and not remembered.
MEMORABLE = 40
CACHED_WORDS = 150_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in slices(batches):
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(b["lang"], b["text"]):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in by_lang.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"])


class Model:
    """Log frequencies: a row per word or n-gram, a column per language."""

    def __init__(self, langs: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray):
        self.langs, self.words, self.word_logs, self.grams, self.gram_logs = langs, words, word_logs, grams, gram_logs

    def unseen(self, word: str) -> np.ndarray:
        padded, rows = f"_{word}_", []
        for i in range(len(padded)):
            for n in range(min(LONGEST, len(padded) - i), 0, -1):
                k = self.grams.get(padded[i:i + n])
                if k is not None:
                    rows.append(k)
                    break
        if not rows:
            return np.zeros(len(self.langs))
        return self.gram_logs[rows].mean(axis=0)


class Scorer:
    """Scores texts; remembers the rows of unseen words, a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index = dict(self.model.words)
        self.table = np.vstack([self.model.word_logs, np.zeros((4096, len(self.model.langs)))])
        self.used = len(self.model.word_logs)

    def add(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.model.unseen(word)
        self.index[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, rows, get = np.zeros(len(self.model.langs)), [], self.index.get
        for w in words:
            k = get(w)
            if k is None:
                if len(w) > MEMORABLE:
                    total += self.model.unseen(w)
                    continue
                k = self.add(w)
            rows.append(k)
        mean = (total + self.table[rows].sum(axis=0)) / len(words)
        odds = np.exp(mean - mean.max())
        best = int(odds.argmax())
        if len(self.index) > len(self.model.words) + CACHED_WORDS:
            self.reset()
        return self.model.langs[best], float(odds[best] / odds.sum())


def _table(counts: DataFrame, langs: list[str], floor: int, smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    """Items seen at least ``floor`` times, as log frequencies by language."""
    wide = counts.groupBy("item").agg(
        *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)]
    )
    kept = wide.where(sum((F.col(f"l{i}") for i in range(len(langs))), F.lit(0)) >= floor).toPandas().sort_values("item")
    n = kept[[f"l{i}" for i in range(len(langs))]].to_numpy(dtype="float64")
    logs = np.log(n + smoothing) - np.log(n.sum(axis=0) + smoothing * max(1, len(n)))
    return dict(zip(kept["item"], range(len(kept)))), logs


def train(labelled: DataFrame, max_train_rows: int = 8000, min_word: int = 2, min_gram: int = 3) -> Model:
    """A model of ``labelled(text, lang)``, from about ``max_train_rows`` rows
    (a fixed bound: the model, which every task gets, is no larger than what so
    many rows hold)."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    there = rows.count()
    if there > max_train_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1_000_000)) < int(1e6 * max_train_rows / there))
    counts = rows.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = durable(counts, "words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    padded = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    grams = None
    for n in range(1, LONGEST + 1):
        at = F.explode(F.sequence(F.lit(1), F.length("w") - n + 1))
        part = counts.select("lang", "n", padded.alias("w")).where(F.length("w") >= n).select("lang", "n", "w", at.alias("at")) \
            .select("lang", F.expr(f"substring(w, at, {n})").alias("item"), "n").groupBy("lang", "item").agg(F.sum("n").alias("n"))
        grams = part if grams is None else grams.unionByName(part)
    short = counts.where(F.length("word") <= MEMORABLE).withColumnRenamed("word", "item")
    words, word_logs = _table(short, langs, min_word, 0.1)
    gram_index, gram_logs = _table(grams, langs, min_gram, 0.1)
    return Model(langs, words, word_logs, gram_index, gram_logs)


_scorers: dict[str, Scorer] = remembered("language_id")


def scorer_of(key: str, shared) -> Scorer:
    """One scorer for all tasks of a worker that use the same model."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, in place of columns
    of these names that are there."""
    new = {lang_col.lower(), score_col.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go("language_id")
        scorer = scorer_of(key, shared)
        for b in slices(batches):
            found = [scorer.predict(t) for t in b[text_col]]
            yield b[[f.name for f in kept]].assign(**{lang_col: [x[0] for x in found], score_col: [x[1] for x in found]})

    schema = T.StructType([*kept, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInPandas(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
