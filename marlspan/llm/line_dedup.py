"""Repeated passages across documents, found by hashing lines or paragraphs.

Texts are cut into units: lines, paragraphs (between blank lines), or phrases.
Phrases are lines cut further, because a passage may begin and end anywhere in
a line: a cut follows every sentence end, and every pair of words whose hash is
one in ``PHRASE``, so equal passages have equal cuts wherever they stand.

Units are normalised (A-Z as a-z, runs of white space as one space) and hashed
to 64 bits. All units of all texts are hashed, however short. Units with equal
digests form a group; its earliest occurrence, by document id and then by place
in the text, stays, and each later occurrence is a candidate. Neighbouring
candidates of a text are a run. Within a run, candidates that point at the same
stretch of the same earlier text (equal distance of places) make a match; a
match of ``min_words`` words or more is a passage, and all candidates between
its ends are removals, with their code points in the original text. Single
short units, which repeat by chance, point here and there and stay, and so do
two equal digests of unequal units.

Groups are pre-aggregated in every task; hot groups go back to their units by
broadcast and the rest by shuffle, so no task meets a hot group.

What this cannot reach: up to one unit at either end of a passage, and matches
of fewer than ``min_words`` words.

Defined results: null and empty texts have no units; a null id ranks behind all
others; repeated rows are documents of their own, ranked by ``row``; very long
texts are read whole, their units are rows; other columns are ignored by
:func:`repeated_units` and carried by :func:`drop_repeats`, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, free_name, join_facts, numbered, slices
from .word_hash import MULTIPLIERS, mixed, run_hashes, word_spans

UNITS = ("line", "paragraph", "phrase")
#: One in so many pairs of words is followed by a cut.
PHRASE = 6
MIN_WORDS = 25
UNIT_COLUMNS = "row long, id long, place int, start int, end int, n_words int, digest long"


def _cut_after(words: np.ndarray, owner: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit ends with each word, by what stands in the word's own text."""
    lines = np.cumsum(data == 10)
    breaks = np.zeros(len(words), dtype=np.int64)
    breaks[:-1] = lines[start[1:]] - lines[end[:-1] - 1]
    if unit == "paragraph":
        return breaks > 1
    if unit == "line":
        return breaks > 0
    with np.errstate(over="ignore"):
        pair = words * MULTIPLIERS[60]
        pair[1:] += np.where(owner[1:] == owner[:-1], words[:-1] * MULTIPLIERS[61], np.uint64(0))
    last = data[end - 1]
    return (breaks > 0) | (last == ord(".")) | (last == ord("!")) | (last == ord("?")) | (mixed(pair) % np.uint64(PHRASE) == 0)


def units_of(texts, unit: str) -> pd.DataFrame:
    """All units: the number of their ``text``, ``place`` in it, ``start`` and
    ``end`` as code points, ``n_words`` and ``digest``."""
    found, base = [], 0
    for words, counts, data, start, end, begin in word_spans(texts):
        if len(words):
            owner = np.repeat(np.arange(len(counts)), counts)
            cut = _cut_after(words, owner, data, start, end, unit)
            cut[:-1] |= owner[1:] != owner[:-1]
            cut[-1] = True
            last = np.flatnonzero(cut) + 1
            first = np.r_[0, last[:-1]]
            text = owner[first]
            points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            number = np.arange(len(text))
            found.append((base + text, number - np.searchsorted(text, text), points[start[first]] - points[begin[text]],
                          points[end[last - 1]] - points[begin[text]], last - first, run_hashes(words, first, last).view("int64")))
        base += len(counts)
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 6
    return pd.DataFrame(dict(zip(("text", "place", "start", "end", "n_words", "digest"), columns)))


def unit_rows(texts: DataFrame, unit: str) -> DataFrame:
    """The units of ``texts(row, id, text)`` as rows of ``UNIT_COLUMNS``."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            found = units_of(b["text"], unit)
            at = found.pop("text").to_numpy()
            found.insert(0, "row", b["row"].to_numpy()[at])
            found.insert(1, "id", b["id"].astype("Int64").array[at])
            yield found

    return texts.mapInPandas(run, UNIT_COLUMNS)


def _with_groups(units: DataFrame) -> DataFrame:
    """``units`` of groups of two or more, with ``group_size`` and the earliest
    occurrence ``first``. Digests and ids, which don't compress, stay behind."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "place")
    groups = units.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("group_size"), F.count("*").alias("n"))
    return join_facts(units.drop("id"), durable(groups.where("n > 1"), "groups"), ["digest"], units.count()).drop("digest")


def _passages(candidates: DataFrame, min_words: int) -> DataFrame:
    """The candidates that lie in a match of ``min_words`` words or more."""
    text = Window.partitionBy("row").orderBy("place")
    # places less their numbers are equal along a run
    runs = candidates.withColumn("run", F.col("place") - F.row_number().over(text))
    same = Window.partitionBy("row", "run", F.col("first.row"), F.col("place") - F.col("first.place"))
    matched = runs.withColumns({"words": F.sum("n_words").over(same), "until": F.max("place").over(same)})
    reach = F.max(F.when(F.col("words") >= min_words, F.col("until"))).over(
        Window.partitionBy("row", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return matched.withColumn("reach", reach).where(F.col("place") <= F.col("reach"))


def _repeated(texts: DataFrame, unit: str, min_words: int) -> DataFrame:
    units = durable(unit_rows(texts, unit), "units")
    candidates = _with_groups(units).where((F.col("row") != F.col("first.row")) | (F.col("place") != F.col("first.place")))
    ids = units.where("place = 0").select("row", "id")
    return _passages(candidates, min_words).join(ids.hint("merge"), "row").select(
        "row", "id", F.col("place").alias("unit"), "start", "end", "n_words",
        "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("first.place").alias("keep_unit"),
    )


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per removal: ``row, id, unit, start, end, n_words, group_size``
    and the occurrence that stays, ``keep_id, keep_row, keep_unit``. Units are
    numbered from 0 in each text."""
    return _repeated(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), unit, min_words)


def drop_repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removals cut out of ``text_col``, each with the one
    white space character after it. Removals are matched by row, so null and
    repeated ids are cut like others."""
    row_col, cut_col = free_name(docs, "row"), free_name(docs, "cuts")
    rows = numbered(docs, row_col)
    found = _repeated(rows.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), unit, min_words)
    cuts = found.groupBy(F.col("row").alias(row_col)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut_col))
    kept = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            texts = []
            for text, cut in zip(b[text_col], b[cut_col]):
                if text and cut is not None:
                    parts, at = [], 0
                    for c in cut:
                        parts.append(text[at:c["start"]])
                        at = c["end"] + text[c["end"]:c["end"] + 1].isspace()
                    text = "".join(parts) + text[at:]
                texts.append(text)
            yield b[kept].assign(**{text_col: texts})

    return rows.join(cuts, row_col, "left").mapInPandas(run, T.StructType(docs.schema.fields))
