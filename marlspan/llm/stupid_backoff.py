"""Stupid-backoff scores of documents by counts of the whole corpus.

Words are compared without ASCII case. A word is scored by the relative
frequency of its n-gram of the highest order, ``c(u v w) / c(u v)`` for order
3; an n-gram that is not known backs off to the next shorter one, at a factor
of ``alpha`` for each step, down to ``c(w) / N``, and an unknown word counts as
one. A document begins with as many marks as the order asks for. It is scored
by the *other* documents: its own counts are taken off first, or every n-gram
would be known.

The n-grams of documents are exploded into rows (n-gram, count); the count
tables, one per order, are partitioned by ranges of the n-gram's hash; rows meet
their table's partition, are summed up there, and the sums join the documents'
n-grams and are summed per document. What travels between tasks are not single
rows but one packed set of rows for each batch of documents and partition of a
table: a batch tells each of its n-grams once, so a very common one is no hot
key, sorted hashes travel as differences and counts compressed, and texts are
shuffled once.

Hashes have ``HASH_BITS`` bits: of ``n`` known n-grams of an order, an unknown
one is taken for one of them in ``n`` of ``2 ** HASH_BITS`` cases.

Defined results: null and empty texts have no words and a null score; a corpus
of one document backs off throughout; ids may be null or repeat, rows are
scored one by one; equal rows that are many are dealt out by row number; a very
long text stays whole, a batch then holds it and its n-grams; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, spread
from .word_hash import MULTIPLIERS, hashed_words, mixed

ALPHA = 0.4
BATCH_CHARS = 12_000_000
PARTITION_CHARS = 12_000_000
START = np.uint64(0x9E3779B97F4A7C15)
HASH_BITS = 56


def _occurrences(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of a batch its document and its hash; and where documents with words start."""
    found = list(hashed_words(texts))
    word = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.uint64)
    lengths = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), word, np.cumsum(lengths)[lengths > 0] - lengths[lengths > 0]


def _grams(word: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """The orders from 1 on, each with the hashes of the n-grams that end at the words."""
    gram, short = word, np.uint64(64 - HASH_BITS)
    yield 1, gram >> short
    for kind in range(2, order + 1):
        before = np.empty_like(gram)
        before[1:] = gram[:-1]
        before[starts] = START
        with np.errstate(over="ignore"):
            gram = mixed(before * MULTIPLIERS[36 + 2 * kind] + word * MULTIPLIERS[37 + 2 * kind])
        yield kind, gram >> short


def _packed(a: np.ndarray, plain: int = 0) -> bytes:
    """64-bit numbers byte by byte: the ``plain`` lowest ones as they are, the others compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view("u1").reshape(-1, 8).T)
    return planes[:plain].tobytes() + zlib.compress(planes[plain:].tobytes(), 1)


def _unpacked(raw: bytes, n: int, plain: int = 0) -> np.ndarray:
    planes = np.frombuffer(raw[:plain * n] + zlib.decompress(raw[plain * n:]), "u1").reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def _packed_grams(grams: np.ndarray) -> bytes:
    """Sorted hashes as differences; those of a million hashes have four random bytes."""
    return _packed(np.diff(grams, prepend=np.uint64(0)), 4)


def _unpacked_grams(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(raw, n, 4), dtype=np.uint64)


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.sort(a)
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return a[first], np.diff(np.r_[first, len(a)]).astype("<u4")


def _parts(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """Where each of ``n_parts`` equal ranges of hash values begins in sorted hashes."""
    edges = [np.uint64((2**HASH_BITS * k) // n_parts) for k in range(n_parts)]
    return np.r_[np.searchsorted(hashes, np.array(edges, np.uint64)), len(hashes)]


def _ask(n_parts: int, order: int):
    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        _, word, starts = _occurrences(g["text"])
        out = []
        for kind, a in _grams(word, starts, order):
            grams, counts = _distinct(a)
            at = _parts(grams, n_parts)
            out += [(kind * n_parts + k, kind, int(key[0]), int(j - i), _packed_grams(grams[i:j]), _packed(counts[i:j]))
                    for k, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return pd.DataFrame(out, columns=["part", "kind", "batch", "n", "grams", "counts"])

    return run


def _add_up(g: pd.DataFrame) -> pd.DataFrame:
    """The counts of one partition of one table, as answers to its batches."""
    grams = [_unpacked_grams(x, n) for x, n in zip(g["grams"], g["n"])]
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    counts = np.concatenate([_unpacked(x, n) for x, n in zip(g["counts"], g["n"])]).astype(np.int64)[order]
    total = np.add.reduceat(counts, first)
    answer = np.empty(len(every), np.int64)
    answer[order] = np.repeat(total, np.diff(np.r_[first, len(every)]))
    ends = np.cumsum([len(x) for x in grams])
    return g[["part", "kind", "batch", "n"]].assign(totals=[_packed(answer[e - len(x):e]) for e, x in zip(ends, grams)])


def _own(doc: np.ndarray, index: np.ndarray) -> np.ndarray:
    """How often each occurrence's n-gram occurs in its own document."""
    key = doc * np.int64(2**32) + index
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    times = np.diff(np.r_[first, len(key)])
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(times, times)
    return out


def _score(n_words: int, n_docs: int, alpha: float, order: int):
    def run(key, g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        doc, word, starts = _occurrences(g["text"])
        lengths = np.bincount(doc, minlength=len(g))
        out = g[["row", "id"]].assign(n_words=lengths, n_backed_off=0, log_score=np.nan)
        if not len(doc):
            return out
        for kind, a in _grams(word, starts, order):
            grams, _ = _distinct(a)
            index = np.searchsorted(grams, a)
            part = answers[answers["kind"] == kind].sort_values("part")
            total = np.concatenate([_unpacked(x, n) for x, n in zip(part["totals"], part["n"])]).astype(np.int64)
            assert len(total) == len(grams), "a batch changed between its question and the answer"
            known = total[index] - _own(doc, index)
            if kind == 1:
                log = np.log(np.maximum(known, 1)) - np.log(np.maximum(n_words - lengths[doc], 1))
                seen = known > 0
            else:
                # the words before, as a context: their count, or the number of other documents at a start
                context = np.empty_like(shorter)
                context[1:] = shorter[:-1]
                context[starts] = n_docs - 1
                seen = known > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    log = np.where(seen, np.log(known) - np.log(np.maximum(context, 1)), np.log(alpha) + log)
            shorter = known
        out["log_score"] = np.where(lengths > 0, np.bincount(doc, log, minlength=len(g)), np.nan)
        out["n_backed_off"] = np.bincount(doc, ~seen, minlength=len(g)).astype(np.int64)
        return out

    return run


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text",
                   batch_chars: int = BATCH_CHARS, partition_chars: int = PARTITION_CHARS, order: int = 3) -> DataFrame:
    """Per row: ``row, id, n_words, n_backed_off`` (words whose n-gram of the
    given order is not known), ``log_score`` (the sum of the words' natural
    logarithms) and ``score``, its mean per word."""
    size = docs.agg(
        F.coalesce(F.sum(F.length(text_col)), F.lit(0)), F.coalesce(F.sum(F.regexp_count(text_col, F.lit(WORD))), F.lit(0)),
        F.count(F.when(F.regexp_like(text_col, F.lit(WORD)), 1)),
    ).first()
    chars, n_words, n_docs = (int(x) for x in size)
    n_batches, n_parts = max(1, -(-chars // batch_chars)), max(1, -(-chars // partition_chars))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the batch follows from id and text, and in hot groups from the row's number, so a second reading deals the same
    keyed = spread(rows.withColumn("key", F.xxhash64("text")), ["id", "key"], "row", docs.count(), "own")
    batched = keyed.withColumn("batch", F.pmod(F.xxhash64("id", "key", "own"), F.lit(n_batches))).select("row", "id", "text", "batch").repartition(n_batches, "batch")
    asked = batched.groupBy("batch").applyInPandas(_ask(n_parts, order), "part int, kind int, batch long, n long, grams binary, counts binary")
    answers = asked.groupBy("part").applyInPandas(_add_up, "part int, kind int, batch long, n long, totals binary")
    scored = batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        _score(n_words, n_docs, alpha, order), "row long, id long, n_words long, n_backed_off long, log_score double")
    return scored.withColumn("log_score", F.when(~F.isnan("log_score"), F.col("log_score"))).withColumn(
        "score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))

