"""64-bit hashes of all words of many texts at once, in numpy.

Texts are joined as UTF-8. Every byte has a random value (A-Z that of a-z), and
a prefix sum of value times power gives each word's polynomial hash as one
difference, shifted back to the word's start; a finaliser mixes the bits. Words
are the runs between the bytes 20 and 09 to 0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 500_000
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_VALUE[ord("A"):ord("Z") + 1] = _VALUE[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9FB21C651E98DF25
_BACK = pow(_BASE, -1, 2**64)
MULTIPLIERS = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chunks(texts) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        raw = t.encode() if t else b""
        if held and size + len(raw) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def word_spans(texts) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: the hashes of their words in order, the number of
    words of each text, the bytes that all of them lie in, where each word
    starts and ends there, and where each text begins. Null counts as empty;
    one newline follows each text."""
    for raws in _chunks(texts):
        data = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
        space = _SPACE[data]
        change = np.flatnonzero(np.diff(space, prepend=True))
        start, end = change[0::2], change[1::2]
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=sums[1:])
            words = mixed((sums[end] - sums[start]) * _power(_BACK, len(data))[start])
        ends = np.cumsum([len(r) + 1 for r in raws])
        yield words, np.diff(np.searchsorted(start, ends), prepend=0), data, start, end, np.r_[0, ends[:-1]]


def hashed_words(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the hashes of their words in order, and the number of
    words of each text. Null counts as empty."""
    for words, counts, *_ in word_spans(texts):
        yield words, counts


def run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of each run of words ``first <= k < last``."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * _power(_BASE, len(words)), out=sums[1:])
        return mixed((sums[last] - sums[first]) * _power(_BACK, len(words))[first] + (last - first).astype(np.uint64))


def token_sets(texts, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams, as signed
    integers; a text of fewer words is one n-gram, one without words has none."""
    for words, counts in hashed_words(texts):
        with np.errstate(over="ignore"):
            m = max(0, len(words) - n + 1)
            grams = np.full(m, n, dtype=np.uint64)
            for i in range(n):
                grams += words[i:i + m] * MULTIPLIERS[i]
            grams = mixed(grams).view(np.int64)
            at = 0
            for c in counts.tolist():
                if c >= n:
                    own = np.sort(grams[at:at + c - n + 1])
                    yield own[np.r_[True, own[1:] != own[:-1]]]
                elif c:
                    short = np.array([c], dtype=np.uint64)
                    for i in range(c):
                        short += words[at + i] * MULTIPLIERS[i]
                    yield mixed(short).view(np.int64)
                else:
                    yield np.empty(0, np.int64)
                at += c
