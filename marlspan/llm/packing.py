"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised whole and cut into pieces of at most ``capacity``
tokens. Full pieces are sequences already. The rest is dealt by hash into
districts of bounded size; in each district several islands evolve packings:
a child takes over whole well-filled sequences of one parent, the other
parent's sequences that share a piece with them are broken up, and the pieces
set free are best-fitted, largest first, after bins with room have swapped items
for displaced ones that fill them better. Evolution ends at the bound that no
packing beats; where best-fit decreasing misses it, children come below it.
Between rounds each island's best packings migrate to the next island of the
district. The best packing of a
district, never worse than best-fit decreasing, is its result.

Defined results: null text is empty and gives the closing id alone; a null id
or repeated rows are documents of their own, told apart by ``row``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let_go, remembered, slices

DISTRICT = 4096
ISLANDS = 2
ROUNDS = 2
POPULATION = 8
GENERATIONS = 12
#: An island's round ends after so many generations that save no sequence.
PATIENCE = 3
CACHED_WORDS = 1_000_000
#: Texts whose words are numbered together.
TEXTS = 512
#: New words that are encoded together: the tokenizer holds some hundred bytes for each of their tokens.
LEARNT = 8192


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, never joins text across a
    space or a newline, and starts a new token between a letter and a full stop
    or comma: words are encoded once, without such an ending, and their ids
    (little-endian, 32 bits) looked up after that. The table of words is
    emptied when it has ``most`` of them, but for the words in use. Words of letters alone, which the tokenizer's own
    normalising and splitting leave whole, go straight to its merges.

    Whether a vocabulary has these properties is tried on ``PROBES``; one that
    has not encodes every text by itself."""

    #: Case, endings, marks, symbols, digits and controls beside letters and spaces.
    PROBES = [
        "The cat's HAT, it's. A.b, x.. . , É. é ́ ñ̃. İ. ﬁ. Ǆ ß. Σας. ΟΔΟΣ.", "3 ² ½ ٣. 12,5 a1b2 C3. x-y (z) \"q\" #h @u", "漢字 かな. русский текст, العربية.",
        "a\tb.\r\nc.  two  spaces ", "", "<|endoftext|> <|startoftext|>. \x85b. 🙂. www.a.bc/d?e=f",
    ]

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.by_word = False
        if not getattr(self.tokenizer.model, "end_of_word_suffix", None):
            return
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith(self.tokenizer.model.end_of_word_suffix)
        self.forget()
        self.by_word = self._by_words(self.PROBES) == self._whole(self.PROBES)

    def forget(self, but: dict[str, bytes | None] = {}) -> None:
        self.known = {"": b""}
        self.learn({".", ","})
        self.known.update((w, x) for w, x in but.items() if x is not None)

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def learn(self, fresh: Iterable[str]) -> None:
        known, like, letters, others = self.known, [], set(), set()
        for w in fresh:
            stem, end = w, ""
            if w[-1] in ".," and w[-2:-1].lower().isalpha():
                stem, end = w[:-1], w[-1]
            if stem.isalpha() and "\u03a3" not in stem:  # capital sigma has two small forms
                low = stem.lower()
                if stem.isascii() or low.isalpha() and is_normalized("NFC", low) and is_normalized("NFC", stem):
                    stem = low
                    if stem not in known:
                        letters.add(stem)
                elif stem not in known:
                    others.add(stem)
            elif stem not in known:
                others.add(stem)
            if stem != w:
                like.append((w, stem, end))
        every = list(letters)
        for i in range(0, len(every), LEARNT):
            words = every[i:i + LEARNT]
            # the last piece of a word has the suffix that ends words
            ids = np.array(self.merges.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            self._add(words, ids, np.flatnonzero(self.last[ids]) + 1)
        every = list(others)
        for i in range(0, len(every), LEARNT):
            words = every[i:i + LEARNT]
            found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            self._add(words, np.array(found.ids, dtype="<u4"), np.searchsorted(np.array(found.word_ids), np.arange(1, len(words) + 1)))
        for w, stem, end in like:
            known[w] = known[stem] + known[end]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._by_words(texts) if self.by_word else self._whole(texts)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        distinct = list(set().union(*split))
        here = dict(zip(distinct, map(self.known.get, distinct)))
        fresh = [w for w in distinct if here[w] is None]
        if len(self.known) + len(fresh) > self.most:
            self.forget(here)
        self.learn(fresh)
        here.update((w, self.known[w]) for w in fresh)
        look = here.__getitem__
        return [b"".join(map(look, words)) for words in split]


_encoders: dict[tuple[str, int], WordEncoder] = remembered("tokens")


def encoder(path: str, most: int = CACHED_WORDS) -> WordEncoder:
    if (path, most) not in _encoders:
        _encoders[path, most] = WordEncoder(path, most)
    return _encoders[path, most]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def flat_ids(words: WordEncoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each text has. Arrow
    cuts the texts into words and numbers the distinct ones; only those are
    looked up, and numpy lays out their ids."""
    if not words.by_word:
        raw = words.encode(texts)
        return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)
    cut = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
    number = cut.flatten().dictionary_encode()
    distinct = number.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each word on the way
    found = list(map(words.known.get, distinct))
    fresh = [w for w, x in zip(distinct, found) if x is None]
    if len(words.known) + len(fresh) > words.most:
        words.forget(dict(zip(distinct, found)))
    if fresh:
        words.learn(fresh)
        known = words.known
        found = [known[w] if x is None else x for w, x in zip(distinct, found)]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
    at = number.indices.to_numpy()
    n = sizes[at]
    ends = np.cumsum(n)
    every = ids[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
    words_to = np.r_[0, ends][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
    return every, np.diff(words_to)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text",
                 cached_words: int = CACHED_WORDS) -> DataFrame:
    """Per piece: ``row, id, piece, start, length, ids_crc32``. ``tokenizer`` is
    the name of a vocabulary file or its path; a worker remembers the ids of
    ``cached_words`` words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go("tokens")
        words = encoder(tokenizer if os.sep in tokenizer else vocabulary(tokenizer), cached_words)
        for b in slices(batches):
            out: dict[str, list] = {k: [] for k in ("row", "id", "piece", "start", "length", "ids_crc32")}
            texts = [t or "" for t in b["text"]]
            for i in range(0, len(texts), TEXTS):
                every, sizes = flat_ids(words, texts[i:i + TEXTS])
                every, ends = memoryview(every.astype("<u4", copy=False).tobytes()), (4 * np.cumsum(sizes)).tolist()
                for row, key, begin, end in zip(b["row"].iloc[i:i + TEXTS], b["id"].iloc[i:i + TEXTS], [0, *ends], ends):
                    ids = memoryview(bytes(every[begin:end]) + bytes(4))
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        for name, v in zip(out, (row, key, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            out[name].append(v)
            yield pd.DataFrame(out).astype({"id": "Int64"})

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    return rows.mapInPandas(cut, "row long, id long, piece int, start long, length long, ids_crc32 long")


def best_fit(order, sizes, capacity: int, bins: list[list[int]], fill: list[int]) -> None:
    """Put the items of ``order`` each into the fullest of ``bins`` that has
    room, or into a new one. A bit set of free capacities finds it."""
    by_free: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fill):
        if f < capacity:
            by_free.setdefault(capacity - f, []).append(b)
            mask |= 1 << (capacity - f)
    for i in order:
        s = sizes[i]
        high = mask >> s
        if high:
            free = s + (high & -high).bit_length() - 1
            at = by_free[free]
            b = at.pop()
            if not at:
                mask &= ~(1 << free)
            bins[b].append(i)
            fill[b] += s
            free -= s
        else:
            b = len(bins)
            bins.append([i])
            fill.append(s)
            free = capacity - s
        if free:
            if mask >> free & 1:
                by_free[free].append(b)
            else:
                by_free[free] = [b]
                mask |= 1 << free


def fitness(fill: list[int], capacity: int) -> float:
    """Fewer sequences first, then fuller ones: the mean squared fill."""
    return -len(fill) + (sum((f / capacity) ** 2 for f in fill) / len(fill) if fill else 0.0)


def crossover(rng: random.Random, mother, father, sizes, capacity: int):
    """Inject well-filled bins of ``father`` into ``mother``."""
    bins, fill = father
    full = [b for b, f in enumerate(fill) if f >= 0.98 * capacity]
    given = [b for b in full if rng.random() < 0.5]
    taken = bytearray(len(sizes))
    new_bins, new_fill = [list(bins[b]) for b in given], [fill[b] for b in given]
    for b in new_bins:
        for i in b:
            taken[i] = 1
    loose: list[int] = []
    for b, f in zip(*mother):
        if any(taken[i] for i in b) or f < 0.9 * capacity:  # duplicates, and bins worth breaking up
            loose += [i for i in b if not taken[i]]
        else:
            new_bins.append(list(b))
            new_fill.append(f)
    fill_up(loose, sizes, capacity, new_bins, new_fill)
    loose.sort(key=lambda i: -sizes[i])
    best_fit(loose, sizes, capacity, new_bins, new_fill)
    return new_bins, new_fill


def fill_up(loose: list[int], sizes, capacity: int, bins: list[list[int]], fill: list[int]) -> None:
    """Before displaced items are best-fitted, each bin with room gives one
    item, or two, for the largest displaced one that fits in their place and
    fills it better: bins get fuller, and what is left to fit gets smaller."""
    loose.sort(key=lambda i: sizes[i])
    keys = [sizes[i] for i in loose]
    for b, items in enumerate(bins):
        room = capacity - fill[b]
        if not room:
            continue
        best = (0, -1, ())
        for x, i in enumerate(items):
            for out in ((i,), *((i, j) for j in items[x + 1:])):
                given = sum(sizes[k] for k in out)
                at = bisect_right(keys, given + room) - 1
                if at >= 0 and keys[at] - given > best[0]:
                    best = (keys[at] - given, at, out)
        gain, at, out = best
        if gain:
            items.append(loose.pop(at))
            keys.pop(at)
            fill[b] += gain
            for i in out:
                items.remove(i)
                k = bisect_right(keys, sizes[i])
                keys.insert(k, sizes[i])
                loose.insert(k, i)


def _genome(ind, n: int) -> bytes:
    out = np.zeros(n, dtype="<i4")
    for b, items in enumerate(ind[0]):
        out[items] = b
    return out.tobytes()


def _packing(genome: bytes, sizes):
    at = np.frombuffer(genome, dtype="<i4")
    bins: list[list[int]] = [[] for _ in range(int(at.max()) + 1)] if len(at) else []
    fill = [0] * len(bins)
    for i, b in enumerate(at.tolist()):
        bins[b].append(i)
        fill[b] += sizes[i]
    return bins, fill


def evolve(sizes: list[int], capacity: int, founders: list, seed: str, population: int, generations: int) -> list:
    """The island's packings after ``generations``, best first."""
    rng, n = random.Random(seed), len(sizes)
    pool = list(founders)
    while len(pool) < population:
        # the first founder is best-fit decreasing itself; the others disturb its order
        noise = 0.0 if not pool else 0.15 * rng.random()
        order = sorted(range(n), key=lambda i: -sizes[i] * (1 - noise * rng.random()))
        ind: tuple = ([], [])
        best_fit(order, sizes, capacity, *ind)
        pool.append(ind)
    rank = lambda p: sorted(p, key=lambda x: -fitness(x[1], capacity))
    pool = rank(pool)[:population]
    floor, still = -(-sum(sizes) // capacity), 0
    for _ in range(generations):
        if len(pool[0][1]) <= floor or still == PATIENCE:
            break
        before = len(pool[0][1])
        children = [crossover(rng, *rng.sample(pool, 2), sizes, capacity) for _ in range(population)]
        pool = rank(pool + children)[:population]
        still = 0 if len(pool[0][1]) < before else still + 1
    return pool


def pack(pieces: DataFrame, capacity: int, district: int = DISTRICT, islands: int = ISLANDS, rounds: int = ROUNDS,
         population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` must be
    durable: it is read once per round."""
    partial = pieces.where(F.col("length") < capacity)
    n_districts = max(1, -(-partial.count() // district))
    items = partial.withColumn("district", F.pmod(F.xxhash64(F.lit(11), "row", "piece"), F.lit(n_districts)))
    light = items.select("district", "row", "piece", "length")
    spread = light.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    genomes_are = "district long, island int, fitness double, genome binary"

    def island(key, g: pd.DataFrame, found: pd.DataFrame | None, turn: int) -> pd.DataFrame:
        sizes = g.sort_values(["row", "piece"])["length"].tolist()
        founders = [] if found is None else [_packing(x, sizes) for x in found.sort_values(["fitness", "genome"])["genome"]]
        pool = evolve(sizes, capacity, founders, f"{key}-{turn}", population, generations)
        if turn + 1 == rounds:
            pool = pool[:1]
        return pd.DataFrame([(key[0], key[1], fitness(x[1], capacity), _genome(x, len(sizes))) for x in pool],
                            columns=["district", "island", "fitness", "genome"])

    def later(turn: int):
        return lambda key, g, found: island(key, g, found, turn)

    genomes = spread.groupBy("district", "island").applyInPandas(lambda key, g: island(key, g, None, 0), genomes_are)
    for turn in range(1, rounds):
        best = F.row_number().over(Window.partitionBy("district", "island").orderBy(F.desc("fitness"), "genome"))
        ranked = durable(genomes, "genomes").withColumn("place", best)
        # elites go to the next island; the others stay where they are
        elites = ranked.where("place = 1").withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        pool = ranked.unionByName(elites).drop("place")
        genomes = spread.groupBy("district", "island").cogroup(pool.groupBy("district", "island")).applyInPandas(
            later(turn), genomes_are)
    last = durable(genomes, "genomes")
    best = last.withColumn("place", F.row_number().over(Window.partitionBy("district").orderBy(F.desc("fitness"), "island"))).where("place = 1")

    columns = pieces.columns

    def place(key, g: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["row", "piece"])
        g["sequence_id"] = np.frombuffer(won["genome"].iloc[0], dtype="<i4").astype("int64") * n_districts + int(key[0])
        g["offset"] = g.groupby("sequence_id")["length"].cumsum() - g["length"]
        return g[columns + ["sequence_id", "offset"]]

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    placed = items.groupBy("district").cogroup(best.groupBy("district")).applyInPandas(place, schema)
    # full pieces are numbered below zero, one by one, whatever their rows' numbers
    full = pieces.where(F.col("length") >= capacity).withColumns({
        "sequence_id": F.lit(-1) - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    pieces = token_pieces(docs, tokenizer, capacity, id_col, text_col, cached_words)
    return pack(durable(pieces, "pieces"), capacity)
