"""Alignment of two tokenizers over the same bytes.

Each byte of a text has an owner among the tokens of A and one among those of
B: token numbers repeated over the tokens' lengths. Where either owner changes a
new pair of owners begins, a link; where both change at once a group ends.

Both tokenizers cut a text before a space or newline that follows no white
space, so texts are cut there into units, and a batch's units that are new to a
task are aligned together, once. Units and their links are looked up after
that. Whether a vocabulary allows these cuts is tried on its pieces and on
``PROBES``; otherwise a text is one unit.

Counts over the corpus are rows: each batch of texts tells its id pairs with
their counts, these are summed per pair, the highest count per B id is found,
and the facts return to the batches by joins on the pair. A pair comes once
from each batch, however common it is, so no key is hot. Texts are read once;
what waits for the counts are a document's pairs as packed numbers.

Defined results: a text that is null, empty, or that one of the tokenizers
doesn't give back byte for byte has no tokens, zeros and an empty ``groups``
digest; null or repeated ids are rows of their own; a very long text stays
whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .packing import vocabulary

#: Characters of the texts that tell their pairs together, about.
BATCH_CHARS = 8_000_000
#: Characters of the texts that are encoded together, about.
SLICE_CHARS = 1_000_000
#: Units, and characters of them, that a task keeps.
KNOWN_UNITS, KNOWN_CHARS = 400_000, 16_000_000
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER = _WHITE.replace(r"\n", "").replace(" ", "")
#: What lies between cuts: a cut is before a space or newline that follows no white space.
UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+(?:[{_OTHER}][{_WHITE}]*[^{_WHITE}]*)*|[{_WHITE}]+")
#: Text before units that are encoded for themselves; it has the same tokens whatever unit follows.
GUARD = "a"
PROBES = [
    "The cat's hat, isn't it?  two  spaces   three\n\nblank\n line \n x\ty\t z \r\n end\r\n", "a\xa0 b\u3000 c\u2003 d\x1c e\x85 f\u2028 g", " lead", "trail ", " \n ", "\n",
    "漢字 かな 🙂 ñ̃ \x00 b", "<s> </s> <unk> <0x41> <|endoftext|>", "x" * 300 + " " * 40 + "1234567890 12,5", "def f():\n    return {\r\n\t};\n",
]


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: the byte's own where that is printable, else the next above 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte the number of the token that holds it."""
    return np.repeat(np.arange(len(lengths)), lengths)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links in order as token numbers of A and of B, and the numbers of the
    links that begin a group. Both sides cover the same bytes; tokens of no
    bytes link with nothing."""
    a, b = owners(a_lengths), owners(b_lengths)
    new_a, new_b = np.diff(a, prepend=-1) != 0, np.diff(b, prepend=-1) != 0
    at = np.flatnonzero(new_a | new_b)
    return a[at], b[at], np.flatnonzero((new_a & new_b)[at])


class _Growing:
    """An array that is added to at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.empty(1024, dtype), 0

    def add(self, values) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.empty(max(n, 2 * len(self.held)) - self.n, self.held.dtype)])
        self.held[self.n:n] = values
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.held[:self.n]


class Aligner:
    """Aligned units of texts by two vocabulary files: a byte-level BPE, and a piece vocabulary with byte fallback that puts a space before a text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        self.guard = len(self.b.encode(GUARD))
        self.forget()
        # a piece that goes over a cut could join what the cut parts
        self.by_unit = all(len(UNIT.findall(p.replace("▁", " "))) <= 1 for p in pieces) and self._cuts_hold()
        self.forget()

    def _cuts_hold(self) -> bool:
        for text in PROBES:
            units = UNIT.findall(" " + text)
            if self._by_unit(units) != ([self.a.encode(" " + text, add_special_tokens=False).ids], [self.b.encode(text)]):
                return False
        return True

    def _by_unit(self, units: list[str]) -> tuple[list, list]:
        found = [self._ids(u) for u in units]
        return [[i for f in found for i in f[0]]], [[i for f in found for i in f[1]]]

    def _ids(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of text that begins with a space, or where a cut is."""
        return self.a.encode(unit, add_special_tokens=False).ids, self.b.encode(GUARD + unit)[self.guard:]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.strings: list[str] = []
        #: per unit: tokens of A, of B, groups; links, and where they begin; no tokens if a side doesn't give the unit back
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first = (_Growing(np.int64) for _ in range(5))
        self.broken = _Growing(bool)
        #: per link: the id of A above 32 bits, the id of B below
        self.links = _Growing(np.int64)

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text) if self.by_unit else [" " + text]

    def full(self) -> bool:
        return len(self.known) > KNOWN_UNITS or self.chars > KNOWN_CHARS

    def learn(self, fresh: list[str]) -> None:
        """Align units that are not known. Those that end in no white space go through the tokenizers as one text."""
        whole = [u for u in fresh if self.by_unit and not u[-1].isspace()]
        alone = [u for u in fresh if not (self.by_unit and not u[-1].isspace())]
        if whole and not self._learn(whole):
            alone += whole  # one of them isn't given back; each by itself
        for u in alone:
            if not self._learn([u]):
                self._add([u], [""], *([0],) * 4, np.empty(0, np.int64), True)

    def _learn(self, units: list[str]) -> bool:
        """Whether both sides give the units back; only then are they added."""
        text = "".join(units)
        raw = text.encode()
        a, b = self._ids(text) if self.by_unit else (self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]))
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        link_a, link_b, begins = overlaps(self.a_size[a], self.b_size[b])
        # where units end, in bytes, and with them tokens, links and groups
        ends = np.cumsum([len(u.encode()) for u in units])
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_cut, b_cut = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
        if (a_ends[a_cut - 1] != ends).any() or (b_ends[b_cut - 1] != ends).any():
            raise AssertionError("a token goes over a cut")
        link_cut = np.searchsorted(link_a, a_cut)
        group_cut = np.searchsorted(begins, link_cut)
        self._add(units, self._strings(a, b, link_a[begins], link_b[begins], group_cut), *(
            np.diff(x, prepend=0) for x in (a_cut, b_cut, group_cut, link_cut)), a[link_a] << 32 | b[link_b], False)
        return True

    @staticmethod
    def _strings(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, group_cut: np.ndarray) -> list[str]:
        """Each unit's groups as ``a1,a2|b1;a3|b2``."""
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_at, b_at = [*a_first.tolist(), len(a)], [*b_first.tolist(), len(b)]
        groups = [f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:])]
        cuts = [0, *group_cut.tolist()]
        return [";".join(groups[i:j]) for i, j in zip(cuts, cuts[1:])]

    def _add(self, units: list[str], strings: list[str], n_a, n_b, n_groups, n_links, links: np.ndarray, broken: bool) -> None:
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.chars += sum(map(len, units))
        self.strings += strings
        self.first.add(self.links.n + np.cumsum(n_links) - n_links)
        for to, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links), (self.links, links)):
            to.add(values)
        self.broken.add(np.full(len(units), broken))

    def read(self, texts: list) -> list[np.ndarray]:
        """Numbers of the units of each text."""
        cut = [self.units(t) if t else [] for t in texts]
        fresh = set().union(*cut) - self.known.keys()
        if fresh:
            self.learn(sorted(fresh))
        look = self.known.__getitem__
        return [np.fromiter(map(look, u), np.int64, len(u)) for u in cut]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 byte by byte, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


#: Rows of documents, and one for each batch with its pairs in ``a, b, n``.
ARROW = pa.schema([
    *((c, pa.int64()) for c in ("batch", "row", "id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
    ("places", pa.binary()), ("times", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
SCHEMA = ("batch long, row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "places binary, times binary, a array<int>, b array<int>, n array<long>")


def _aligned(known: Aligner, batch: int, rows: list[tuple[int, object]], units: list[np.ndarray]) -> pa.RecordBatch:
    """A batch's documents, each with its distinct pairs (places in the batch's
    pairs) and how often it has them; and one row more with the batch's pairs."""
    lengths = np.array([len(u) for u in units], np.int64)
    every = np.concatenate(units) if units else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(units)), lengths)
    bad = np.zeros(len(units), bool)
    bad[doc[known.broken.all[every]]] = True
    doc, every = doc[~bad[doc]], every[~bad[doc]]
    sums = {c: np.bincount(doc, getattr(known, c).all[every], len(units)).astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    strings = known.strings
    sha = [hashlib.sha256(";".join([strings[i] for i in u.tolist()]).encode()).hexdigest() if len(u) and not broken else "" for u, broken in zip(units, bad)]
    # every link of every unit of every document
    n = known.n_links.all[every]
    at = np.repeat(known.first.all[every] - np.cumsum(n) + n, n) + np.arange(n.sum())
    pairs, place = np.unique(known.links.all[at], return_inverse=True)
    used, times = np.unique(np.repeat(doc, n) * np.int64(max(1, len(pairs))) + place, return_counts=True)
    cuts = np.searchsorted(used, np.arange(len(units) + 1) * np.int64(max(1, len(pairs))))
    own = used % max(1, len(pairs))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    count, docs = len(rows), {
        "batch": [batch] * len(rows), "row": [r for r, _ in rows], "id": [i for _, i in rows], **sums, "groups_sha256": sha,
        "places": [_packed(np.diff(own[i:j], prepend=0)) for i, j in spans], "times": [_packed(times[i:j]) for i, j in spans],
    }
    told = {"batch": [batch], "a": [pairs >> 32], "b": [pairs & 0xFFFFFFFF], "n": [np.bincount(place, minlength=len(pairs))]}
    return pa.concat_batches([_filled(docs, count), _filled(told, 1)])


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in ARROW], schema=ARROW)


def _align(a: str, b: str, batch_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(*(x if os.sep in x else vocabulary(x) for x in (a, b)))
        part, turn = TaskContext.get().partitionId(), 0
        rows, units, chars = [], [], 0
        texts, size = [], 0

        def read() -> None:
            nonlocal texts, size
            units.extend(known.read(texts))
            texts, size = [], 0

        for g in batches:
            for row, key, text in zip(*(g.column(c).to_pylist() for c in ("row", "id", "text"))):
                rows.append((row, key))
                texts.append(text)
                size += len(text or "")
                chars += len(text or "")
                if size >= SLICE_CHARS:
                    read()
                if chars >= batch_chars or known.full():
                    read()
                    yield _aligned(known, part << 32 | turn, rows, units)
                    rows, units, chars, turn = [], [], 0, turn + 1
                    if known.full():
                        known.forget()
        if rows:
            read()
            yield _aligned(known, part << 32 | turn, rows, units)

    return run


def _scored(key: tuple, docs: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    facts = facts.sort_values("place")
    count, best = facts["count"].to_numpy(np.int64), facts["best"].to_numpy(bool)
    n_best, sums = [], []
    for places, times in zip(docs["places"], docs["times"]):
        at, n = np.cumsum(_unpacked(places)), _unpacked(times)
        n_best.append(int(n[best[at]].sum()))
        sums.append(int((n * count[at]).sum()))
    return docs[["row", "id", "n_a", "n_b", "n_groups", "n_links"]].assign(n_best=n_best, count_sum=sums, groups_sha256=docs["groups_sha256"])


def align_tokenizers(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id",
                     text_col: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Per row: ``row, id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``. ``a`` and ``b`` are names of vocabulary files or paths."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    aligned = durable(rows.mapInArrow(_align(a, b, batch_chars), SCHEMA), "aligned")
    told = aligned.where("row IS NULL").select(F.col("batch").alias("of"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p")).select("of", "place", "p.*")
    counts = durable(told.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    facts = counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = told.drop("n").join(facts.hint("merge"), ["a", "b"]).select("of", "place", "count", "best")
    waiting = aligned.where("row IS NOT NULL").drop("a", "b", "n")
    return waiting.groupBy("batch").cogroup(answers.groupBy("of")).applyInPandas(
        _scored, "row long, id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
