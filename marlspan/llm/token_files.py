"""Token ids in files of fixed-width bits.

Every id of a vocabulary takes the least number of bits that its largest id
needs. A file holds blocks of ``BLOCK`` ids, each packed by itself and begun at
a whole byte, then the documents' ids and ends, the blocks' offsets and a
footer: whatever range of ids is asked for, only its blocks are read, and numpy
unpacks them eight ids at a time.

``token_bits`` is a Spark data source. Each task of a write makes one file
under a name of its own and tells its size; the commit lists the files of the
attempts that count, in order, in one manifest, and removes what other attempts
left. A write is whole or not there, and a lost executor costs its tasks only.

Layout, little-endian: ``MAGIC``; blocks; per document its id (i8), whether
that is null (u1) and its end (u8, in ids from the file's start); offsets of
the blocks and of their end (u8); the footer.

Defined results: a null text is an empty one and gives the end id alone; null
ids come first and stay null; rows with equal ids are documents of their own in
the order of the table's rows; other columns are ignored; an empty table gives
files without documents; an id that doesn't fit the vocabulary is an error.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_dir, shuffle_width
from .packing import encoder, flat_ids, vocabulary

MAGIC = b"MSPNTOK1"
#: bits, ids in a block, ids, documents, blocks, where the documents begin, where the offsets begin, magic
FOOTER = struct.Struct("<IIQQQQQ8s")
#: Ids of a block; a multiple of eight, so that whole blocks are whole bytes.
BLOCK = 8192
#: Characters of text that one file is made of, about.
FILE_CHARS = 256_000_000
#: Ids that a reader hands on at a time, unless one document has more.
BATCH_IDS = 1 << 20
#: Texts that are encoded together.
SLICE_ROWS = 500
MANIFEST = "manifest.json"


def width(vocabulary_size: int) -> int:
    """Bits that the largest id of a vocabulary needs, one at least."""
    return max(1, (vocabulary_size - 1).bit_length())


def _places(bits: int) -> Iterator[tuple[int, int, int]]:
    """Of eight ids side by side: id, first byte that has bits of it, and where in that byte they begin."""
    for k in range(8):
        yield k, (k * bits) // 8, (k * bits) % 8


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, low bits first, filled up to a whole byte."""
    n = len(ids)
    if bits % 8 == 0:  # whole bytes: nothing to shift
        if n and int(ids.max()) >> bits:
            raise ValueError(f"an id does not fit {bits} bits")
        return ids.astype("<u4").view(np.uint8).reshape(n, 4)[:, :bits // 8].tobytes()
    wide = np.zeros((-(-n // 8), 8), np.uint64)
    wide.reshape(-1)[:n] = ids
    if n and int(wide.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    out = np.zeros((len(wide), bits + 8), np.uint8)
    for k, byte, shift in _places(bits):
        v = wide[:, k] << np.uint64(shift)
        for j in range((shift + bits + 7) // 8):
            out[:, byte + j] |= (v >> np.uint64(8 * j)).astype(np.uint8)
    return out[:, :bits].tobytes()[:-(-n * bits // 8)]


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids that :func:`pack_bits` made ``raw`` of."""
    if bits % 8 == 0:
        bytes_of = np.zeros((n, 4), np.uint8)
        bytes_of[:, :bits // 8] = np.frombuffer(raw, np.uint8).reshape(n, bits // 8)
        return bytes_of.reshape(-1).view("<u4")
    groups = -(-n // 8)
    held = np.zeros(groups * bits, np.uint8)
    held[:len(raw)] = np.frombuffer(raw, np.uint8)[:groups * bits]
    held = held.reshape(groups, bits)
    out = np.empty((groups, 8), "<u4")
    for k, byte, shift in _places(bits):
        v = np.zeros(groups, np.uint64)
        for j in range((shift + bits + 7) // 8):
            v |= held[:, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (v >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if ":" in uri else (pa.fs.LocalFileSystem(), os.path.abspath(uri))


class FileWriter:
    """Documents one after the other into one file; holds less than one block and what it is given."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block holds a multiple of eight ids")
        self.out, self.bits, self.block = out, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.ids.append(np.asarray(doc_ids, "<i8"))
        self.nulls.append(np.asarray(nulls, "u1"))
        self.lengths.append(np.asarray(lengths, "<u8"))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % self.block
            self.out.write(pack_bits(every[:whole], self.bits))
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def close(self) -> tuple[int, int]:
        """Documents and ids."""
        if self.n_held:
            self.out.write(pack_bits(np.concatenate(self.held), self.bits))
        n_blocks = -(-self.n_ids // self.block)
        offsets = len(MAGIC) + np.arange(n_blocks + 1, dtype="<u8") * np.uint64(self.block * self.bits // 8)
        offsets[-1] = docs_at = len(MAGIC) + (n_blocks - 1) * self.block * self.bits // 8 + self._last_bytes() if n_blocks else len(MAGIC)
        doc_ids, nulls, lengths = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((self.ids, "<i8"), (self.nulls, "u1"), (self.lengths, "<u8")))
        for a in (doc_ids, nulls, np.cumsum(lengths, dtype="<u8"), offsets):
            self.out.write(a.tobytes())
        self.out.write(FOOTER.pack(self.bits, self.block, self.n_ids, len(doc_ids), n_blocks, docs_at, docs_at + 17 * len(doc_ids), MAGIC))
        return len(doc_ids), self.n_ids

    def _last_bytes(self) -> int:
        return -(-((self.n_ids - 1) % self.block + 1) * self.bits // 8)


class TokenFile:
    """Random access to one file: only the footer, the documents' ends and the blocks asked for are read."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.raw = fs.open_input_file(path)
        size = self.raw.size()
        self.bits, self.block, self.n_ids, self.n_docs, self.n_blocks, self.docs_at, offsets_at, magic = FOOTER.unpack(
            self.raw.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.offsets = np.frombuffer(self.raw.read_at(8 * (self.n_blocks + 1), offsets_at), "<u8")
        docs = self.raw.read_at(17 * self.n_docs, self.docs_at)
        self.doc_ids = np.frombuffer(docs[:8 * self.n_docs], "<i8")
        self.nulls = np.frombuffer(docs[8 * self.n_docs:9 * self.n_docs], "u1").astype(bool)
        self.ends = np.frombuffer(docs[9 * self.n_docs:], "<u8").astype(np.int64)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids at ``start <= k < stop``."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        at, end = int(self.offsets[first]), int(self.offsets[last + 1])
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        ids = unpack_bits(self.raw.read_at(end - at, at), n, self.bits)
        return ids[start - first * self.block:stop - first * self.block]

    def close(self) -> None:
        self.raw.close()


@dataclass
class Written(WriterCommitMessage):
    place: int
    name: str
    n_docs: int
    n_ids: int


@dataclass
class Part(InputPartition):
    uri: str
    before: int


class TokenBitsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.bits, self.block = options["path"], width(int(options["vocabulary"])), int(options.get("block", BLOCK))
        fs, path = _filesystem(self.uri)
        if not overwrite and fs.get_file_info(f"{path}/{MANIFEST}").type != pa.fs.FileType.NotFound:
            raise ValueError(f"{self.uri} is written already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = _filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        name = f"tokens-{uuid.uuid4().hex}.bits"
        with fs.open_output_stream(f"{path}/{name}") as out:
            file = FileWriter(out, self.bits, self.block)
            for batch in iterator:
                ids = batch.column("ids").to_pylist()
                keys = batch.column("id")
                file.add(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False),
                         np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4"))
            n_docs, n_ids = file.close()
        return Written(TaskContext.get().partitionId(), name, n_docs, n_ids)

    def commit(self, messages: list) -> None:
        fs, path = _filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.place):
            files.append({"name": m.name, "docs": m.n_docs, "ids": m.n_ids, "before": before})
            before += m.n_ids
        with fs.open_output_stream(f"{path}/{MANIFEST}.new") as out:
            out.write(json.dumps({"bits": self.bits, "block": self.block, "ids": before, "files": files}).encode())
        fs.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")
        self._remove_all_but({f["name"] for f in files})

    def abort(self, messages: list) -> None:
        fs, path = _filesystem(self.uri)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{path}/{m.name}")

    def _remove_all_but(self, names: set) -> None:
        fs, path = _filesystem(self.uri)
        for info in fs.get_file_info(pa.fs.FileSelector(path)):
            if info.base_name.endswith(".bits") and info.base_name not in names:
                fs.delete_file(info.path)


class TokenBitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]

    def partitions(self) -> list:
        return [Part(f"{self.uri}/{f['name']}", f["before"]) for f in manifest(self.uri)["files"] if f["docs"]] or [Part("", 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        file = TokenFile(partition.uri)
        starts = np.r_[0, file.ends[:-1]]
        at = 0
        while at < file.n_docs:
            stop = max(at + 1, int(np.searchsorted(file.ends, starts[at] + BATCH_IDS, "right")))
            raw = file.slice(int(starts[at]), int(file.ends[stop - 1])).tobytes()
            cuts = 4 * (np.r_[starts[at:stop], file.ends[stop - 1]] - starts[at])
            yield pa.RecordBatch.from_arrays([
                pa.array(file.doc_ids[at:stop], pa.int64(), mask=file.nulls[at:stop]), pa.array(starts[at:stop] + partition.before, pa.int64()),
                pa.array(np.diff(cuts) // 4, pa.int64()),
                pa.array([raw[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
            ], names=["id", "start", "n_tokens", "ids"])
            at = stop
        file.close()


class TokenBits(DataSource):
    """``spark.read.format("token_bits")``: ``id, start, n_tokens, ids``, ids as
    little-endian 32-bit numbers and ``start`` counted over all files. Written
    are ``id`` and ``ids`` in the same form, with the options ``vocabulary``
    (its size) and ``block``."""

    @classmethod
    def name(cls) -> str:
        return "token_bits"

    def schema(self) -> str:
        return "id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return TokenBitsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenBitsWriter:
        return TokenBitsWriter(dict(self.options), overwrite)


def manifest(uri: str) -> dict:
    fs, path = _filesystem(uri)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def token_range(uri: str, start: int, stop: int) -> np.ndarray:
    """The ids at ``start <= k < stop`` of all files as one stream."""
    out = [np.empty(0, "<u4")]
    for f in manifest(uri)["files"]:
        first, last = max(start, f["before"]), min(stop, f["before"] + f["ids"])
        if first < last:
            file = TokenFile(f"{uri}/{f['name']}")
            out.append(file.slice(first - f["before"], last - f["before"]))
            file.close()
    return np.concatenate(out)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's name, in the form that executors' libraries take."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    if end_id is None:
        return ids, lengths
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """``id, ids`` of rows ``id, text`` in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer if os.sep in tokenizer else vocabulary(tokenizer))
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                b = batch.slice(at, SLICE_ROWS)
                ids, n = with_end(*flat_ids(words, [t or "" for t in b.column("text").to_pylist()]), end_id)
                cuts = pa.array(np.r_[0, 4 * np.cumsum(n)], pa.int64())
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, cuts.buffers()[1], pa.py_buffer(ids.astype("<u4", copy=False).tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("id"), raw.cast(pa.binary())], names=["id", "ids"])

    return docs.mapInArrow(run, "id long, ids binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 1,
                 id_col: str = "doc_id", text_col: str = "text", file_chars: int = FILE_CHARS, block: int = BLOCK) -> str:
    """Write all documents in ascending order of their ids as token files;
    returns the folder's full name. Ranges of ids are shuffled with their texts
    once, sorted, and encoded on their way into the files."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spark.dataSource.register(TokenBits)
    name = tokenizer if os.sep in tokenizer else vocabulary(tokenizer)
    size = max(Tokenizer.from_file(name).get_vocab_size(), (end_id or 0) + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    chars = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    n_files = max(shuffle_width(spark), -(-int(chars) // file_chars))
    order = [F.col("id").asc_nulls_first(), F.col("row")]
    ordered = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    where = qualified(spark, path)
    encoded(ordered, tokenizer, end_id).write.format("token_bits").option("vocabulary", size).option("block", block).mode("append").save(where)
    return where


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids`` of the documents in token files."""
    spark.dataSource.register(TokenBits)
    return spark.read.format("token_bits").load(qualified(spark, path))


def token_table(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` written as token files in the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/marlspan-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    return read_tokens(spark, write_tokens(docs, path, tokenizer, end_id, id_col, text_col))
