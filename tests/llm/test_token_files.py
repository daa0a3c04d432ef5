"""Bit packing by round trips, files and ranges against the tokenizer itself."""

import io
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspan.llm import queries, token_files as T


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=70))))
def test_op13_bits_round_trip(case):
    bits, ids = case
    raw = T.pack_bits(np.array(ids, "<u4"), bits)
    assert len(raw) == -(-len(ids) * bits // 8) and T.unpack_bits(raw, len(ids), bits).tolist() == ids


def test_op13_bits_by_hand():
    assert T.width(2) == 1 and T.width(49408) == 16 and T.width(65537) == 17 and T.width(1) == 1
    # 3 bits each, low bits first: 1 | 2 << 3 | 3 << 6
    assert T.pack_bits(np.array([1, 2, 3], "<u4"), 3) == bytes([0b11010001, 0])
    with pytest.raises(ValueError):
        T.pack_bits(np.array([8], "<u4"), 3)


def plain(texts, end=1):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(T.vocabulary("word_bpe_49k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(e.ids + ([end] if end is not None else []), "<u4") for e in found]


def test_op13_whole_table(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    at, want = 0, []
    for i, ids in zip(docs["doc_id"], plain(docs["text"])):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.LLM_QUERIES["op13_bit_packed_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("block", [8, 64, 8192])
def test_op13_ranges_read_their_blocks_only(spark, sf, tmp_path, block, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    uri = T.write_tokens(docs, str(tmp_path / "t"), end_id=None, block=block)
    stream = np.concatenate(plain(docs.orderBy("doc_id").toPandas()["text"], None))
    told = T.manifest(uri)
    assert told["ids"] == len(stream) and sum(f["docs"] for f in told["files"]) == docs.count() and told["bits"] == 16
    read = []
    unpack = T.unpack_bits
    monkeypatch.setattr(T, "unpack_bits", lambda raw, n, bits: read.append(n) or unpack(raw, n, bits))
    for start, stop in ((0, 1), (5, 5), (17, 3000), (len(stream) - 1, len(stream)), (0, len(stream)), (len(stream) // 2, len(stream) // 2 + 9)):
        read.clear()
        assert (T.token_range(uri, start, stop) == stream[start:stop]).all()
        assert sum(read) <= (stop - start) + 2 * block * max(1, len(read))


def test_op13_odd_and_empty(spark, odd, empty, tmp_path):
    got = T.token_table(odd).collect()
    want = plain([r["text"] for r in odd.collect()])
    assert sorted(r["ids"] for r in got) == sorted(x.tobytes() for x in want)
    by_start = sorted(got, key=lambda r: r["start"])
    keys = [r["id"] for r in by_start]
    assert keys == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8] and [r["start"] for r in by_start] == np.cumsum([0] + [r["n_tokens"] for r in by_start])[:-1].tolist()
    assert {r["id"]: r["n_tokens"] for r in got}[2] == 1  # null: the end id alone
    assert T.token_table(empty).count() == 0
    again = odd.select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("start"))
    assert T.token_table(again).count() == 10


def test_op13_only_the_commit_counts(tmp_path):
    """What a lost attempt left is not read, and goes; a write without a commit isn't there."""
    batch = pa.RecordBatch.from_arrays([pa.array([3, None], pa.int64()), pa.array([np.arange(5, dtype="<u4").tobytes(), b""], pa.binary())], names=["id", "ids"])
    writer = T.TokenBitsWriter({"path": str(tmp_path / "x"), "vocabulary": "7"}, False)

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 4

    before, T.TaskContext = T.TaskContext, Task
    try:
        lost, kept = writer.write(iter([batch])), writer.write(iter([batch, batch]))
    finally:
        T.TaskContext = before
    with pytest.raises(FileNotFoundError):
        T.manifest(str(tmp_path / "x"))
    writer.commit([None, kept])
    assert not os.path.exists(tmp_path / "x" / lost.name)
    reader = T.TokenBitsReader({"path": str(tmp_path / "x")})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["id"], r["start"], r["n_tokens"]) for r in rows] == [(3, 0, 5), (None, 5, 0), (3, 5, 5), (None, 10, 0)]
    with pytest.raises(ValueError):
        T.TokenBitsWriter({"path": str(tmp_path / "x"), "vocabulary": "7"}, False)


def test_op13_long_documents_come_whole(monkeypatch):
    out = io.BytesIO()
    file = T.FileWriter(out, 5, 16)
    lengths = [0, 100, 3, 0, 16, 1]
    ids = np.random.default_rng(1).integers(0, 32, sum(lengths)).astype("<u4")
    for k, n in enumerate(lengths):  # one by one, so blocks fill over several calls
        at = sum(lengths[:k])
        file.add(np.array([k]), np.array([False]), np.array([n]), ids[at:at + n])
    assert file.close() == (6, 120)
    monkeypatch.setattr(T, "BATCH_IDS", 10)
    monkeypatch.setattr(T, "_filesystem", lambda uri: (type("F", (), {"open_input_file": lambda self, p: pa.BufferReader(out.getvalue())})(), uri))
    got = [r for b in T.TokenBitsReader({"path": "m"}).read(T.Part("m/x", 1000)) for r in b.to_pylist()]
    assert [r["n_tokens"] for r in got] == lengths and b"".join(r["ids"] for r in got) == ids.tobytes() and got[2]["start"] == 1100
