"""Alignment against a brute force that walks token spans of whole texts."""

import collections
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlspan.llm import queries, token_alignment as T

A, B = T.vocabulary("byte_bpe_50k.json"), T.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known():
    return T.Aligner(A, B)


def spans(tokens):
    ends = np.cumsum([len(x) for x in tokens]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def one(known, text):
    """Ids of both sides, groups and links of a whole text, or nothing."""
    if not text:
        return None
    a, b = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    left, right = [known.a_bytes[i] for i in a], [known.b_bytes[i] for i in b]
    if not b"".join(left) == b"".join(right) == (" " + text).encode():
        return None
    left, right = spans(left), spans(right)
    links, first = [], 0
    for k, (i, j) in enumerate(left):
        while right[first][1] <= i:
            first += 1
        m = first
        while m < len(right) and right[m][0] < j:
            links.append((a[k], b[m]))
            m += 1
    groups, k, m = [], 0, 0
    right_ends = {e: n + 1 for n, (_, e) in enumerate(right)}
    for n, (_, e) in enumerate(left):
        if e in right_ends:
            groups.append(",".join(map(str, a[k:n + 1])) + "|" + ",".join(map(str, b[m:right_ends[e]])))
            k, m = n + 1, right_ends[e]
    return len(a), len(b), groups, links


def brute_force(known, texts):
    found = [one(known, t) for t in texts]
    counts = collections.Counter(x for f in found if f for x in f[3])
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == top[x[1]] for x in f[3]), sum(counts[x] for x in f[3]),
        hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


def test_op11_whole_table(spark, sf, known):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries.LLM_QUERIES["op11_byte_owner_alignment"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *x) for i, x in zip(docs["doc_id"], brute_force(known, docs["text"])))


ODD = ["a b", "", None, "x ▁ y", "<0x41> <s> </s> <|endoftext|>", "line\r\nnext\r\n\r\n  two   three\t\tfour \n", "漢字 かな 🙂🙂 é ́x", "\x00 nul", " ", "\n", "  lead and trail  ",
       "a b", "word " * 3000, "x" * 5000, "▁", "a\xa0 b\u3000 c\x85 d"]


@pytest.mark.parametrize("by_unit, chars", [(True, 40), (True, 10**6), (False, 500)])
def test_op11_odd_texts(spark, known, monkeypatch, by_unit, chars):
    docs = spark.createDataFrame([(k % 5 or None, t, 1, "z") for k, t in enumerate(ODD)], "doc_id long, text string, n_a int, batch string")
    if not by_unit:
        monkeypatch.setattr(T, "_align", lambda a, b, n, f=T._align: _whole(f(a, b, n)))
    got = T.align_tokenizers(docs, batch_chars=chars).drop("row").collect()
    want = [(k % 5 or None, *x) for k, x in enumerate(brute_force(known, ODD))]
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def _whole(run):
    def as_whole(batches):
        T.aligner(A, B).by_unit = False
        T.aligner(A, B).forget()
        try:
            yield from run(batches)
        finally:
            T.aligner(A, B).by_unit = True
            T.aligner(A, B).forget()

    return as_whole


def test_op11_empty(spark, empty):
    assert T.align_tokenizers(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in T.align_tokenizers(nothing).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aAé. \n\r\t\xa0\u3000▁1'{}<>")), min_size=1, max_size=30))
def test_op11_units_are_the_text(known, text):
    """Cutting changes no token, and the units' sums are the text's."""
    known.forget()
    units = known.read([text])[0]
    want = one(known, text)
    if want is None:
        assert known.broken.all[units].any()
    else:
        assert ";".join(known.strings[u] for u in units) == ";".join(want[2]) and int(known.n_links.all[units].sum()) == len(want[3])
        assert (int(known.n_a.all[units].sum()), int(known.n_b.all[units].sum())) == want[:2]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.integers(1, 5))
def test_op11_owner_arrays(a, k):
    total = sum(a)
    b = [k] * (total // k) + ([total % k] if total % k else [])
    x, y, begins = T.overlaps(np.array(a), np.array(b))
    want = sorted({(int(i), int(j)) for i, j in zip(T.owners(a), T.owners(b))})
    assert list(zip(x.tolist(), y.tolist())) == want
    assert len(begins) == len({e for _, e in spans([b"x" * n for n in a])} & {e for _, e in spans([b"x" * n for n in b])})


def test_op11_results_do_not_follow_from_batches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    found = [sorted(map(tuple, T.align_tokenizers(docs, batch_chars=n).drop("row").collect())) for n in (2000, 10**7)]
    assert found[0] == found[1]


def test_op11_forgets_when_full(known, monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(T, "TaskContext", Task)
    monkeypatch.setattr(T, "KNOWN_UNITS", 4)
    texts = ["one two three", "four five six", "seven eight nine", "one two three"]
    rows = pa.RecordBatch.from_pydict({"row": list(range(4)), "id": list(range(4)), "text": texts})
    monkeypatch.setattr(T, "SLICE_CHARS", 1)
    batches = list(T._align(A, B, 10**6)(iter([rows])))
    docs = [r for b in batches for r in b.to_pylist() if r["row"] is not None]
    assert len(batches) == 2 and [r["n_groups"] for r in docs] == [len(one(known, t)[2]) for t in texts]
    assert len({r["batch"] for r in docs}) == 2
