"""Layers against a recursive merge of parsed documents."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from marlspan.operators import layered as L


def clean(d):
    """Without nulls and empty objects."""
    out = {k: clean(v) if isinstance(v, dict) else v for k, v in d.items()}
    return {k: v for k, v in out.items() if v is not None and v != {}}


def merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def flat(d, before=""):
    return {p: x for k, v in d.items() for p, x in (flat(v, f"{before}{k}.") if isinstance(v, dict) else {f"{before}{k}": v}).items()}


def random_document(rng, depth=3):
    value = lambda: rng.choice([1, 2.5, "x", 'q"\\ é', True, [1, {"a": 2}], None, {}])
    return {k: random_document(rng, depth - 1) if depth and rng.random() < 0.5 else value() for k in rng.sample(["a", "b", "b c", 'd"', "é"], rng.randint(1, 4))}


def test_merges_and_differences(spark):
    rng = random.Random(4)
    docs = {k: [random_document(rng) for _ in range(rng.randint(1, 4))] for k in range(60)}
    rows = [(k, i, json.dumps(d)) for k, layers in docs.items() for i, d in enumerate(layers)]
    layers = spark.createDataFrame(rows, "id int, layer int, json string").persist()
    want = {}
    for k, v in docs.items():
        whole = {}
        for d in v:
            whole = merge(whole, clean(d))
        want[k] = clean(whole)
    got = {r["id"]: r["json"] for r in L.deep_merge(layers, ["id"]).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    for k, text in got.items():
        assert json.dumps(json.loads(text), sort_keys=True) == json.dumps(json.loads(text)), text  # names in order
    first, last = layers.where("layer = 0").drop("layer"), layers.where("layer = 1").drop("layer")
    diff = {(r["id"], r["path"]): (r["before"], r["after"]) for r in L.deep_diff(first, last, ["id"]).collect()}
    for k, v in docs.items():
        a, b = flat(clean(v[0])), flat(clean(v[1])) if len(v) > 1 else {}
        assert {p for i, p in diff if i == k} == {p for p in {*a, *b} if a.get(p) != b.get(p) or type(a.get(p)) is not type(b.get(p))}, (k, a, b)
        for p in {p for i, p in diff if i == k}:
            x, y = diff[k, p]
            assert (json.loads(x) if x else None) == a.get(p) and (json.loads(y) if y else None) == b.get(p)


def test_numbers_texts_and_depth(spark):
    docs = lambda *x: spark.createDataFrame(list(enumerate(x)), "id int, json string")
    assert L.deep_diff(docs('{"a": 1, "b": "1"}', "no json", None, "[1]", "{}"), docs('{"a": 1.0, "b": 1}', None, "5", "{}", "[]"), ["id"]).collect() == [(0, "b", '"1"', "1")]
    with pytest.raises(PySparkException, match="too deeply at a.b"):
        L.leaves(docs('{"a": {"b": {"c": 1}}}'), ["id"], depth=2).collect()
