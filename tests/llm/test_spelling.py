"""Near words against deletion neighbourhoods, forms and roots on planted words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspan.llm import queries, spelling
from oracle import check, connection

NEVER = 1 << 40


def test_op12_matches_its_sql(spark, sf):
    check(queries.LLM_QUERIES["op12_rare_qgram_spelling"](spark, sf), connection(sf), queries.OP12_SQL)


def near_by_deletion(vocabulary):
    """Ordered pairs that are equal after one code point of one or of both is taken out at the same place."""
    out, cut = set(), lambda w, k: w[:k] + w[k + 1:]
    for a in vocabulary:
        for b in vocabulary:
            if len(a) == len(b) and a != b and any(cut(a, k) == cut(b, k) for k in range(len(a))):
                out.add((a, b))
            if len(a) == len(b) + 1 and any(cut(a, k) == b for k in range(len(a))):
                out |= {(a, b), (b, a)}
    return out


@pytest.mark.parametrize("tile", [2, 1024])
def test_op12_near_words_of_a_dense_alphabet(spark, tile):
    rng = np.random.default_rng(12)
    vocabulary = sorted({"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(250)} | {"a" * n for n in range(5, 12)})
    got = spelling.near_words(spark.createDataFrame([(w,) for w in vocabulary], "word string"), tile=tile).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == near_by_deletion(vocabulary)


def test_op12_forms_and_roots(spark):
    texts = ["color " * 40, "colour " * 20, "colours " * 8, "coloursz " * 3, "tasty " * 3, "hasty " * 6, "pasty " * 6, "Étoile étoile " * 3]
    docs = spark.createDataFrame([(None, t, 1, "x") for t in texts], "doc_id long, text string, n int, word string")
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(docs, every=NEVER).collect()}
    assert got["color"] == (40, 1, None, None, "color") and got["colours"] == (8, 2, "colour", 20, "color")
    assert got["coloursz"] == (3, 1, "colours", 8, "color")
    assert got["tasty"] == (3, 2, "hasty", 6, "hasty") and got["hasty"][2] is None
    assert got["Étoile"] == (3, 1, None, None, "Étoile")  # only A-Z is lower-cased


def test_op12_odd(spark, odd, empty):
    assert spelling.spelling_variants(empty).count() == 0
    got = {r["word"]: r["n"] for r in spelling.spelling_variants(odd, every=NEVER).collect()}
    assert got == {"quick": 5, "brown": 5, "jumps": 5}
    whole = spelling.spelling_variants(odd.where("doc_id = 4"), every=NEVER, least_chars=3)
    assert [tuple(r) for r in whole.collect()] == [("word", 3000, 0, None, None, "word")]
    # every run is given an error: whatever code point goes, four are left
    assert spelling.word_counts(odd, every=1, least_chars=4).agg(F.max(F.length("word"))).first()[0] == 4


def test_op12_planted_errors(spark):
    text = " ".join(f"w{chr(97 + i)}{chr(97 + j)}ords" for i in range(26) for j in range(26))
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    import zlib

    want = set()
    for w in text.split():
        h = zlib.crc32(f"7:{w}".encode())
        want.add(w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:])
    assert {r["word"] for r in spelling.word_counts(docs, least_count=1).collect()} == want and any(len(w) == 6 for w in want)
