"""The pipeline's stages, each against the decisions that brute force takes."""

import corpus_pipeline as P
from marlspan.llm.common import durable, table

from test_operators import brute_components, words


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    one = durable(P.language_id(spark, docs, sf))
    assert one.columns == columns and one.count() == sum(1 for t in texts.values() if any(c.isalpha() for c in t or ""))
    two = durable(P.exact_dedup(spark, one, sf))
    assert two.columns == columns and two.count() == len({"".join(x.decode() for x in (r["text"] or "").encode().split()) for r in one.collect()})
    three = durable(P.near_dedup(spark, two, sf))
    left = brute_components({r["doc_id"]: r["text"] for r in two.collect()})
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == {c for _, c in left.values()}
    four = durable(P.mixing(spark, three, sf))
    n = sum(len(words(r["text"])) for r in three.collect())
    assert four.columns == columns and abs(sum(len(words(r["text"])) for r in four.collect()) - 1.5 * n) < 0.05 * n
    five = P.packing(spark, four, sf).toPandas()
    assert five["row"].nunique() == four.count() and five.groupby("sequence_id")["length"].sum().max() <= 2048


def test_empty_table(spark, sf, odd):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_columns_with_clashing_names(spark, sf):
    names = ["row", "_row", "copies", "lang_pred", "lang_score", "id", "size", "block", "__n"]
    docs = durable(table(spark, sf, "documents").limit(40).selectExpr("*", *[f"'own {n}' AS `{n}`" for n in names]))
    for _, stage in P.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf))
        assert {tuple(r) for r in docs.select(*[f"`{n}`" for n in names]).distinct().collect()} == {tuple(f"own {n}" for n in names)}
    assert P.packing(spark, docs, sf).count() >= docs.count() > 0


def test_mixing_takes_rows_without_an_id_one_by_one(spark, sf):
    docs = durable(table(spark, sf, "documents").selectExpr("cast(null AS long) AS doc_id", "text", "lang", "source", "n_chars"))
    n = sum(len(words(r["text"])) for r in docs.collect())
    assert abs(sum(len(words(r["text"])) for r in P.mixing(spark, docs, sf).collect()) - 1.5 * n) < 0.05 * n
