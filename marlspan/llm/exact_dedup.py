"""Exact duplicates by a tree merge of sorted digest runs.

Rows are hashed into leaves. Each leaf keeps one sorted run: a row per digest
with the best document and the number of documents. Runs of neighbouring
leaves are then merged in rounds, ``fan_in`` at a time, range by range of the
digest, until one run per range is left; each merge is a shuffle of the runs
(never of texts), a sort by digest and a streaming aggregate that retains the
best identifier. The verdicts travel back through the leaf runs, so a digest
that a third of all rows share meets at most ``leaves`` rows in a join.

Defined results: null text equals the empty text; null ids lose to any other
id and are reported as they are; of rows that are repeated entirely, exactly
one is kept; extra columns are ignored by :func:`exact_groups` and carried by
:func:`drop_exact_copies`; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, shuffle_width


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def _digests(docs: DataFrame, id_col: str, text_col: str, leaves: int) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
        F.char_length(norm).alias("norm_chars"),
        F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).alias("chars"),
    ).select(
        "*",
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.xxhash64("id", "chars"), F.lit(leaves)).cast("int").alias("leaf"),
        F.pmod(F.xxhash64("digest"), F.lit(leaves)).cast("int").alias("rng"),
    )


def _merge(runs: DataFrame, width: int) -> DataFrame:
    """One round: the runs of a node come together and are merged in order."""
    keys = ["rng", "node", "digest", "norm_chars"]
    return (
        runs.repartition(width, "rng", "node")
        .sortWithinPartitions(*keys)
        .groupBy(*keys)
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    leaves: int | None = None, fan_in: int = 8,
) -> DataFrame:
    """Per row: ``id, digest, keep, group_size, kept, chars``.

    Two texts are equal when digest and length of their normalised forms
    agree. The row with most code points stays, then the smallest id.
    """
    leaves = leaves or shuffle_width(docs.sparkSession)
    rows = durable(_digests(docs, id_col, text_col, leaves), "digests")
    # larger is better: more code points, an id at all, a smaller id, an earlier row
    best = F.struct(
        "chars", F.col("id").isNotNull().alias("has"), F.bitwise_not("id").alias("neg"), (-F.col("row")).alias("first")
    )
    runs = rows.groupBy("leaf", "rng", "digest", "norm_chars").agg(F.max(best).alias("best"), F.count("*").alias("n"))
    tree = runs.withColumn("node", F.col("leaf"))
    for _ in range(max(1, math.ceil(math.log(max(leaves, 2), fan_in)))):
        tree = _merge(tree.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")), leaves)
    winners = tree.select(
        "digest", "norm_chars", F.bitwise_not("best.neg").alias("keep"), (-F.col("best.first")).alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    verdicts = runs.select("leaf", "digest", "norm_chars").join(winners, ["digest", "norm_chars"])
    return rows.join(verdicts, ["leaf", "digest", "norm_chars"]).select(
        "id", F.lower(F.hex("digest")).alias("digest"), "keep", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), "chars",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops.

    Rows are found again by id and digest. Where several rows share both, one
    of them is left.
    """
    keys = (
        exact_groups(docs, id_col, text_col)
        .groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("chars").alias("__chars"))
        .agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
        .where("__kept")
        .withColumn("__id", F.coalesce("__id", F.lit(-(2**63))))
    )
    keyed = docs.withColumns({
        "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))),
        "__digest": F.sha2(normalised(F.col(text_col)).cast("binary"), 256),
        "__chars": F.coalesce(F.char_length(F.col(text_col)), F.lit(0)),
    })
    found = keyed.join(keys, ["__id", "__digest", "__chars"])
    once = found.where("__rows = 1")
    again = found.where("__rows > 1").dropDuplicates(["__id", "__digest", "__chars"])
    return once.unionByName(again).select(*docs.columns)
