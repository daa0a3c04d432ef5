"""Mixing sources to target weights by entropy balancing.

Every token of the corpus has the base rate 1. Among all rates between 0 and
``cap`` that meet the token totals asked for, the ones closest to 1 in relative
entropy are ``min(cap, exp(sum of the multipliers of the document's groups))``.
The multipliers maximise a concave dual, which Newton steps solve: each step
is one aggregation of the residual and the curvature per group. Documents that
share their groups share their rate, so the steps run over the table of group
cells (token sums), which was aggregated before any shuffle. Rates are then
rounded into whole copies: blocks of documents of bounded size are taken
largest first, and each block's error is carried from one document to the next,
so that a group's total strays by its smallest documents only.

Defined results: null text has size 0 and takes nothing; a null source is a
source of its own, ordered last; sources without a word get target 0; repeated
rows are documents of their own; an empty table gives an empty result; columns
of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, durable, join_facts, spread

BLOCK = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """``sources(source, tokens)`` with ``target``: ``share`` of all tokens by
    weight, none above ``cap`` times its source; the excess goes to the others
    by weight. The level is found by ordering sources by ``cap * tokens /
    weight``: those that fill up first are capped, and one division over the
    rest gives everyone else's level.
    """
    # code points order as UTF-8 bytes do; null last
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    )
    full = F.col("tokens") * F.lit(float(cap))
    w = ranked.withColumn("level", full / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    w = w.withColumns({
        "budget": F.sum("tokens").over(everything) * F.lit(float(share)),
        "capped": F.coalesce(F.sum(full).over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(rest),
    })
    # the level that holds if everything before this source is capped and the rest is not
    w = w.withColumn("water", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    # the first source that its level doesn't fill decides; levels only fall after it
    w = w.withColumn("settled", F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select(
        "source", "tokens", F.coalesce(F.least(full, F.col("settled") * F.col("weight")), full).alias("target")
    )


def balance(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame], cap: float = 2.0,
            steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """Multipliers for ``cells(*margins, tokens)``: adds ``rate``.

    ``targets[m]`` is ``(m, target)``. One Newton step per margin in turn; a
    step is held to one unit and kept inside the cap, so the concave dual rises
    at every step. Stops when no margin is off by more than ``tolerance`` of
    its target.
    """
    state = cells.select(*margins, F.col("tokens").cast("double").alias("tokens"), F.lit(0.0).alias("eta"))
    rate = F.least(F.lit(float(cap)), F.exp("eta"))
    top, held = float(np.log(cap)), None
    for step in range(steps):
        worst = 0.0
        for m in margins:
            sums = state.groupBy(m).agg(
                F.sum(F.col("tokens") * rate).alias("__got"),
                # capped tokens have no curvature; they come back if the step is downwards
                F.sum(F.when(F.col("eta") <= top, F.col("tokens") * F.exp("eta")).otherwise(0.0)).alias("__bend"),
            )
            goal = targets[m].select(F.col(m).alias("__key"), F.col("target").alias("__goal"))
            move = sums.join(goal, sums[m].eqNullSafe(goal["__key"])).select(
                m,
                F.abs(F.col("__got") - F.col("__goal")) / F.greatest(F.col("__goal"), F.lit(1.0)),
                F.when(F.col("__goal") <= 0, F.lit(-1e3))
                .when(F.col("__bend") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("__goal") - F.col("__got")) / F.col("__bend"))))
                .otherwise(F.when(F.col("__got") > F.col("__goal"), F.lit(-0.1)).otherwise(F.lit(0.0))),
            ).toDF("__m", "__off", "__step")
            # alone, a multiplier past the cap changes nothing; with others it may
            move = move.withColumn("__top", F.lit(top if len(margins) == 1 else top + 2.0))
            state = state.join(move, state[m].eqNullSafe(move["__m"]), "left").select(
                *[state[x] for x in margins], "tokens",
                F.least(F.col("__top"), F.col("eta") + F.coalesce("__step", F.lit(0.0))).alias("eta"),
                F.coalesce("__off", F.lit(0.0)).alias("__off"),
            )
            before, state = held, durable(state, "newton")
            if before is not None:
                discard(before)
            held = state
            worst = max(worst, state.where("tokens > 0").agg(F.max("__off")).first()[0] or 0.0)
            state = state.drop("__off")
        if worst <= tolerance:
            break
    return state.withColumn("rate", rate)


def _rounded(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Largest first; a document gets the whole number of copies nearest to its
    rate once the block's error so far is paid back."""
    for g in groups:
        g = g.sort_values(["size", "id", "row"], ascending=[False, True, True], kind="stable")
        size, rate = g["size"].to_numpy(), g["rate"].to_numpy()
        copies, owed = np.zeros(len(g), dtype="int64"), 0.0
        for i, (s, r) in enumerate(zip(size.tolist(), rate.tolist())):
            low = int(r) if s > 0 else 0
            n = low + (s > 0 and low < r and owed + (r - low) * s >= 0.5 * s)
            owed += (r - n) * s
            copies[i] = n
        yield g.assign(copies=copies)


def entropy_mix(
    docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
) -> DataFrame:
    """Per row: ``id, row, source, size, source_size, target, rate, copies``.
    ``row`` is ``row_col`` where that is given."""
    sized = durable(docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.col(row_col).alias("row") if row_col else F.monotonically_increasing_id().alias("row"),
    ), "sizes")
    cells = durable(sized.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")), "cells")
    targets = durable(weighted_targets(cells, weights, share, cap), "targets")
    rates = balance(cells, ["source"], {"source": targets}, cap).select("source", "rate")
    plan = targets.withColumnRenamed("source", "__t") \
        .join(rates.withColumnRenamed("source", "__r"), F.expr("__t <=> __r")) \
        .join(cells.select("source", "n").withColumnRenamed("source", "__n"), F.expr("__t <=> __n")) \
        .select(_key("__t"), F.col("tokens").alias("source_size"), "target", "rate", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"), "n")
    n_rows = int(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    # documents that share id and size are told apart by row, if they are many
    dealt = spread(sized, ["id", "size"], "row", n_rows, "__own").withColumn("__key", _key("source"))
    known = join_facts(dealt, durable(plan, "plan"), ["__key"], n_rows).select(
        "id", "row", "source", "size", "source_size", "target", "rate",
        F.pmod(F.xxhash64(F.lit(7), "id", "size", "__own"), "blocks").alias("block"),
    )
    out = "id long, row long, source string, size long, source_size long, target double, rate double, block long, copies long"
    return known.groupBy("source", "block").applyInPandas(_one_block, out).drop("block")


def _key(source: str) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("__key")


def _one_block(g: pd.DataFrame) -> pd.DataFrame:
    return next(_rounded(iter([g])))
