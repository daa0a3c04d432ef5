"""Refreshing series: what is fetched anew, and what follows from it.

Derived series are formulas over others, derived ones too. They are worked out
level by level: a level has the series whose inputs are all of lower ones, and
all its formulas are one job. Of a derived series only the rows from the first
time on at which an input changed are worked out again.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import formula_sql

#: Rows of the common grid over which an input's last value holds.
FILL = 10


def levels(formulas: dict[str, tuple[str, dict[str, str]]]) -> list[list[str]]:
    """The derived series ``{id: (formula, names)}`` in the order of their
    inputs, ``names`` mapping a formula's identifiers to series. A formula that
    needs itself, at whatever distance, is refused."""
    left, known, out = dict(formulas), set(), []
    while left:
        ready = sorted(s for s, (_, names) in left.items() if all(i in known or i not in formulas for i in names.values()))
        if not ready:
            raise ValueError(f"formulas that need each other: {', '.join(sorted(left))}")
        out.append(ready)
        known |= set(ready)
        for s in ready:
            del left[s]
    return out


def _value(formula: str, names: dict[str, str]) -> str:
    places = {name: f"v{k}" for k, name in enumerate(names)}
    return re.sub(r"(`[^`]+`|[\d.]+D|\)) / (`[^`]+`)", r"\1 / nullif(\2, 0)", formula_sql(formula, places))


def evaluate(rows: DataFrame, formulas: dict[str, tuple[str, dict[str, str]]], since: DataFrame | None = None, fill: int = FILL) -> DataFrame:
    """One level of formulas over ``rows(series_id, ts, value)``: ``series_id,
    ts, value``. The inputs of each are put side by side on all their times, hold
    for at most ``fill`` rows, and the formula gives a row where all are there.
    With ``since(series_id, since)``, only rows from then on, of those series."""
    spark = rows.sparkSession
    wide = max(len(names) for _, names in formulas.values())
    uses = spark.createDataFrame([(d, s, k) for d, (_, names) in formulas.items() for k, s in enumerate(names.values())], "derived string, series_id string, place int")
    inputs = rows.join(F.broadcast(uses), "series_id")  # the catalog's formulas, not the data
    grid = inputs.groupBy("derived", "ts").agg(*[F.max(F.when(F.col("place") == k, F.col("value"))).alias(f"v{k}") for k in range(wide)])
    if since is not None:
        grid = grid.join(since.withColumnRenamed("series_id", "derived"), "derived")
        earlier = F.row_number().over(Window.partitionBy("derived", F.col("ts") < F.col("since")).orderBy(F.desc("ts")))
        grid = grid.withColumn("back", earlier).where((F.col("ts") >= F.col("since")) | (F.col("back") <= fill))
    w = Window.partitionBy("derived").orderBy("ts").rowsBetween(-fill, 0)
    held = grid.select("derived", "ts", *([] if since is None else ["since"]), *[F.last(f"v{k}", ignorenulls=True).over(w).alias(f"v{k}") for k in range(wide)])
    complete = lambda d: F.expr(" AND ".join(f"v{k} IS NOT NULL" for k in range(len(formulas[d][1]))))
    value = F.coalesce(*[F.when((F.col("derived") == d) & complete(d), F.expr(_value(*formulas[d]))) for d in formulas])
    if since is not None:
        held = held.where(F.col("ts") >= F.col("since"))
    return held.select(F.col("derived").alias("series_id"), "ts", value.cast("double").alias("value")).where("value IS NOT NULL")


def recompute(base: DataFrame, formulas: dict[str, tuple[str, dict[str, str]]], fill: int = FILL) -> DataFrame:
    """All derived series of ``base`` from the beginning."""
    every, out = base, []
    for level in levels(formulas):
        out.append(evaluate(every, {s: formulas[s] for s in level}, fill=fill))
        every = every.unionByName(out[-1])
    return reduce(DataFrame.unionByName, out)


def changed(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of ``fetched`` that are new or differ from the stored ones."""
    old = stored.select("series_id", "ts", F.col("value").alias("before"), F.lit(True).alias("known"))
    return fetched.join(old, ["series_id", "ts"], "left").where(F.col("known").isNull() | ~F.col("value").eqNullSafe(F.col("before"))).select("series_id", "ts", "value")


def refresh(stored: DataFrame, fetched: DataFrame, formulas: dict[str, tuple[str, dict[str, str]]], fill: int = FILL, keep=lambda df, name: df) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """What a fetch changes in ``stored``, base and derived series alike: the rows
    that are written and, for derived series, the time from which the stored ones
    give way to them. ``keep(df, name)`` may write a level's result down, so that
    the next ones read it instead of working it out again."""
    fresh = keep(changed(stored, fetched), "fetched")
    written, replaced = [fresh], []
    begins = fresh.groupBy("series_id").agg(F.min("ts").alias("since"))
    current = stored.join(fresh.select("series_id", "ts"), ["series_id", "ts"], "left_anti").unionByName(fresh)
    for level in levels(formulas):
        of = {s: formulas[s] for s in level}
        uses = stored.sparkSession.createDataFrame([(d, s) for d, (_, names) in of.items() for s in names.values()], "derived string, series_id string")
        since = keep(begins.join(F.broadcast(uses), "series_id").groupBy(F.col("derived").alias("series_id")).agg(F.min("since").alias("since")), "since")
        rows = keep(evaluate(current, of, since, fill), "derived")
        written.append(rows)
        replaced.append(since)
        begins = begins.unionByName(since)
        stale = current.join(since, "series_id", "left").where(F.col("since").isNull() | (F.col("ts") < F.col("since"))).drop("since")
        current = stale.select(rows.columns).unionByName(rows)
    none = begins.limit(0)
    return reduce(DataFrame.unionByName, written), reduce(DataFrame.unionByName, replaced, none)
