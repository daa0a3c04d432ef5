"""Helpers that the corpus operators share: durable intermediate tables, table
access and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Rows of texts are long: Python workers get them ARROW_ROWS at a time, not the usual ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What Python workers remember from task to task, by operator.
_remembered: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """The table in which a worker remembers things for an operator's next tasks."""
    return _remembered.setdefault(operator, {})


def let_go(operator: str) -> None:
    """In a worker: forget what other operators have remembered, and give back
    the memory that this and earlier tasks have freed. A worker serves a
    pipeline's stages one after the other, and neither Arrow nor the C library
    returns free memory by itself, so a stage would add to the one before it."""
    others = [t for k, t in _remembered.items() if k != operator and t]
    for t in others:
        t.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Only where that is unset and all runs in one process (tests) a
    temporary folder takes its place, one for each application; a cluster
    without the setting is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        path = _own_dir.setdefault(app, "") or tempfile.mkdtemp(prefix="marlspan-")
        _own_dir[app] = path
    return path.rstrip("/")


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends there, and a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlspan-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.durable_path = path
    return back


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a durable table that nothing reads any more."""
    _remove(df.sparkSession, df.durable_path)


def release(spark: SparkSession) -> None:
    """Remove all durable tables of this application; results that still read them are lost."""
    _remove(spark, f"{shared_dir(spark)}/marlspan-{spark.sparkContext.applicationId}")


def numbered(docs: DataFrame, row_col: str = "__row") -> DataFrame:
    """``docs`` written once with a number for each row, which stays the same
    however often and in whatever order the table is read again."""
    return durable(docs.withColumn(row_col, F.monotonically_increasing_id()), "numbered")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


SLICE_ROWS = 1000


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE_ROWS) -> Iterator[pd.DataFrame]:
    """Arrow batches in pieces, so that a task holds the working memory of few
    texts. Each piece is numbered from 0, whatever its place in the batch."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i:i + rows].reset_index(drop=True)


def objects(values: list) -> pd.Series:
    """A column of arrays or bytes, also where it is empty."""
    return pd.Series(values, dtype=object)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Edges of one vertex that a task may hold.
HUB_EDGES = 1 << 18
#: At most so many groups can have more than one in so many of all rows.
HOT_GROUPS = 1 << 16
LEAST_HOT = 64


def hot_groups(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """The groups of ``rows`` that have more than one in ``HOT_GROUPS`` of all
    rows, and more than ``LEAST_HOT``: at most ``HOT_GROUPS`` of them, small
    enough to broadcast whatever the table. Counts are combined before any shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > max(LEAST_HOT, n_rows // HOT_GROUPS)).drop("__n")


def spread(rows: DataFrame, keys: list[str], row_col: str, n_rows: int, out: str) -> DataFrame:
    """``rows`` with ``out``: null, but in hot groups the row's number, so that a
    hash of keys and ``out`` deals a hot group out and depends on nothing but the
    keys elsewhere."""
    hot = hot_groups(rows, keys, n_rows).select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__hot"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(F.broadcast(hot), same, "left").withColumn(out, F.when(F.col("__hot"), F.col(row_col))).drop("__hot", *[f"__{k}" for k in keys])


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n_rows: int, size: str = "n") -> DataFrame:
    """``rows`` with the columns of ``facts``, a durable table that has one row
    per group with ``size``, the number of its rows. Facts of hot groups (at most
    ``HOT_GROUPS`` of them, as in :func:`hot_groups`) come by broadcast, so their
    rows stay where they are; all others, and all where no group is hot, are
    joined by shuffle, at most one in ``HOT_GROUPS`` of the rows to a key. Keys
    must not be null."""
    bar = max(LEAST_HOT, n_rows // HOT_GROUPS)
    hot, rest = facts.where(F.col(size) > bar).drop(size), facts.where(F.col(size) <= bar).drop(size)
    if hot.isEmpty():
        return rows.join(rest.hint("merge"), keys)
    found = rows.join(F.broadcast(hot), keys)
    return found.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys))


def with_group_facts(rows: DataFrame, keys: list[str], spread: list, partial: dict, final: dict, leaves: int) -> DataFrame:
    """``rows`` with facts about their groups, without bringing a group together.

    A group is aggregated per leaf (``leaves`` of them, dealt by a hash of
    ``spread``), the leaves' results are aggregated per group, and the facts go
    back to the rows leaf by leaf: a join meets at most ``leaves`` rows of one
    group on one side and one leaf's share of it on the other. ``partial`` maps
    names to aggregates of rows, ``final`` maps the same or fewer names to
    aggregates of those. Keys must not be null.
    """
    dealt = rows.withColumn("__leaf", F.pmod(F.xxhash64(*spread), F.lit(leaves)).cast("int"))
    parts = dealt.groupBy("__leaf", *keys).agg(*[c.alias(k) for k, c in partial.items()])
    whole = parts.groupBy(*keys).agg(*[c.alias(k) for k, c in final.items()])
    down = parts.select("__leaf", *keys).join(whole, keys)
    return dealt.join(down, ["__leaf", *keys]).drop("__leaf")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``edges(a, b)`` of longs.

    Alternates large-star and small-star steps until no edge changes; every
    step is one or two shuffles of at most the edges, and the tables between
    steps are durable. A star step needs the minimum neighbour of each vertex,
    which is a pre-aggregated ``min``; it goes back to the edges by shuffle, and
    where a vertex has more than ``HUB_EDGES``, to the edges of hubs by broadcast
    (see :func:`join_facts`).

    Returns ``(node, component)`` for every vertex that has an edge, where
    ``component`` is the smallest vertex reachable. No edges: no rows.
    """
    e = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    e = durable(e, "cc")

    def size(edges: DataFrame) -> tuple:
        """Edges, the most at one vertex, and a sum that tells whether edges changed."""
        ends = edges.select(F.explode(F.array("u", "v")).alias("x"), F.hash("u", "v").cast("long").alias("h"))
        at = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
        total, most, h = at.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.sum("h")).first()
        return total // 2, most, h

    def met(rows: DataFrame, facts: DataFrame, n: int) -> DataFrame:
        if most > HUB_EDGES:
            return join_facts(rows, durable(facts, "star"), ["u"], n)
        return rows.join(facts.drop("n"), "u")

    n_edges, most, _ = size(e)
    signature = None
    for _ in range(rounds):
        # large star: neighbours larger than u are linked to the smallest neighbour of u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = (
            met(both, m, 2 * n_edges).where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = met(large, low, n_edges)
        small = (
            pairs.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        before, e = e, durable(small, "cc")
        discard(before)
        n_edges, most, *now = size(e)
        now = (n_edges, *now)
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
