"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample of the vectors serves as pivots. Each vector is described by
its ``prefix`` nearest pivots in order. The inverted lists are kept per pair
of pivots, so that exactly those vectors meet that share two pivots or more;
for vectors that meet, the shared pivots are counted, and pairs that share
``min_shared`` are verified with the cosine in double precision. Lists longer
than ``tile`` are worked through in tiles, each a task of its own, all of them.

Equal vectors are collapsed before indexing and count through the size of their
class. Pivots are at most ``MAX_PIVOTS``; their number follows the square root
of the number of vectors, so lists stay about as long as the data grow.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component link with nothing, as do vectors of different dimensions;
repeated rows are vectors of their own; a row with a null id links like any
other, names no component and isn't kept, and a component of such rows alone has
a null name; magnitudes don't matter, however large or small; an empty table
gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, join_facts, shuffle_width, with_group_facts

MAX_PIVOTS = 8192
PREFIX = 6
MIN_SHARED = 2
TILE = 1024
CALL_ROWS = 8192


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    # scaled by a power of two first: squares neither overflow nor vanish, and nothing is rounded
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(vec):
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows ``id, vec, row, ok`` and, of those that can link, the class of
    equal vectors: its first row ``cls``, its size ``n``, its smallest id ``low``."""
    kind = "float" if vectors.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "double"  # floats travel as such
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    # -0.0 equals 0.0
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind))).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("ok", usable(F.col("vec")))
    rows = rows.withColumn("digest", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("vec")).cast("binary"), 256)))
    rows = durable(rows, "vectors")
    grouped = with_group_facts(
        rows.where("ok").select("id", "row", "digest"), ["digest"], [F.col("row")],
        {"cls": F.min("row"), "n": F.count("*"), "low": F.min("id")}, {"cls": F.min("cls"), "n": F.sum("n"), "low": F.min("low")},
        shuffle_width(vectors.sparkSession),
    )
    return rows, grouped.select("id", "row", "cls", "n", "low")


def _apart(sample: np.ndarray, cosine: float = 0.7) -> np.ndarray:
    """The vectors of ``sample`` that aren't close to an earlier one: a dense
    cluster gets one pivot, as the order of several would be noise."""
    kept: list[int] = []
    near = np.zeros(len(sample), dtype=bool)
    for i in range(len(sample)):
        if not near[i]:
            kept.append(i)
            near |= sample @ sample[i] >= cosine
    return sample[kept]


def pivot_lists(reps: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """Adds ``near``: the numbers of the nearest pivots, nearest first."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        p = shared.value
        for b in batches:
            near = np.empty(len(b), dtype=object)
            for i in range(0, len(b), 2048):
                part = b["vec"].iloc[i:i + 2048]
                same = np.array([len(v) == p.shape[1] for v in part], dtype=bool)
                k = min(prefix, len(p))
                for j in np.flatnonzero(~same):
                    near[i + j] = []
                if same.any():
                    cos = _unit(part[same]) @ p.T
                    top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(p) else np.tile(np.arange(len(p)), (len(cos), 1))
                    order = np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1)
                    for j, o in zip(np.flatnonzero(same), order):
                        near[i + j] = o.astype("int32").tolist()
            yield b.assign(near=near)

    return reps.mapInPandas(nearest, f"cls long, n long, vec {reps.schema['vec'].dataType.simpleString()}, near array<int>")


def _shared_first(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of pivot numbers: how many they share, and the two smallest of those as a list's number."""
    common = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.int64(1) << 40)
    common.sort(axis=1)
    return (common < np.int64(1) << 40).sum(axis=1), common[:, 0] << 16 | common[:, 1]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that hold the same vectors together as all of ``(a, b)``."""
    up: dict[int, int] = {}
    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = x, y
        while (w := up.get(u, u)) != u:
            up[u] = up.get(w, w)
            u = w
        while (w := up.get(v, v)) != v:
            up[v] = up.get(w, w)
            v = w
        if u != v:
            up[v] = u
            kept.append((x, y))
    return kept


def _links_of(threshold: float, min_shared: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        keys = g[["list", "a_tile", "b_tile"]].to_numpy()
        order = np.lexsort((g["cls"], keys[:, 2], keys[:, 1], keys[:, 0]))
        keys, salts = keys[order], g["salt"].to_numpy()[order]
        ids, sizes, near = g["cls"].to_numpy()[order], g["n"].to_numpy()[order], np.stack(g["near"].to_numpy()[order]).astype(np.int64)
        m = _unit(g["vec"].to_numpy()[order])
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        lefts, rights = [], []
        for first, last in zip(starts, [*starts[1:], len(keys)]):
            lists, a_tile, b_tile = keys[first]
            same = a_tile == b_tile
            left = np.arange(first, last) if same else first + np.flatnonzero(salts[first:last] == a_tile)
            right = left if same else first + np.flatnonzero(salts[first:last] == b_tile)
            for i in range(0, len(left), 512):
                rows = left[i:i + 512]
                x, y = np.nonzero(m[rows] @ m[right].T >= threshold)
                p, q = rows[x], right[y]
                if same:
                    p, q = p[p < q], q[p < q]
                shared, told_in = _shared_first(near[p], near[q])
                # a pair meets in many lists and is told in the first
                told = (shared >= min_shared) & (told_in == lists)
                lefts.append(p[told])
                rights.append(q[told])
        p, q = np.concatenate(lefts), np.concatenate(rights)
        # a row for each vector with the links found here, and a forest of them
        ends, at = np.unique(np.r_[ids[p], ids[q]], return_inverse=True)
        links = np.bincount(at, np.r_[sizes[q], sizes[p]], minlength=len(ends)).astype("int64")
        kept = np.array(_forest(ids[p], ids[q]), dtype="int64").reshape(-1, 2)
        return pd.DataFrame({"a": np.r_[ends, kept[:, 0]], "b": np.r_[ends, kept[:, 1]], "links": np.r_[links, np.zeros(len(kept), "int64")]})

    return run


def near_links(reps: DataFrame, threshold: float, prefix: int = PREFIX, min_shared: int = MIN_SHARED, tile: int = TILE) -> DataFrame:
    """Links between classes as ``(a, b, links)``: where ``a = b``, a part of the
    number of other vectors that ``a`` is linked with, to be added up; else a
    link. The links connect what all links connect, but a dense group gives few
    of them. All vectors of ``reps(cls, n, vec)`` have the same dimension."""
    spark = reps.sparkSession
    if min_shared < 2:
        raise ValueError("the lists are kept per pair of pivots: min_shared is 2 at least")
    n = reps.count()
    out = "a long, b long, links long"
    n_pivots = int(min(MAX_PIVOTS, n, max(2 * prefix, 2 * n ** 0.5)))
    if n_pivots < 2:
        return spark.createDataFrame([], out)
    sample = reps.orderBy(F.xxhash64(F.lit(5), "cls"), "cls").limit(n_pivots).select("vec").collect()
    pivots = _apart(_unit([r[0] for r in sample]))
    if len(pivots) < 2 * prefix:  # all are close together: axes serve as further pivots
        pivots = np.vstack([pivots, np.eye(pivots.shape[1])[:2 * prefix]])
    indexed = durable(pivot_lists(reps, pivots, min(prefix, len(pivots))), "permutations")
    pairs = F.flatten(F.transform("near", lambda x: F.transform(
        F.filter("near", lambda y: y > x), lambda y: F.shiftleft(x.cast("long"), 16).bitwiseOR(y.cast("long")))))
    posted = indexed.select("cls", F.explode(pairs).alias("list"))
    lengths = posted.groupBy("list").agg(F.count("*").alias("long")).where("long > 1") \
        .select("list", "long", F.ceil(F.col("long") / tile).cast("int").alias("tiles"))
    lengths = durable(lengths, "lists")
    rows = lengths.agg(F.coalesce(F.sum(F.col("long") * F.col("tiles")), F.lit(0))).first()[0]
    # at most one list for each pair of pivots
    full = indexed.select("*", F.explode(pairs).alias("list"))
    full = join_facts(full, lengths.withColumnRenamed("long", "size"), ["list"], 15 * n, "size")
    salted = full.withColumn("salt", F.pmod(F.xxhash64(F.lit(13), "cls"), "tiles").cast("int"))
    tiled = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "list", F.least("salt", "other").alias("a_tile"), F.greatest("salt", "other").alias("b_tile"), "cls", "n", "vec", "near", "salt"
    )
    # short lists share a call; a tile is never divided
    calls = max(1, -(-int(rows) // CALL_ROWS))
    return tiled.withColumn("call", F.pmod(F.xxhash64("list", "a_tile", "b_tile"), F.lit(calls))).groupBy("call").applyInPandas(
        _links_of(threshold, min_shared), out)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: ``id, n_links, component, kept``."""
    rows, classes = vector_classes(vectors, id_col, vec_col)
    classes = durable(classes, "classes")
    firsts = classes.where("row = cls").select("cls", "n")
    reps = durable(firsts.join(rows.select(F.col("row").alias("cls"), "vec"), "cls").select("cls", "n", "vec"), "reps")
    dims = [r[0] for r in reps.select(F.size("vec").alias("d")).distinct().collect()]
    links = None
    for d in dims:
        part = near_links(reps.where(F.size("vec") == d), threshold)
        links = part if links is None else links.unionByName(part)
    if links is None:
        links = rows.sparkSession.createDataFrame([], "a long, b long, links long")
    links = durable(links, "links")
    degree = links.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("m"))
    comps = connected_components(links.where("a <> b").select("a", "b")).select(F.col("node").alias("cls"), "component")
    facts = firsts.join(degree, "cls", "left").join(comps, "cls", "left")
    lows = classes.groupBy("cls").agg(F.min("low").alias("low"))
    facts = durable(facts.join(lows, "cls").select(
        "cls", "n", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"), "low"), "facts")
    names = facts.groupBy("component").agg(F.min("low").alias("name"), F.count("*").alias("size"))
    facts = durable(join_facts(facts, durable(names, "names"), ["component"], rows.count(), "size").select("cls", "n", "n_links", "name"), "named")
    linked = join_facts(classes.drop("n"), facts, ["cls"], rows.count())
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    every = linked.select("id", "n_links", F.col("name").alias("component")).unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
