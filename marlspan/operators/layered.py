"""Nested documents in layers: JSON to (path, value) rows, later layers over
earlier ones, documents put together again, and what differs between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of objects inside each other; deeper ones are an error.
DEPTH = 8


def leaves(docs: DataFrame, keys: list[str], json_col: str = "json", depth: int = DEPTH) -> DataFrame:
    """``keys, path, value`` of every leaf of the documents ``docs(keys, json)``:
    ``path`` the names on the way, ``value`` its JSON text. Arrays are leaves;
    nulls and empty objects say nothing, as do texts that are no objects."""
    spark = docs.sparkSession
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    open_ = docs.select(*keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(json_col).alias("v")).where(is_object(F.col("v")))
    out = None
    for level in range(depth):
        inside = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*keys, F.concat("path", F.array("key")).alias("path"), F.col("value").alias("v"))
        inside = inside.where("v IS NOT NULL").where(~F.is_variant_null("v"))
        found = inside.where(~is_object(F.col("v"))).select(*keys, "path", F.to_json("v").alias("value"))
        out = found if out is None else out.unionByName(found)
        open_ = inside.where(is_object(F.col("v")))
    deeper = open_.select(*keys, "path", F.raise_error(F.concat(F.lit("objects are nested too deeply at "), F.array_join("path", "."))).cast("string").alias("value"))
    return out.unionByName(deeper)


def _begins(path: Column, other: Column) -> Column:
    """Whether ``other`` is on the way to ``path``, and not ``path`` itself."""
    return (F.size(other) < F.size(path)) & (F.slice(path, F.lit(1), F.size(other)) == other)


def merged_leaves(rows: DataFrame, keys: list[str], layer_col: str = "layer") -> DataFrame:
    """The leaves that hold of ``rows(keys, layer, path, value)``: of a path the
    last layer's, unless a still later layer has a value on the way to it, or an
    object in its place. A document's leaves meet in one row."""
    last = rows.groupBy(*keys, "path").agg(F.max(layer_col).alias("layer"), F.max_by("value", layer_col).alias("value"))
    whole = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "layer", "value"))).alias("all"))
    beaten = lambda x: F.exists("all", lambda y: (y["layer"] > x["layer"]) & (_begins(x["path"], y["path"]) | _begins(y["path"], x["path"])))
    return whole.select(*keys, F.inline(F.filter("all", lambda x: ~beaten(x))))


def _shared(a: Column, b: Column) -> Column:
    """How many names two paths begin with in common."""
    both = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    return F.aggregate(both, F.lit(0), lambda n, k: F.when((k > 0) & (n == k - 1) & (F.get(a, k - 1) == F.get(b, k - 1)), k).otherwise(n))


def documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, json``: the documents that ``rows(keys, path, value)`` are the
    leaves of, names in order at every level. Leaves in order are one text: from
    one to the next some objects end and some begin."""
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("all"))
    quoted = lambda name: F.to_json(F.to_variant_object(F.array(name)))
    name = lambda n: F.substring(quoted(n), F.lit(2), F.length(quoted(n)) - 2)
    folder = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("all"), i - 1)["path"], F.array().cast("array<string>"))
        held = F.when(i == 0, F.lit(0)).otherwise(_shared(folder(before), folder(x["path"])))
        ends = F.when(i == 0, F.lit("")).otherwise(F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - held), F.lit(",")))
        opens = F.transform(F.slice(folder(x["path"]), held + 1, F.size(x["path"])), lambda n: F.concat(name(n), F.lit(":{")))
        return F.concat(ends, F.array_join(opens, ""), name(F.element_at(x["path"], -1)), F.lit(":"), x["value"])

    text = F.array_join(F.transform("all", piece), "")
    return whole.select(*keys, F.concat(F.lit("{"), text, F.repeat(F.lit("}"), F.size(F.element_at("all", -1)["path"])), ).alias("json"))


def deep_merge(layers: DataFrame, keys: list[str], layer_col: str = "layer", json_col: str = "json", depth: int = DEPTH) -> DataFrame:
    """``keys, json``: the layers of each key put over each other, later ones on top."""
    return documents(merged_leaves(leaves(layers, [*keys, layer_col], json_col, depth), keys, layer_col), keys)


def deep_diff(a: DataFrame, b: DataFrame, keys: list[str], json_col: str = "json", depth: int = DEPTH) -> DataFrame:
    """``keys, path, before, after`` of every leaf that differs between the
    documents of ``a`` and ``b``, dotted paths; numbers are compared as numbers."""
    left, right = (leaves(x, keys, json_col, depth).withColumnRenamed("value", n) for x, n in ((a, "before"), (b, "after")))
    both = left.join(right, [*keys, "path"], "full")
    number = lambda c: F.col(c).try_cast("double")
    same = F.col("before").eqNullSafe(F.col("after")) | F.coalesce(number("before") == number("after"), F.lit(False))
    return both.where(~same).select(*keys, F.array_join("path", ".").alias("path"), "before", "after")
