"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records over buckets with a seeded hash; the number of
buckets follows the number of records, so a bucket fits in a task's memory.
Pass two puts each bucket in a canonical order and shuffles it with Spark's
``shuffle``, a seeded Fisher-Yates pass over the bucket's array. Bucket after
bucket, this is a random permutation of all records. Positions in it are dealt
to the shards in turn, so row counts differ by one at most (law ``rows``).

The number of tasks of pass two, and the order of the buckets in each, follow
from the number of buckets alone, so the draws of ``shuffle`` and with them the
result are the same under any setting of shuffle partitions.

Defined results: null text has size 8 and the checksum of the empty string;
null ids and repeated rows are records like any other; records that many rows
repeat (more than one in 65,536 of all) are spread over the buckets by their
row number; very long texts stay out of the arrays of :func:`shard_plan`, which
hold their checksums; an empty table gives no rows; extra columns are carried by
:func:`write_shards` and ignored by :func:`shard_plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, spread

#: Buckets are dealt to a task each up to this many, and then up to 64 to a task.
TASKS = 200


def _scattered(docs: DataFrame, columns: list, order: list, n_rows: int, n_buckets: int, seed: int) -> DataFrame:
    """Pass one: ``bucket`` and the canonical ``order`` key of each record."""
    keyed = docs.select(*order, F.struct(*columns).alias("rest"), F.monotonically_increasing_id().alias("row"))
    dealt = spread(keyed, ["id", "key"], "row", n_rows, "own")
    return dealt.select(
        F.pmod(F.xxhash64(F.lit(seed), "id", "key", "own"), F.lit(n_buckets)).alias("bucket"),
        F.struct("id", "key", "rest").alias("rec"),
    )


def _shuffled(scattered: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """Pass two: a Fisher-Yates shuffle inside each bucket; ``pos`` counts from 0."""
    n_tasks = min(n_buckets, max(TASKS, n_buckets // 64))
    tasks = scattered.withColumn("task", F.pmod("bucket", F.lit(n_tasks))).repartition(n_tasks, "task")
    buckets = tasks.groupBy("task", "bucket").agg(F.sort_array(F.collect_list("rec")).alias("recs")).sortWithinPartitions("bucket")
    return buckets.select("bucket", F.posexplode(F.shuffle("recs", F.lit(seed))).alias("pos", "rec"))


def _permuted(rows: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """``rec`` with its place ``at`` in the permutation of all records.

    The shuffled buckets are written before anything reads them. The buckets'
    first places are running sums of their sizes, by blocks of 4,096 buckets
    and then inside each block.
    """
    shuffled = durable(_shuffled(rows, n_buckets, seed), "shuffled")
    sizes = shuffled.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / 4096))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("whole")).select(
        "block", (F.sum("whole").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = sizes.join(blocks, "block").select("bucket", (F.col("before") + inside).alias("first"))
    return shuffled.join(starts, "bucket").select((F.col("first") + F.col("pos")).alias("at"), "rec")


def shard_plan(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 20, bucket_records: int = 4096,
) -> DataFrame:
    """Per row: ``id, size, text_crc32, shard, slot``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.count()
    n_buckets = max(1, -(-n // bucket_records))
    rows = _scattered(
        docs,
        [(F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")],
        [F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key")], n, n_buckets, seed,
    )
    return _permuted(rows, n_buckets, seed).select(
        "rec.id", "rec.rest.size", "rec.rest.text_crc32",
        F.pmod("at", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("at") / n_shards).cast("long").alias("slot"),
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 20,
    bucket_bytes: int = 64 << 20, file_rows: int = 100_000,
) -> None:
    """Write ``docs`` as ``path/shard=k/*.parquet`` with a column ``slot``, the
    files of a shard holding runs of ``file_rows`` slots in order.

    Buckets are sized by the bytes of the texts, so the second pass holds about
    ``bucket_bytes`` of them at a time. Columns named shard or slot are refused.
    """
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("shard and slot are columns that this operator writes")
    total, n = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    order = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key")]
    n_buckets = max(1, -(-int(total or 0) // bucket_bytes))
    placed = _permuted(_scattered(docs, docs.columns, order, n, n_buckets, seed), n_buckets, seed).select(
        F.pmod("at", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("at") / n_shards).cast("long").alias("slot"), "rec.rest.*",
    )
    files = n_shards * max(1, -(-n // (n_shards * file_rows)))
    placed.repartition(files, "shard", F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
