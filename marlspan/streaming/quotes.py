"""Streams of quotes: the last quote of each symbol, per window and overall, and
alerts as stateful streams. A stream is replayed from files until none are left."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marlspan.operators.alerts import OUTCOME, State, rule_of, run_rows

#: Columns of a reading that the machine looks at, and the rows that it tells at once.
READING, STEP_ROWS = ["event_id", "ts", "value", "age", "grey", "is_open"], 50_000


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """``ticker, event_id, ts, value`` of the events file in a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).select(
        F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("ticker"), "event_id", "ts", "value")


def run_to_end(stream: DataFrame, mode: str, shared: str) -> DataFrame:
    """:func:`run_at` in a new folder of ``shared``."""
    return run_at(stream, mode, f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}")


def run_at(stream: DataFrame, mode: str, at: str) -> DataFrame:
    """Runs ``stream`` over all there is and returns what it wrote. Each
    micro-batch writes a folder of its own, over whatever an earlier attempt at
    the same batch left there, so a batch that is run again is not told twice;
    in complete mode the last one is the result. A second run at the same folder
    goes on where the first ended."""
    out, schema = f"{at}/out", stream.schema
    target = (lambda n: out) if mode == "complete" else (lambda n: f"{out}/batch={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True) \
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(target(n))).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def latest_quotes(stream: DataFrame) -> DataFrame:
    """The newest quote of each symbol: a late older one replaces nothing."""
    return stream.groupBy("ticker").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("q"), F.count("*").alias("quotes")) \
        .select("ticker", F.col("q.ts").alias("ts"), F.col("q.value").alias("last"), "quotes")


def windowed_quotes(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """The last quote of each symbol in each tumbling window. In append mode a
    window is told, and its state dropped, once ``delay`` has passed after its end."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("ticker", F.window("ts", width)).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("quotes")) \
        .select("ticker", F.col("window.start").alias("start"), "last", "quotes")


def sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of quotes of a symbol with no pause longer than ``gap``, told in append
    mode once ``delay`` has passed after their end."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("ticker", F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("quotes")).select("ticker", F.col("s.start").alias("start"), "quotes")


def alerts(ruled: DataFrame) -> DataFrame:
    """The alert machine with its state kept per rule and ticker across micro-batches."""
    def step(key, batches, state):  # noqa: ANN001, ANN202
        s, rule, parts = State(*state.get) if state.exists else State(), None, []
        for g in batches:
            rule = rule or rule_of(g)
            parts.append(g[[c for c in READING if c in g]])  # what is the same in all rows of a group isn't kept
        told = pd.concat(parts, ignore_index=True)
        parts.clear()
        told = told.sort_values(["ts", "event_id"], ignore_index=True)
        for i in range(0, len(told), STEP_ROWS):
            yield run_rows(rule, s, told.iloc[i:i + STEP_ROWS].assign(rule_id=key[0], ticker=key[1]))
        state.update((s.armed, s.last_value, s.fired_at, s.day, s.fired_today))

    return ruled.groupBy("rule_id", "ticker").applyInPandasWithState(
        step, OUTCOME, "armed boolean, last_value double, fired_at double, day int, fired_today int", "append", GroupStateTimeout.NoTimeout)
