"""Queries of alerts and of streams replayed to their end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from marlspan.operators import alerts as A
from marlspan.operators.events import quiet
from marlspan.sources import views
from marlspan.streaming import quotes as Q
from marlspan.streaming import stateful as W

from .registry import Register

reg = Register()
query = reg.query
RULES = [
    ("high", None, True, 80.0, "above", 20.0, 1.0, 3, 900.0, False), ("low", "U3", True, 10.0, "below", 5.0, 0.5, 0, 900.0, False), ("turn", "U5", True, 50.0, "cross", 30.0, 0.0, 5, 900.0, True),
    ("off", "U1", False, 1.0, "above", 0.0, 0.0, 0, 900.0, False),
]


def rules(spark):  # noqa: ANN001, ANN202
    kinds = "string string boolean double string double double int double boolean".split()
    return spark.createDataFrame(RULES, ", ".join(f"{n} {k}" for n, k in zip(["rule_id", "ticker", "enabled", *A.RULE_FIELDS], kinds)))


def _shared(spark) -> str:  # noqa: ANN001
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or tempfile.mkdtemp(prefix="marlspan-")


def _stream(spark, d):  # noqa: ANN001, ANN202
    return Q.event_stream(spark, d)


def readings(spark, d):  # noqa: ANN001, ANN202
    return views.table(spark, d, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("ticker"), "event_id", "ts", "value")


EV = "ev AS (SELECT 'U' || (user_id % 20) AS ticker, event_id, ts::TIMESTAMP AS ts, value FROM events)"


@query("latest_quote_state", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY ticker) AS quotes FROM ev) SELECT ticker, ts, value AS last, quotes FROM r WHERE k = 1")
def _(spark, d):
    return Q.run_to_end(Q.latest_quotes(_stream(spark, d)), "complete", _shared(spark))


@query("quote_stream", f"WITH {EV}, r AS (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS start FROM ev), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, start ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY ticker, start) AS quotes FROM r) SELECT ticker, start, value AS last, quotes FROM k WHERE k = 1 AND start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM ev)")
def _(spark, d):
    return Q.run_to_end(Q.windowed_quotes(_stream(spark, d), "1 hour", "1 day"), "append", _shared(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_stream", f"""WITH {EV}, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS new FROM ev),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY ticker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT ticker, min(ts) AS start, count(*) AS quotes FROM i GROUP BY ticker, i HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM ev)""")
def _(spark, d):
    return Q.run_to_end(Q.sessions(_stream(spark, d), "30 minutes", "1 day"), "append", _shared(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def guarded(df):  # noqa: ANN001, ANN202
    """Readings with what the guards look at: age, source, open market."""
    k = F.col("event_id")
    return df.withColumns({"age": F.when(k % 50 == 0, 1000.0).otherwise(10.0), "grey": k % 30 == 7, "is_open": F.hour("ts").between(8, 16)})


@query("alert_state_machine")
def _(spark, d):
    return Q.run_to_end(Q.alerts(guarded(_stream(spark, d)).join(F.broadcast(rules(spark).where("ticker IS NULL AND enabled").drop("ticker", "enabled")))), "append", _shared(spark))


@query("alert_replay")
def _(spark, d):
    return A.replay(A.with_rules(guarded(readings(spark, d)), rules(spark)))


RULE_ROWS = ", ".join(f"('{r[0]}', {repr(r[1]) if r[1] else 'NULL'}, {r[2]}, {r[3]})" for r in RULES)


@query("state_rule_join", f"WITH {EV}, s AS (SELECT ticker, max(value) AS metric FROM ev GROUP BY 1), r AS (SELECT * FROM (VALUES {RULE_ROWS}) t(rule_id, ticker, enabled, threshold)) SELECT s.ticker, rule_id, metric, metric >= threshold AS over FROM s JOIN r ON enabled AND (r.ticker IS NULL OR r.ticker = s.ticker)")
def _(spark, d):
    state = readings(spark, d).groupBy("ticker").agg(F.max("value").alias("metric"))
    return A.with_rules(state, rules(spark)).select("ticker", "rule_id", "metric", (F.col("metric") >= F.col("threshold")).alias("over"))


KINDS = list(A.DIRECTIONS)


@query("alert_metric", f"""WITH {EV}, x AS (SELECT event_id, {KINDS}[event_id % {len(KINDS)} + 1] AS kind, CASE WHEN event_id % 11 <> 0 THEN value END AS last, value - 50 AS chg, CASE WHEN event_id % 7 <> 0 THEN 60.0 END AS fv, CASE WHEN event_id % 5 <> 0 THEN 70.0 END AS target FROM ev)
SELECT event_id, round(CASE kind WHEN 'series_threshold' THEN chg WHEN 'price_above' THEN last WHEN 'price_below' THEN last WHEN 'pct_change_gt' THEN abs(chg) WHEN 'consensus_gap_gt' THEN (target / nullif(last, 0) - 1) * 100
WHEN 'implied_growth_lt' THEN CASE WHEN last IS NOT NULL THEN 4.0 END WHEN 'upside_gt' THEN (fv / nullif(last, 0) - 1) * 100 WHEN 'price_crosses_fv' THEN (last / fv - 1) * 100 ELSE (1 - last / fv) * 100 END, 6) AS metric FROM x""")
def _(spark, d):
    k, v = F.col("event_id"), F.col("value")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % len(KINDS) + 1).cast("int"))
    m = A.metric(kind, F.when(k % 11 != 0, v), v - 50, F.when(k % 7 != 0, 60.0), F.when(k % 5 != 0, 70.0), F.lit(0.04), v - 50)
    return readings(spark, d).select("event_id", F.round(m, 6).alias("metric"))


@query("prev_close_for_trade", f"""WITH {EV}, s AS (SELECT ticker, max(ts)::DATE - 5 AS day, max(value) AS last, CASE WHEN ticker <> 'U4' THEN min(value) END AS before FROM ev WHERE ticker <> 'U9' GROUP BY 1)
SELECT event_id, CASE WHEN s.ticker IS NULL THEN 1.0 WHEN (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE > s.day THEN s.last ELSE coalesce(s.before, 1.0) END AS prev_close FROM ev LEFT JOIN s USING (ticker)""")
def _(spark, d):
    r = readings(spark, d)
    s = r.where("ticker <> 'U9'").groupBy("ticker").agg(F.date_sub(F.to_date(F.max("ts")), 5).alias("day"), F.max("value").alias("last"), F.min(F.when(F.col("ticker") != "U4", F.col("value"))).alias("before"))
    return A.prev_close(r.withColumn("fallback", F.lit(1.0)), s).select("event_id", "prev_close")


@query("digest", f"WITH {EV} SELECT CASE WHEN event_id % 2 = 0 THEN 'mail' ELSE 'chat' END AS channel, ts::DATE AS day, count(*) AS n, array_to_string(list_sort(list_distinct(list(ticker))), ',') AS tickers FROM ev WHERE value > 95 AND (hour(ts) >= 22 OR hour(ts) < 7) GROUP BY 1, 2")
def _(spark, d):
    r = readings(spark, d).where("value > 95").withColumn("channel", F.when(F.col("event_id") % 2 == 0, "mail").otherwise("chat"))
    return A.digest(r, quiet(F.hour("ts") * 60 + F.minute("ts"), 22 * 60, 7 * 60))


@query("quote_stale", f"WITH {EV}, l AS (SELECT ticker, max(ts) AS ts FROM ev GROUP BY 1) SELECT ticker, date_diff('second', ts, TIMESTAMP '2024-02-01') > 900 AS stale FROM l")
def _(spark, d):
    age = F.timestamp_diff("SECOND", F.max("ts"), F.lit("2024-02-01").cast("timestamp_ntz"))
    return readings(spark, d).groupBy("ticker").agg((age > 900).alias("stale"))


@query("json_extract", "SELECT event_id, json_type(props) = 'OBJECT' AS is_object FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", F.expr("from_json(props, 'MAP<STRING,STRING>') IS NOT NULL").alias("is_object"))


QUOTED = """qt AS (SELECT *, event_id % 5 = 0 AS reference, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN NULL ELSE value - 1 END AS prev_close FROM ev)"""


def quoted(df):  # noqa: ANN001, ANN202
    """Readings as quotes: every fifth is a reference, some of those without a previous close."""
    k = F.col("event_id")
    return df.withColumns({"last": F.col("value"), "reference": k % 5 == 0, "prev_close": F.when((k % 5 == 0) & (k % 3 == 0), None).otherwise(F.col("value") - 1)})


def in_batches(df, at, n):  # noqa: ANN001, ANN202
    """``df`` as a stream of ``n`` micro-batches, rows dealt out whatever their time."""
    df.repartition(n, F.xxhash64("event_id")).write.mode("overwrite").parquet(at)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def book(spark, d, at, n=3):  # noqa: ANN001, ANN202
    r = quoted(readings(spark, d))
    split = r.where("ticker <> 'U7'").agg(F.percentile_approx("event_id", 0.4)).first()[0]
    return W.quote_book(in_batches(r.where((F.col("event_id") > split) | (F.col("ticker") == "U7")), f"{at}/quotes", n), r.where((F.col("event_id") <= split) & (F.col("ticker") != "U7")))


@query("quote_book", f"""WITH {EV}, {QUOTED}, q AS (SELECT * FROM qt QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1), r AS (SELECT * FROM qt WHERE reference QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1),
h AS (SELECT q.ticker, q.ts, q.value AS last, CASE WHEN q.reference OR r.ticker IS NULL THEN q.prev_close WHEN (q.ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE > (r.ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE THEN r.value ELSE coalesce(r.prev_close, q.prev_close) END AS prev_close
  FROM q LEFT JOIN r ON q.ticker = r.ticker) SELECT ticker, ts, last, prev_close, round(CASE WHEN prev_close <> 0 THEN (last / prev_close - 1) * 100 END, 6) AS change_pct FROM h""")
def _(spark, d):
    at = f"{_shared(spark).rstrip('/')}/book-{uuid.uuid4().hex}"
    told = W.newest_versions(W.run_stateful(book(spark, d, at), "update", at))
    return told.select("ticker", "ts", "last", "prev_close", F.round("change_pct", 6).alias("change_pct"))


def alarms(df):  # noqa: ANN001, ANN202
    return df.where("value > 80").select("event_id", F.when(F.col("event_id") % 2 == 0, "mail").otherwise("chat").alias("channel"), F.col("event_id").alias("id"), "ticker", "ts")


@query("digest_queue", f"""WITH {EV}, a AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'mail' ELSE 'chat' END AS channel, (date_trunc('day', ts) + INTERVAL 7 HOUR + CASE WHEN hour(ts) >= 22 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)::TIMESTAMP AS flushed_at FROM ev WHERE value > 80 AND (hour(ts) >= 22 OR hour(ts) < 7))
SELECT channel, flushed_at, count(*) AS n, array_to_string(list_sort(list_distinct(list(ticker))), ',') AS tickers, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM a WHERE flushed_at <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM a) GROUP BY 1, 2""")
def _(spark, d):
    at = f"{_shared(spark).rstrip('/')}/digest-{uuid.uuid4().hex}"
    return W.run_stateful(W.digest_queue(alarms(_stream(spark, d)), 22 * 60, 7 * 60, "1 day"), "append", at)
