"""State across micro-batches in any order, and across a restart."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlspan.streaming import stateful as W

QUOTES = "ticker string, event_id long, ts timestamp_ntz, last double, prev_close double, reference boolean"
T = lambda day, hour: dt.datetime(2024, 3, day, hour)
# A: a trade on the day after its reference in New York; B: on the reference's day, which tells no close, then one that does; C: a reference is newest
ROWS = [("A", 1, T(5, 21), 10.0, 9.0, True), ("A", 2, T(6, 12), 11.0, 7.0, False), ("A", 3, T(6, 11), 50.0, 7.0, False), ("A", 4, T(4, 20), 99.0, 98.0, True),
        ("B", 5, T(5, 15), 20.0, None, True), ("B", 6, T(6, 2), 22.0, 21.0, False), ("B", 7, T(5, 16), 21.0, 19.0, True), ("C", 8, T(5, 15), 5.0, 4.0, False), ("C", 9, T(5, 15), 6.0, None, True), ("D", 10, T(5, 1), 3.0, 0.0, False)]
WANT = {"A": (T(6, 12), 11.0, 10.0), "B": (T(6, 2), 22.0, 19.0), "C": (T(5, 15), 6.0, None), "D": (T(5, 1), 3.0, 0.0)}


def fed(spark, folder, rows, schema):
    """Rows as files that a stream reads one by one."""
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("turn", [0, 1])
def test_quotes_heal_in_any_order_and_after_a_restart(spark, tmp_path, turn):
    rows = [ROWS, ROWS[::-1]][turn]
    known, first, second = rows[:3], rows[3:6], rows[6:]
    at, folder = str(tmp_path / "book"), str(tmp_path / "in")
    run = lambda: W.run_stateful(W.quote_book(stream_of(spark, folder, QUOTES), spark.createDataFrame(known, QUOTES)), "update", at)
    fed(spark, folder, first, QUOTES)
    before = run().count()
    assert run().count() == before  # nothing new, nothing told again
    fed(spark, folder, second, QUOTES)
    told = run().persist()
    streamed = {r[0] for r in first + second}
    got = {r["ticker"]: (r["ts"], r["last"], r["prev_close"]) for r in W.newest_versions(told).collect()}
    assert got == {k: v for k, v in WANT.items() if k in streamed}
    assert told.groupBy("ticker", "version").count().where("count > 1").count() == 0
    assert all(r["change_pct"] is None for r in told.where("ticker = 'D'").collect())  # no change against nothing


def test_digest_tells_each_item_once(spark, tmp_path):
    schema = "channel string, id long, ticker string, ts timestamp_ntz"
    night, next_night = [("mail", 1, "A", T(5, 23)), ("mail", 2, "B", T(6, 3)), ("chat", 3, "A", T(6, 6)), ("mail", 4, "C", T(6, 12))], [("mail", 5, "A", T(6, 22)), ("mail", 6, "A", T(7, 23)), ("chat", 7, "Z", T(9, 1))]
    at, folder = str(tmp_path / "digest"), str(tmp_path / "alarms")
    run = lambda: sorted(tuple(r) for r in W.run_stateful(W.digest_queue(stream_of(spark, folder, schema), 22 * 60, 7 * 60, "1 hour"), "append", at).collect())
    fed(spark, folder, night, schema)
    assert run() == []  # no item of the day moves event time past the morning: 12 o'clock is not quiet, so it is no item
    fed(spark, folder, next_night, schema)
    want = [("chat", T(6, 7), 1, "A", "3"), ("mail", T(6, 7), 2, "A,B", "1,2"), ("mail", T(7, 7), 1, "A", "5"), ("mail", T(8, 7), 1, "A", "6")]
    assert run() == want and run() == want


def test_quiet_hours_within_a_day(spark, tmp_path):
    schema = "channel string, id long, ticker string, ts timestamp_ntz"
    fed(spark, str(tmp_path / "x"), [("c", 1, "A", T(5, 13)), ("c", 2, "B", T(5, 14)), ("c", 3, "B", T(8, 13))], schema)
    got = W.run_stateful(W.digest_queue(stream_of(spark, str(tmp_path / "x"), schema), 13 * 60, 14 * 60, "1 minute"), "append", str(tmp_path / "y")).collect()
    assert [tuple(r) for r in got] == [("c", T(5, 14), 1, "A", "1")]


def test_other_streams_keep_their_store(spark):
    assert spark.conf.get(W.PROVIDER, None) != W.ROCKS
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_alerts_hold_a_reading_only(monkeypatch):
    from marlspan.operators import alerts as A
    from marlspan.streaming import quotes as Q

    a = pd.DataFrame({"rule_id": "r", "ticker": "A", "event_id": [3, 1], "ts": pd.to_datetime(["2024-01-03", "2024-01-01"]), "value": [90.0, 10.0], "threshold": 80.0, "direction": "above",
                      "hysteresis": 1.0, "cooldown_hours": 0.0, "daily_cap": 0, "stale_seconds": 900.0, "allow_grey": False})
    b = a.assign(event_id=[2, 4], ts=pd.to_datetime(["2024-01-02", "2024-01-04"]), value=[85.0, 70.0])

    class Ruled:
        def groupBy(self, *keys):  # noqa: ANN002, ANN202, N802
            return self

        def applyInPandasWithState(self, step, *rest):  # noqa: ANN001, ANN002, ANN202, N802
            class Kept:
                exists, update = False, staticmethod(lambda x: None)

            self.sizes, concat = [], pd.concat
            monkeypatch.setattr(Q.pd, "concat", lambda parts, **k: (self.sizes.extend(set(p.columns) for p in parts), concat(parts, **k))[1])
            self.told = concat(list(step(("r", "A"), iter([a, b]), Kept())))
            return self

    got = Q.alerts(Ruled())
    assert all(c <= set(Q.READING) for c in got.sizes) and len(got.sizes) == 2
    assert got.told["event_id"].tolist() == [1, 2, 3, 4] and got.told["outcome"].tolist() == A.run_rows(A.rule_of(a), A.State(), pd.concat([a, b]))["outcome"].tolist()


def test_an_end_of_quiet_hours_reads_its_own_items_only():
    class State:
        def __init__(self):  # noqa: ANN204
            self.rows = []

        def appendValue(self, x):  # noqa: ANN001, ANN202, N802
            self.rows.append(x)

        def get(self):  # noqa: ANN202
            return iter(self.rows)

        def clear(self):  # noqa: ANN202
            self.rows.clear()

    class Handle:
        def __init__(self):  # noqa: ANN204
            self.state, self.timers = State(), []

        def getListState(self, *x):  # noqa: ANN002, ANN202, N802
            return self.state

        def registerTimer(self, x):  # noqa: ANN001, ANN202, N802
            self.timers.append(x)

    class Expiry:
        def getExpiryTimeInMs(self):  # noqa: ANN202, N802
            return 1000

    h, q = Handle(), W.DigestQueue()
    q.init(h)
    list(q.handleInputRows(("mail", 1000), iter([pd.DataFrame({"id": [3, 1], "ticker": ["B", "A"], "until": 1000}), pd.DataFrame({"id": [2], "ticker": ["B"], "until": 1000})]), None))
    assert len(h.state.rows) == 2 and h.timers == [1000]
    (out,) = q.handleExpiredTimer(("mail", 1000), None, Expiry())
    assert out.iloc[0].tolist() == ["mail", pd.Timestamp(1, unit="s"), 3, "A,B", "1,2,3"] and not h.state.rows
