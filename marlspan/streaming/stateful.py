"""Stateful streams: quotes whose previous close heals, and digests that wait
for the end of quiet hours. State is typed, kept per key in RocksDB, and comes
back with the checkpoint after a restart."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .quotes import run_at

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUOTE = "at long, id long, day int, last double, prev_close double, reference boolean"
QUOTES_OUT = "ticker string, ts timestamp_ntz, last double, prev_close double, change_pct double, version long"
DIGEST_OUT = "channel string, flushed_at timestamp_ntz, n long, tickers string, ids string"


def run_stateful(stream: DataFrame, mode: str, at: str) -> DataFrame:
    """:func:`run_at` with the state store that typed state needs; other streams keep theirs."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return run_at(stream, mode, at)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def quote_rows(quotes: DataFrame) -> DataFrame:
    """``quotes(ticker, event_id, ts, last, prev_close, reference)`` in the form
    the state has: instants as microseconds, days as New York has them."""
    utc = F.col("ts").cast("timestamp_ntz")
    day = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc).cast("date")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)
    return quotes.select("ticker", micros.alias("at"), F.col("event_id").alias("id"), F.datediff(day, F.lit("1970-01-01").cast("date")).alias("day"), "last", "prev_close", "reference")


def _healed(quote: tuple, reference: tuple | None) -> float | None:
    at, event, day, last, close, is_reference = quote
    if is_reference or reference is None:
        return close
    if day > reference[2]:
        return reference[3]
    return reference[4] if reference[4] is not None else close


class QuoteBook(StatefulProcessor):
    """The newest quote of a ticker and its newest reference quote, one that a
    provider tells with the session's previous close.

    An older quote replaces nothing, and an older reference neither; but where
    the newest quote is a streamed trade, a newer reference heals its previous
    close: on a later day than the reference that is the reference's last price,
    on its day the reference's own previous close, else the trade's. So the
    state doesn't follow from the order in which quotes arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quote = handle.getValueState("quote", QUOTE)
        self.reference = handle.getValueState("reference", QUOTE)
        self.told = handle.getValueState("told", "version long, prev_close double, at long, id long")

    @staticmethod
    def _newest(state, rows: list[tuple]) -> tuple | None:  # noqa: ANN001
        held = [tuple(state.get())] if state.exists() else []
        best = max(held + rows, key=lambda r: (r[0], r[1]), default=None)
        if best is not None and [best] != held:
            state.update(best)
        return best

    def _take(self, rows: pd.DataFrame) -> tuple:
        every = [tuple(None if v != v else v for v in r) for r in rows[["at", "id", "day", "last", "prev_close", "reference"]].itertuples(index=False)]
        every = [(int(r[0]), int(r[1]), int(r[2]), r[3], r[4], bool(r[5])) for r in every]
        return self._newest(self.quote, every), self._newest(self.reference, [r for r in every if r[5]])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        self._take(initialState)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        quote, reference = self._take(pd.concat(list(rows), ignore_index=True))
        close = _healed(quote, reference)
        before = tuple(self.told.get()) if self.told.exists() else (0, None, None, None)
        if before[1:] == (close, quote[0], quote[1]):
            return
        self.told.update((before[0] + 1, close, quote[0], quote[1]))
        yield pd.DataFrame({
            "ticker": [key[0]], "ts": [pd.Timestamp(quote[0], unit="us")], "last": [quote[3]], "prev_close": [close],
            "change_pct": [(quote[3] / close - 1) * 100 if close else None], "version": [before[0] + 1],
        })

    def close(self) -> None:
        pass


def quote_book(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each change of a ticker's quote as a row with a growing ``version``.
    ``known`` are quotes of a batch table that the state begins with."""
    first = None if known is None else quote_rows(known).groupBy("ticker")
    return quote_rows(stream).groupBy("ticker").transformWithStateInPandas(QuoteBook(), QUOTES_OUT, "Update", "None", first)


def newest_versions(told: DataFrame) -> DataFrame:
    cols = [c for c in told.columns if c != "ticker"]
    return told.groupBy("ticker").agg(F.max_by(F.struct(*cols), "version").alias("q")).select("ticker", "q.*")


class DigestQueue(StatefulProcessor):
    """Items of a channel that wait for one end of quiet hours, as the state of
    that channel and end, and a timer for it. When event time passes it, they
    become one message. The state has an entry for each batch of items."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "items string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for g in rows:
            self.waiting.appendValue((json.dumps([g["id"].tolist(), g["ticker"].tolist()]),))
        self.handle.registerTimer(int(key[1]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ids, tickers = [], set()
        for (items,) in self.waiting.get():
            more, named = json.loads(items)
            ids += more
            tickers.update(named)
        self.waiting.clear()
        if ids:
            yield pd.DataFrame({"channel": [key[0]], "flushed_at": [pd.Timestamp(int(key[1]), unit="ms")], "n": [len(ids)],
                                "tickers": [",".join(sorted(tickers))], "ids": [",".join(map(str, sorted(ids)))]})

    def close(self) -> None:
        pass


def digest_queue(stream: DataFrame, begin: int, end: int, delay: str) -> DataFrame:
    """``stream(channel, id, ticker, ts)``: one message per channel for each stretch
    of quiet hours from minute ``begin`` to minute ``end`` of the day, over midnight
    or not, of the items in it, told once event time is ``delay`` past its end."""
    utc = F.col("ts").cast("timestamp_ntz")
    minute = F.hour(utc) * 60 + F.minute(utc)
    quiet = (minute >= begin) | (minute < end) if begin > end else (minute >= begin) & (minute < end)
    day = F.date_trunc("day", utc) + F.make_dt_interval(F.when((minute >= begin) & F.lit(begin > end), 1).otherwise(0), F.lit(0), F.lit(end))
    until = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), day)
    items = stream.where(quiet).select("channel", "id", "ticker", until.alias("until"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return items.groupBy("channel", "until").transformWithStateInPandas(DigestQueue(), DIGEST_OUT, "Append", "EventTime")
