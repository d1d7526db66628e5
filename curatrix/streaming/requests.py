"""Streaming forms of the replay of requests and of windowed counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def first_requests(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first request of each key within the watermark; later ones are dropped as duplicates.

    State is one entry for each key and goes once the watermark has passed it.
    """
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, width: str, *keys: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows for each window and key, late ones counted until the watermark passes the window."""
    w: Column = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, delay).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n"))


def outcomes(stream: DataFrame, key: str, at: str, eligible: str, keep: str | None = None) -> DataFrame:
    """key, at, outcome of each request: OK once, then DUPLICATE_REQUEST; NOT_ELIGIBLE for others.

    Requests of one micro-batch are taken in the order of ``at`` within each Arrow batch, micro-batches in
    that of their arrival. One flag for each key is the state, held by Spark and written with each micro-batch.
    With ``keep`` (an interval such as "30 days") a key is forgotten once the watermark, that far behind the
    newest request, has passed its last request by as much; later rows than the watermark are dropped. Without
    it state is kept for ever, and grows with the number of keys.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, `{at}` timestamp, outcome string"
    wait = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else 0

    def step(name, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        done, newest = state.exists and state.get[0], 0
        for pdf in batches:
            pdf = pdf.sort_values(at)
            newest = max(newest, int(pdf[at].max().timestamp() * 1000))
            told = []
            for ok in pdf[eligible].tolist():
                if not ok:
                    told.append("NOT_ELIGIBLE")
                elif done:
                    told.append("DUPLICATE_REQUEST")
                else:
                    told.append("OK")
                    done = True
            yield pd.DataFrame({key: pdf[key], at: pdf[at], "outcome": told})
        state.update((bool(done),))
        if keep:
            state.setTimeoutTimestamp(max(newest + wait, state.getCurrentWatermarkMs() + 1))

    source = stream.withWatermark(at, keep) if keep else stream
    timeout = GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout
    return source.groupBy(key).applyInPandasWithState(step, out, "done boolean", "append", timeout)


#: The state store that lists and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at: pd.Timestamp) -> int:
    """Milliseconds since 1970, rounded up, so that a request is told only when the watermark has reached it."""
    at = pd.Timestamp(at)
    return -(-(at.tz_localize("UTC") if at.tz is None else at).value // 1_000_000)


class InOrder(StatefulProcessor):
    """Holds the requests of a key until the watermark has passed them, then tells their outcomes in order."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at timestamp, row string, ok boolean")
        self.done = handle.getValueState("done", "done boolean, last long")

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r) for pdf in rows for r in pdf[["at", "row", "ok"]].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            # One timer at the earliest is enough: what waits behind it is told then, or gets a timer of its own.
            self.handle.registerTimer(min(_ms(r[0]) for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if _ms(r[0]) <= mark]
        later = rows[len(ready) :]
        done, last = self.done.get() if self.done.exists() else (False, 0)
        told, earlier, instant = [], done, None
        for at, _, ok in ready:
            if at != instant:  # at one instant none comes before the others
                earlier, instant = done, at
            told.append("DUPLICATE_REQUEST" if earlier else "OK" if ok else "NOT_ELIGIBLE")
            done = bool(done or ok)
        if ready:
            last = _ms(ready[-1][0])
            self.done.update((done, last))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if self.keep_ms is not None:
                self.handle.registerTimer(last + self.keep_ms)
        elif not later and self.keep_ms is not None and last + self.keep_ms <= mark:
            self.done.clear()
        if later:
            self.handle.registerTimer(_ms(later[0][0]))
        if ready:
            yield pd.DataFrame({"key": [key[0]] * len(ready), "at": [r[0] for r in ready], "row": [r[1] for r in ready], "outcome": told})

    def close(self) -> None:
        pass


def ordered_outcomes(stream: DataFrame, key: str, at: str, row: str, eligible: str, delay: str, keep: str | None = None) -> DataFrame:
    """key, at, row, outcome of each request, in event time: what ``policy.replay_requests`` gives for the whole table.

    Requests wait in a list of their key until the watermark, ``delay`` behind the newest request, has passed them, and
    are then told in the order of ``at``: DUPLICATE_REQUEST after an eligible one of an earlier instant, else OK or NOT_ELIGIBLE. So
    the order of arrival doesn't matter; rows that are later than the watermark are dropped. ``row`` names a request. A key's list
    is as long as its requests of ``delay``. With ``keep`` a key is forgotten once the watermark is that far behind its last
    request; without it one flag for each key stays. The session's state store must be STATE_STORE.
    """
    kind = stream.schema[key].dataType.simpleString()
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    rows = stream.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(row).cast("string").alias("row"), F.coalesce(F.col(eligible), F.lit(False)).alias("ok"))
    told = rows.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(InOrder(keep_ms), f"key {kind}, at timestamp, row string, outcome string", "append", "eventTime")
    return told.select(F.col("key").alias(key), F.col("at").alias(at), "row", "outcome")
