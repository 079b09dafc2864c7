"""Fetches in time: a stream of wishes and outcomes becomes a stream of what to fetch when, host by host.

A host's fetches stand at least 1 / rate seconds apart. What failed is tried again: after the time that the server asks for (429, 30 s
if it names none), after 2**n seconds for server errors and lost connections, n counting the tries so far; at most `tries` more times. Other refusals end at once.

The state of a host is when it is free again and what waits, in Spark's state store; event-time timers let a fetch go when it is due, that
is, when the watermark has passed it. So the result depends on the rows alone, not on batches or restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Requests a second of a host, tries after the first, seconds that 429 without Retry-After waits.
RATE, TRIES, RETRY_AFTER = 5.0, 3, 30
#: Rows in: status and attempt are null for a wish; status is null, with an attempt, where no answer came.
ROWS = "host string, url string, at timestamp, attempt int, status int, retry_after int"
ACTIONS = "host string, url string, attempt int, action string, due timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_try(status: int | None, attempt: int, retry_after: int | None, tries: int = TRIES) -> tuple[str, float]:
    """(action, seconds to wait) after an outcome: done, failed, gave_up, or fetch again."""
    if status is not None and status < 400:
        return "done", 0.0
    again = status is None or status == 429 or status >= 500
    if not again:
        return "failed", 0.0
    if attempt >= tries:
        return "gave_up", 0.0
    return "fetch", float(RETRY_AFTER if retry_after is None else retry_after) if status == 429 else float(2**attempt)


class Throttle(StatefulProcessor):
    def __init__(self, rate: float = RATE, tries: int = TRIES):
        self.gap, self.tries = round(1000 / rate), tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "ms bigint")
        self.waiting = handle.getMapState("waiting", "ms bigint", "url string, attempt int")  # no two at one time

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows))
        frames["ms"] = frames["at"].astype("datetime64[ms]").astype("int64")
        frames = frames[frames["ms"] >= timerValues.getCurrentWatermarkInMs()]  # late rows
        out, free = [], self.free.get()[0] if self.free.exists() else 0
        for r in frames.sort_values(["ms", "url", "attempt"]).itertuples():
            tried = not pd.isna(r.attempt)
            status, after = (None if pd.isna(v) else int(v) for v in (r.status, r.retry_after))
            action, wait = next_try(status, int(r.attempt), after, self.tries) if tried else ("fetch", 0.0)
            if action == "fetch":
                due = max(r.ms + round(1000 * wait), free)
                free = due + self.gap
                self.waiting.updateValue((due,), (r.url, int(r.attempt) + 1 if tried else 0))
                self.handle.registerTimer(due)
            else:
                out.append((key[0], r.url, int(r.attempt), action, r.ms))
        self.free.update((free,))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.waiting.containsKey((due,)):
            url, attempt = self.waiting.getValue((due,))
            self.waiting.removeKey((due,))
            out.append((key[0], url, attempt, "fetch", due))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["host", "url", "attempt", "action", "due"])
        out["due"] = pd.to_datetime(out["due"], unit="ms")
        return out.astype({"attempt": "int32"})

    def close(self) -> None:
        pass


def throttled(rows: DataFrame, late: str = "10 seconds", rate: float = RATE, tries: int = TRIES) -> DataFrame:
    """Actions of a stream of rows as ROWS: `fetch` when a fetch is due, and how each url ended. Rows later than `late` are left out; the session's
    state store becomes RocksDB, which timers need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = rows.withWatermark("at", late).groupBy("host")
    return keyed.transformWithStateInPandas(statefulProcessor=Throttle(rate, tries), outputStructType=ACTIONS, outputMode="Append", timeMode="EventTime")
