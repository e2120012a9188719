"""Attempt logs as a stream: each request is closed once, by its answer or by a timer.

A request is settled when an attempt that ends it has arrived together with all before it.
If none does, the request is still open until its last backoff is over: an event-time
timer closes it then with what has arrived. The state of a request is a few numbers, and
it is forgotten when no further attempt can come, so the state follows the open requests.

Requests share state and timers by hash, as a call for each of them takes far longer than
its work: a group of them is one call, worked out on whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.times import MAX_RETRIES
from ..operators.requests import classify, delays_ms, with_waits

# Time an answer may take beyond the backoff; attempts later than that are late.
GRACE_MS = 30_000
# Groups of requests. A micro-batch reads and writes the open requests of each group it meets.
GROUPS = 1024
# The group of requests without an id.
_NO_ID = -1
# Attempts that wait before they are folded.
_FOLD_ROWS = 65_536
_NUMBERS = ["request_id", "seen", "terminal", "deadline"]
_STATE = ", ".join(f"{c} ARRAY<BIGINT>" for c in _NUMBERS) + ", outcome ARRAY<STRING>, closed ARRAY<BOOLEAN>"
_RESULT = "request_id BIGINT, resolution STRING, attempts_made INT"


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per request of rows in order of arrival: attempts seen (a bit each), the first that
    ends the request (0: none), its outcome, whether it is closed, when its timer runs out."""
    if rows.empty:
        return rows
    rank = rows["terminal"].where(rows["terminal"] > 0, np.iinfo(np.int64).max)
    rows = rows.iloc[np.lexsort((rank, rows["request_id"]))].reset_index(drop=True)
    ids = rows["request_id"].to_numpy()
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    combined = {"seen": np.bitwise_or, "deadline": np.maximum, "closed": np.logical_or}
    return rows.iloc[starts].assign(**{c: how.reduceat(rows[c].to_numpy(), starts) for c, how in combined.items()})


class Closer(StatefulProcessor):
    """Open requests of a group. One timer stands for the one that runs out first."""

    def __init__(self, max_retries: int, grace_ms: int, delays: list[int]):
        self.most, self.grace_ms, self.delays = max_retries + 1, grace_ms, delays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("requests", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, waiting = [self._open()], 0
        for frame in rows:
            parts.append(self._arrived(frame))
            waiting += len(frame)
            if waiting >= _FOLD_ROWS:
                parts, waiting = [fold(pd.concat(parts))], 0
        requests = fold(pd.concat(parts))
        settled = requests["terminal"].where(requests["terminal"] > 0, self.most)
        before_it = np.left_shift(1, settled) - 1
        answered = ~requests["closed"] & (requests["seen"] & before_it == before_it)
        yield from self._results(key, requests[answered])
        requests["closed"] |= answered
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield from self._close_until(key, requests, timerValues.getCurrentWatermarkInMs() - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Spark deletes the timer that has run out, the only one of the group
        over = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        yield from self._close_until(key, self._open(), over)

    def _open(self) -> pd.DataFrame:
        columns = self.held.get() if self.held.exists() else [[] for _ in range(len(_NUMBERS) + 2)]
        held = pd.DataFrame(dict(zip([*_NUMBERS, "outcome", "closed"], columns)))
        return held.astype({**dict.fromkeys(_NUMBERS, "int64"), "outcome": "object", "closed": "bool"})

    def _arrived(self, frame: pd.DataFrame) -> pd.DataFrame:
        attempt = frame["attempt"].to_numpy().astype("int64")
        ends = (frame["outcome"] != "retryable").to_numpy()
        return pd.DataFrame({
            "request_id": frame["request_id"].to_numpy(), "seen": np.left_shift(1, attempt - 1), "terminal": np.where(ends, attempt, 0),
            "deadline": frame["at_ms"].astype("int64").to_numpy() + np.array(self.delays)[attempt - 1] + self.grace_ms,
            "outcome": frame["outcome"].where(ends, "").to_numpy(), "closed": False,
        })

    def _close_until(self, key, requests: pd.DataFrame, over: int) -> Iterator[pd.DataFrame]:
        """Close and forget the requests whose time is over; the others are kept with a timer."""
        ended = requests["deadline"] <= over
        kept = requests[~ended]
        if kept.empty:
            self.held.clear()
        else:
            self.held.update(tuple(kept[c].tolist() for c in [*_NUMBERS, "outcome", "closed"]))
            self.handle.registerTimer(int(kept["deadline"].min()))
        yield from self._results(key, requests[ended & ~requests["closed"]])

    def _results(self, key, closed: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if closed.empty:
            return
        ends = closed["terminal"] > 0
        last_seen = closed["seen"].map(int.bit_length)
        yield pd.DataFrame({
            "request_id": pd.Series([None] * len(closed), dtype="Int64") if key[0] == _NO_ID else closed["request_id"].to_numpy(),
            "resolution": closed["outcome"].where(ends, "failed").to_numpy(),
            "attempts_made": closed["terminal"].where(ends, last_seen).to_numpy().astype("int32"),
        })

    def close(self) -> None:
        pass


def resolve_stream(
    attempts: DataFrame, time: str, lateness: str = "1 minute", max_retries: int = MAX_RETRIES, grace_ms: int = GRACE_MS, groups: int = GROUPS
) -> DataFrame:
    """Final outcome of each request of a streamed log (``request_id, attempt, status,
    payload`` and the event time): as ``operators.requests.resolve`` gives it for the whole log,
    if attempts follow each other within their backoff and the grace."""
    judged = classify(attempts.withWatermark(time, lateness)).where((F.col("attempt") >= 1) & (F.col("attempt") <= max_retries + 1))
    group = F.when(F.col("request_id").isNull(), _NO_ID).otherwise(F.pmod(F.xxhash64("request_id"), F.lit(groups)).cast("int"))
    narrow = judged.select(
        group.alias("group"), F.coalesce("request_id", F.lit(0)).cast("bigint").alias("request_id"), "attempt", "outcome",
        F.unix_millis(time).alias("at_ms"), time,
    )
    closer = Closer(max_retries, grace_ms, delays_ms(max_retries + 1))
    closed = narrow.groupBy("group").transformWithStateInPandas(closer, _RESULT, "Append", "EventTime")
    return with_waits(closed)
