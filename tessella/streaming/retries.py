"""Misses that come back by themselves: attempts and due times of each asset and step as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "asset_id string, step string, what string, attempts int, due timestamp"


class Retries(StatefulProcessor):
    """A failure schedules the next attempt after wait * 2**(attempts - 1) seconds, and gives up after `most`; a success
    forgets the key. When a timer expires, the asset is due again."""

    def __init__(self, wait: int, most: int):
        self.wait, self.most = wait, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "attempts int, due long, over boolean")

    def _clear_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _row(self, key: tuple, what: str, attempts: int, due_ms: int | None) -> tuple:
        return (*key, what, attempts, None if due_ms is None else pd.Timestamp(due_ms, unit="ms"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for part in rows:
            for at, ok in sorted(zip(part["at"], part["ok"].astype(bool))):
                attempts, _, over = self.seen.get() if self.seen.exists() else (0, 0, False)
                if over:
                    continue  # given up: only a success counts any more, and there is none to wait for
                self._clear_timers()
                if ok:
                    self.seen.clear()
                    out.append(self._row(key, "done", attempts + 1, None))
                    continue
                attempts += 1
                if attempts >= self.most:
                    self.seen.update((attempts, 0, True))
                    out.append(self._row(key, "gave up", attempts, None))
                    continue
                due = int(pd.Timestamp(at).timestamp() * 1000) + self.wait * 1000 * 2 ** (attempts - 1)
                self.handle.registerTimer(due)
                self.seen.update((attempts, due, False))
                out.append(self._row(key, "missed", attempts, due))
        yield pd.DataFrame(out, columns=["asset_id", "step", "what", "attempts", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, due, over = self.seen.get() if self.seen.exists() else (0, 0, True)
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = [] if over or due != at else [self._row(key, "due", attempts, at)]
        yield pd.DataFrame(out, columns=["asset_id", "step", "what", "attempts", "due"])

    def close(self) -> None:
        pass


def retried(outcomes: DataFrame, late: str, wait: int = 60, most: int = 4) -> DataFrame:
    """asset_id, step, what, attempts, due of a stream of outcomes (asset_id, step, at, ok): `missed` with the time of the
    next attempt, `due` when event time has reached it, `done`, and `gave up` after `most` failures, after which
    further outcomes of the key are ignored. State lives by key in the checkpoint, so a restarted query knows all
    attempts and timers. Outcomes later than `late` are dropped. The session must use STORE."""
    marked = outcomes.withWatermark("at", late)
    return marked.groupBy("asset_id", "step").transformWithStateInPandas(Retries(wait, most), SCHEMA, "Append", "EventTime")
