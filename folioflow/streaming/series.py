"""Rates and the life of alerts over streams of samples, with state from batch to batch.

Samples carry label columns, ``ts`` (a timestamp), ``id`` and a value. A series
is one set of labels. Rows of a batch are taken in the order of time, then id;
samples that are older than the last one of their series are refused. The rows of
a series are arrays here: no loop goes over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def rate_machine(seconds: int, labels: list[str]) -> StatefulProcessor:
    """Per-second increase of a counter over the last ``seconds``; what is kept is the samples of that time. Made here, as its class is sent whole."""

    class Rates(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("kept", "t array<long>, total array<double>, value double")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            own = pd.concat(list(rows)).sort_values(["at", "id"])
            before = self.kept.get() if self.kept.exists() else None
            old_t, old_total = (np.array(before[0], np.int64), np.array(before[1])) if before else (np.zeros(0, np.int64), np.zeros(0))
            own = own[own["at"] >= old_t[-1]] if len(old_t) else own
            t, v = own["at"].to_numpy(np.int64), own["v"].to_numpy(np.float64)
            if not len(t):
                return
            step = np.diff(v, prepend=before[2] if before else v[0])
            ups = np.where(step < 0, v, step)  # a smaller value is a counter that began again
            every = np.concatenate([old_t, t])
            total = np.concatenate([old_total, (old_total[-1] if before else 0.0) + np.cumsum(ups)])
            first = np.searchsorted(every, t - seconds)
            span = t - every[first]
            rate = np.where(span > 0, (total[len(old_t) :] - total[first]) / np.maximum(span, 1), np.nan)
            keep = np.searchsorted(every, t[-1] - seconds)
            self.kept.update((every[keep:].tolist(), (total[keep:] - total[keep]).tolist(), float(v[-1])))
            out = pd.DataFrame({"id": own["id"].to_numpy(), "at": t, "rate": rate})
            yield out.assign(**dict(zip(labels, key, strict=True)))[[*labels, "id", "at", "rate"]]

        def close(self) -> None:
            pass

    return Rates()


def rates(samples: DataFrame, seconds: int, labels: list[str], value: str = "value") -> DataFrame:
    """labels, id, at (seconds) and rate of every sample: null where the window holds no earlier time."""
    rows = samples.filter(F.col(value).isNotNull() & F.col("ts").isNotNull()).select(*labels, "id", F.unix_seconds("ts").alias("at"), F.col(value).cast("double").alias("v"))
    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in labels)
    got = rows.groupBy(*labels).transformWithStateInPandas(rate_machine(seconds, labels), f"{kinds}, id long, at long, rate double", "append", "none")
    return got.withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))


def life_machine(hold: int, stale: int, labels: list[str]) -> StatefulProcessor:
    """The changes of an alert's state; what is kept is the open run of bad samples: since when, the last, and whether it fired."""

    class Life(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "since long, last long, fired boolean")

        def frame(self, key: tuple, at: np.ndarray, state: np.ndarray | list) -> pd.DataFrame:
            out = pd.DataFrame({"at": np.asarray(at, np.int64), "state": np.asarray(state, object)})
            return out.assign(**dict(zip(labels, key, strict=True)))[[*labels, "at", "state"]]

        def settle(self, since: int, last: int, fired: bool) -> None:
            """Keep an open run and wait for what comes next without a sample."""
            self.open.update((int(since), int(last), bool(fired)))
            due = last + stale if fired or since + hold >= last + stale else since + hold
            self.handle.registerTimer(int(due) * 1000)

        def forget(self) -> None:
            self.open.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            own = pd.concat(list(rows)).sort_values(["at", "id"])
            t, bad = own["at"].to_numpy(np.int64), own["bad"].to_numpy(bool)
            since0, last0, fired0 = self.open.get() if self.open.exists() else (None, None, False)
            self.forget()
            if since0 is not None:  # the open run goes on as its last sample
                t, bad = np.concatenate([[last0], t[t >= last0]]), np.concatenate([[True], bad[t >= last0]])
            gap = np.diff(t, prepend=t[:1]) > stale
            begins = bad & (gap | ~np.concatenate([[False], bad[:-1]]))
            first = np.flatnonzero(begins)
            if not len(first):
                return
            # a run ends before the next sample that is good or comes too late
            stops = np.append(np.flatnonzero((~bad | gap)[1:]) + 1, len(t))
            next_ = stops[np.searchsorted(stops, first, "right")]
            last = t[next_ - 1]
            since = t[first].copy()
            fresh = np.ones(len(first), bool)
            fired = np.zeros(len(first), bool)
            if since0 is not None:
                since[0], fresh[0], fired[0] = since0, False, fired0
            over = next_ < len(t)
            end = np.where(over, np.minimum(t[np.minimum(next_, len(t) - 1)], last + stale), last + 1)
            fires = ~fired & (end > since + hold)
            yield self.frame(key, since[fresh], ["pending"] * int(fresh.sum()))
            yield self.frame(key, (since + hold)[fires], ["firing"] * int(fires.sum()))
            yield self.frame(key, end[over], np.where((fired | fires)[over], "resolved", "inactive"))
            if not over[-1]:
                self.settle(since[-1], last[-1], bool(fired[-1] or fires[-1]))

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if not self.open.exists():
                return
            since, last, fired = self.open.get()
            due, end = expiredTimerInfo.getExpiryTimeInMs() // 1000, last + stale
            now = timerValues.getCurrentWatermarkInMs() // 1000
            if due < end and not fired:
                yield self.frame(key, [since + hold], ["firing"])
                fired = True
            if end <= now:  # a timer that is set now for a time gone by would have to wait for another batch
                self.open.clear()
                yield self.frame(key, [end], ["resolved" if fired else "inactive"])
            else:
                self.settle(since, last, fired)

        def close(self) -> None:
            pass

    return Life()


def alert_life(samples: DataFrame, hold: int, stale: int, labels: list[str]) -> DataFrame:
    """labels, at (seconds) and state for every change: pending at the first bad sample, firing once that has lasted for ``hold`` seconds, and resolved (inactive, if it never fired) at the first good sample or ``stale`` seconds after the last bad one. samples: labels, id, ts, bad.

    What happens between samples is told by timers of event time, as soon as
    any series has gone beyond it.
    """
    rows = samples.filter(F.col("ts").isNotNull()).select(*labels, "id", "ts", F.unix_seconds("ts").alias("at"), F.coalesce("bad", F.lit(False)).alias("bad"))
    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in labels)
    return rows.withWatermark("ts", "0 seconds").groupBy(*labels).transformWithStateInPandas(life_machine(hold, stale, labels), f"{kinds}, at long, state string", "append", "eventtime")
