"""A circuit breaker over a stream of requests: keyed state with a map, values and timers.

For each host, in order of time:

* while a cooldown runs, requests are refused and tell nothing;
* a request that was answered "too many" starts a cooldown of the delay that it names, or
  keeps a longer one;
* a failure is remembered by its address; the fifth distinct one starts a cooldown of an
  hour and is the last that is remembered;
* a success, or a day without a request, forgets the failures.

The state of a host is at most four addresses, two moments and two timers: one that ends the
cooldown, one that ends the state when the host has been silent for :data:`SILENCE`.  Rows
of a batch are put in order; a row that comes in a later batch than it should is judged when
it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.shipping import ship_package

#: Distinct failures that open the breaker; seconds of its cooldown, and of silence after
#: which a host is forgotten.
FAILURES, COOLDOWN, SILENCE = 5, 3600, 86400
#: The state store that keeps maps and timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Breaker(StatefulProcessor):
    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getMapState("failed", "url string", "at long")
        self.moments = handle.getValueState("moments", "until long, last long")

    def _timers(self, old: tuple[int, int], new: tuple[int, int]) -> None:
        """At the end of the cooldown, and of the silence after the last request."""
        for was, now in ((old[0], new[0]), (old[1] + SILENCE if old[1] else 0, new[1] + SILENCE)):
            if was != now:
                if was:
                    self.handle.deleteTimer(was * 1000)
                if now:
                    self.handle.registerTimer(now * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.moments.get()) if self.moments.exists() else (0, 0)
        until, last = old
        failed = {k[0]: v[0] for k, v in self.failed.iterator()}
        ordered = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        judged = []
        for at, kind, url, delay in zip(ordered["at"].tolist(), ordered["kind"], ordered["url"], ordered["delay"].tolist(), strict=True):
            if last and at - last > SILENCE:
                failed = {}
            last = max(last, at)
            judged.append(until <= at)
            if until > at:
                continue
            if kind == "LIMITED":
                until = max(until, at + int(delay))
            elif kind == "FAILED":
                failed[url] = at
                if len(failed) >= FAILURES:
                    until, failed = at + COOLDOWN, {}
            elif kind == "OK":
                failed = {}
        self.failed.clear()
        for url, at in failed.items():
            self.failed.updateValue((url,), (at,))
        self._timers(old, (until, last))
        self.moments.update((until, last))
        yield pd.DataFrame({self.key: key[0], "id": ordered["id"].to_numpy(), "admitted": judged})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.moments.exists():
            until, last = self.moments.get()
            now = expiredTimerInfo.getExpiryTimeInMs() // 1000
            if now >= last + SILENCE and now >= until:
                self.failed.clear()
                self.moments.clear()
        return iter([])


def guarded(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Requests (``key``, id, url, ``moment``, kind: OK, FAILED or LIMITED; ``delay`` in
    seconds) -> key, id, ``admitted``: whether the breaker let the request through.

    The session needs the settings in :data:`STORE`."""
    ship_package(stream.sparkSession)
    rows = stream.withWatermark("moment", late).select(key, "id", "url", "moment", F.unix_seconds(F.col("moment")).alias("at"), "kind", F.coalesce("delay", F.lit(0)).cast("long").alias("delay"))
    schema = T.StructType([rows.schema[key], rows.schema["id"], T.StructField("admitted", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(_Breaker(key), schema, "append", "eventTime")
