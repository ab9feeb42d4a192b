"""Reputation answers that expire: keyed state with timers.

Per (domain, provider) the state is the time until which the last answer holds. An answer that comes before is a renewal, one that
comes later a new entry; a timer of event time ends what nobody has renewed, when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMELINE = "domain string, provider string, kind string, at long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiry(StatefulProcessor):
    """Rows of kind stored, renewed or expired, with their time in milliseconds.

    Keys are many and have few answers each, so the cost is that of a key: plain rows, and every state read once.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.until.get()
        until = held[0] if held is not None else None
        before, out = until, []
        for at in sorted(row["at"] for row in rows):
            fresh = until is None or at >= until
            if fresh and until is not None:
                out.append(("expired", until))
            out.append(("stored" if fresh else "renewed", at))
            until = max(until or 0, at + self.ttl)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.until.update((until,))
            self.handle.registerTimer(until)
        return self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return self._rows(key, [("expired", expiredTimerInfo.getExpiryTimeInMs())])

    def close(self) -> None:
        pass

    def _rows(self, key, out: list[tuple[str, int]]) -> Iterator[Row]:
        return iter([Row(domain=key[0], provider=key[1], kind=kind, at=at) for kind, at in out])


def timeline(answers: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """What becomes of the answers of a stream (domain, provider, queried_at)."""
    marked = answers.withWatermark("queried_at", delay).select("domain", "provider", "queried_at", F.unix_millis("queried_at").alias("at"))
    return marked.groupBy("domain", "provider").transformWithState(
        statefulProcessor=Expiry(1000 * ttl_seconds), outputStructType=TIMELINE, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
