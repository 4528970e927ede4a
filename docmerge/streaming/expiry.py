"""Sessions that end a fixed time after they began, in event time.

The state of a session is the time it began; a timer at the end of its life emits a row that says so, and its later rows are dropped.
Rows without ``created_at`` pass, as unknown ages are kept in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docmerge.streaming.retries import with_state_store


class _Session(StatefulProcessor):
    """One session. State is read once and timers are only looked for where one can be: each such call is a round trip."""

    def __init__(self, ttl_ms: int, names: list[str]):
        self.ttl_ms, self.names = ttl_ms, names
        self.row = Row(*names, "began_ms", "expired")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "began bigint, gone boolean")

    def _notice(self, key, began: int) -> Row:
        row = dict.fromkeys(self.names) | {"session_id": key[1] if key[0] else None}
        return self.row(*row.values(), began, True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        began, gone = self.life.get() or (None, False)
        given = min((r["began_ms"] for r in rows if r["began_ms"] is not None), default=None)
        if given is not None and (began is None or given < began):
            if began is not None and not gone:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
            began = given
            self.life.update((began, gone))
            if not gone:
                self.handle.registerTimer(began + self.ttl_ms + 1)  # a session that is exactly that old still lives
        if began is not None and (gone or began + self.ttl_ms < timerValues.getCurrentWatermarkInMs()):
            return
        for row in rows:
            yield self.row(*[row[n] for n in self.names], row["began_ms"], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        began, gone = self.life.get()
        if not gone:
            self.life.update((began, True))
            yield self._notice(key, began)

    def close(self) -> None:
        pass


def stream_expiry(rows: DataFrame, ttl_seconds: int, time: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Rows of living sessions, and one row with ``expired`` for each session that ends; ``time`` drives the clock.

    Start it with ``with_state_store``.
    """
    keyed = rows.withWatermark(time, delay).select(
        "*", F.unix_millis("created_at").alias("began_ms"), F.col("session_id").isNotNull().alias("in_session"), F.coalesce(F.col("session_id").cast("string"), F.lit("")).alias("in_text")
    )
    schema = StructType([*rows.schema.fields, StructField("began_ms", LongType()), StructField("expired", BooleanType())])
    found = keyed.groupBy("in_session", "in_text").transformWithState(_Session(ttl_seconds * 1000, rows.columns), schema, "Append", "EventTime")
    return found.withColumn("created_at", F.coalesce("created_at", F.timestamp_millis("began_ms"))).drop("began_ms")
