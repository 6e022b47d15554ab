"""The reading cursor as streaming state: for each day the managers that filed and those still to be read.

Events (day, cik, kind, seen) come from a folder: a listing names a day's managers, a manager is done once a publish that holds them
counts, a dropped one is to be read again. Each day is a key of its own with a map of its managers; a timer by event time (`seen`) ends a day
that has left the window, so state doesn't grow with history. Checkpoint and state go together: what a run has read
is read once, and a run that breaks off is taken up where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "day date, cik string, kind string, seen timestamp"
STATES = "day date, known long, pending long, state string"
MANAGERS = "day date, cik string, pending boolean"
KINDS = ("listed", "dropped", "done")  # of events seen at once the last of these counts
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _closes(day: date) -> int:
    """The end of a day, in ms. The watermark is behind what was seen last by the length of the window: a day whose end it has passed has left the window."""
    return int((datetime(day.year, day.month, day.day, tzinfo=timezone.utc) + timedelta(days=1)).timestamp() * 1000)


class Day(StatefulProcessor):
    """One row for each day and batch that has events of it: how many managers are known and pending, and whether the day is open, read, late (past the window) or expired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.managers = handle.getMapState("managers", "cik string", "pending boolean")

    def _told(self, day: date, state: str | None = None) -> Row:
        pending = [v[0] for _, v in self.managers.iterator()]
        return Row(day=day, known=len(pending), pending=sum(pending), state=state or ("open" if any(pending) else "read"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        [day] = key
        if timerValues.getCurrentWatermarkInMs() >= _closes(day):
            yield self._told(day, "late")
            return
        for e in sorted(rows, key=lambda e: (e.seen, KINDS.index(e.kind))):  # of one day in one batch
            known = self.managers.containsKey((e.cik,))
            if e.kind == "listed" and not known:
                self.managers.updateValue((e.cik,), (True,))
            elif known and e.kind != "listed":
                self.managers.updateValue((e.cik,), (e.kind == "dropped",))
        self.handle.registerTimer(_closes(day))
        yield self._told(day)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        told = self._told(key[0], "expired")
        self.managers.clear()
        yield told

    def close(self) -> None:
        pass


def tracked(events: DataFrame, window: int = 120) -> DataFrame:
    """day, known, pending, state of a stream of events; see Day. Events of other kinds, and those without a day or manager, are left out, as are events seen longer ago than the window is long."""
    events = events.where(F.col("kind").isin(*KINDS) & F.col("day").isNotNull() & F.col("cik").isNotNull())
    keyed = events.withWatermark("seen", f"{window} days").groupBy("day")
    return keyed.transformWithState(statefulProcessor=Day(), outputStructType=STATES, outputMode="Append", timeMode="EventTime")


def start(spark: SparkSession, landing: str, target: str, checkpoint: str, window: int = 120, days_per_batch: int = 80) -> StreamingQuery:
    """Takes in what is new in the landing folder, at most `days_per_batch` files (a day's listing each) in a batch, appends to `target` and stops."""
    spark.conf.set(STORE, ROCKS)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", days_per_batch).json(landing)
    out = tracked(events, window).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """day, cik and pending of all days in the window, read from the state of the last batch."""
    held = spark.read.format("statestore").option("stateVarName", "managers").load(checkpoint)
    return held.select(F.col("key.day").alias("day"), F.col("user_map_key.cik").alias("cik"), F.col("user_map_value.pending").alias("pending"))


def done_after(publish: Callable[[], object], done: DataFrame, landing: str, seen: datetime) -> None:
    """Publishes, and only then tells the cursor (by a file in its landing folder) that managers (day, cik) are done: a publish that fails leaves them pending."""
    publish()
    done.select("day", "cik", F.lit("done").alias("kind"), F.lit(seen).alias("seen")).coalesce(1).write.mode("append").json(landing)  # some thousand rows
