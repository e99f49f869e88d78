"""Vote, freshness and change feeds as Structured Streaming jobs.

The snapshot feeds give what their batch operators give over the same events,
in whatever order and batches they come; the freshness feed does so for events
that come within its lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from dirwise.operators.aggregates import field_confidence
from dirwise.operators.ranking import latest


class SnapshotFeed:
    """Keeps the newest row per key of a stream.

    Every micro-batch is reduced to its newest rows and written under its own
    number, so a batch that runs again replaces itself and costs no more than
    its own rows. The snapshot is the newest row per key over all batches, so
    an older event that comes late loses. ``compact`` folds finished batches
    into one base from time to time.
    """

    def __init__(self, root: str, keys: list[str], order: list[str]):
        self.root, self.keys, self.order = root.rstrip("/"), keys, order

    def take(self, rows: DataFrame, batch: int) -> None:
        latest(rows, self.keys, self.order).write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _read(self, spark: SparkSession, part: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.root}/{part}")
        except AnalysisException:
            return None

    def _base(self, spark: SparkSession) -> tuple[int, DataFrame | None]:
        """Number of the last batch whose compaction was finished and its base, if there is one."""
        done = self._read(spark, "done")
        if done is None:
            return -1, None
        upto = done.agg(F.max("upto")).first()[0]
        return upto, spark.read.parquet(f"{self.root}/bases/upto={upto}")

    def _rows(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        folded, base = self._base(spark)
        new = self._read(spark, "batches")
        if new is not None:
            new = new.filter(F.col("batch") > folded)
            new = (new if upto is None else new.filter(F.col("batch") <= upto)).drop("batch")
        parts = [x for x in (base, new) if x is not None]
        return latest(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), self.keys, self.order)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Fold all batches up to ``upto`` into a new base.

        A base counts once its mark is written, so a run that was cut off
        changes nothing; what the base has replaced is deleted after that.
        """
        before, _ = self._base(spark)
        self._rows(spark, upto).write.mode("overwrite").parquet(f"{self.root}/bases/upto={upto}")
        spark.range(1).select(F.lit(upto).alias("upto")).write.mode("append").parquet(f"{self.root}/done")
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for old in [f"bases/upto={before}"] * (0 <= before != upto) + [f"batches/batch={i}" for i in range(before + 1, upto + 1)]:
            files.delete(path(f"{self.root}/{old}"), True)


VOTE_KEYS = ["userId", "schoolId", "fieldName"]


def vote_feed(root: str) -> SnapshotFeed:
    return SnapshotFeed(root, VOTE_KEYS, ["votedAt", "event_id"])


def confidence_now(snapshot: DataFrame, reviews: DataFrame) -> DataFrame:
    """Field confidence from the snapshot of a vote feed; withdrawn votes do not count."""
    return field_confidence(snapshot.filter("vote <> 0"), reviews)


def change_feed(root: str) -> SnapshotFeed:
    """Latest logged state per entity, by log id."""
    return SnapshotFeed(root, ["schoolId"], ["id"])


def _let_through(times, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """The times, in order, that lie at least ``gap`` after the last one let through."""
    out = []
    for t in times:
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out, last


class _Due(StatefulProcessor):
    """Lets an entity's events through in order of time, once the watermark has passed them.

    Waiting events lie in a map by window of ``days``, the times of a window together,
    with one timer at the first of them: a batch touches only the windows that it brings
    events of or the watermark has reached, whatever the number of their events. The
    time last let through goes with a timer at the end of its window.
    """

    def __init__(self, days: int):
        self.gap = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint", "us binary")
        self.last = handle.getValueState("last", "us bigint")

    def _times(self, slot: int) -> np.ndarray:
        """The waiting times of a window, in order."""
        return np.frombuffer(bytes(self.waiting.getValue((slot,))[0]), "<i8") if self.waiting.containsKey((slot,)) else np.empty(0, "<i8")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = np.unique(np.concatenate([b["seen_at"].astype("datetime64[us]").astype("int64").to_numpy() for b in rows]))
        slots = new // self.gap
        for slot in np.unique(slots).tolist():
            had = self._times(slot)
            times = np.union1d(had, new[slots == slot])
            if not had.size or times[0] // 1000 < had[0] // 1000:
                self.handle.registerTimer(int(times[0]) // 1000)
            self.waiting.updateValue((slot,), (times.tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        slot = ms * 1000 // self.gap
        times = self._times(slot)
        if times.size and times[0] // 1000 <= ms:
            ready = times // 1000 <= max(ms, timerValues.getCurrentWatermarkInMs())
            out, now = _let_through(times[ready].tolist(), last, self.gap)
            if ready.all():
                self.waiting.removeKey((slot,))
            else:
                self.waiting.updateValue((slot,), (times[~ready].tobytes(),))
                self.handle.registerTimer(int(times[~ready][0]) // 1000)
            if now != last:
                self.last.update((now,))
                self.handle.registerTimer((now + self.gap) // 1000 + 1)
                last = now
            if out:
                yield pd.DataFrame({"id": [key[0]] * len(out), "seen_at": pd.Series(out, dtype="int64").astype("datetime64[us]")})
        if last is not None and (last + self.gap) // 1000 < ms:
            self.last.clear()  # the window is over: the next event is let through whatever came before

    def close(self) -> None:
        pass


def due_feed(events: DataFrame, days: int = 10, late: str = "1 day") -> DataFrame:
    """Events (id, seen_at) of entities that were not let through within the last ``days``.

    Events wait in the state until the watermark has passed them and are then
    taken in order of time, so any order of arrival within ``late`` gives what
    ``due_batch`` gives; events that come later are dropped. State lies in RocksDB,
    which this session's streams use from here on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = events.select("id", "seen_at").withWatermark("seen_at", late).groupBy("id")
    return grouped.transformWithStateInPandas(_Due(days), "id string, seen_at timestamp", "Append", "eventtime")


def due_batch(events: DataFrame, days: int = 10) -> DataFrame:
    """What due_feed gives over a bounded table.

    Each task reads its events sorted by entity and time and remembers one
    time, however many events an entity has.
    """
    gap = days * 86_400_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, last = None, None
        for b in batches:
            ids, times = b["id"].tolist(), b["us"].tolist()
            keep = []
            for i, t in zip(ids, times, strict=True):
                if i != entity:
                    entity, last = i, None
                passed, last = _let_through([t], last, gap)
                keep.append(bool(passed))
            yield b[keep]

    # of equal times one is enough, and the sort below finds them together
    rows = events.filter("id is not null and seen_at is not null").select("id", F.unix_micros("seen_at").alias("us")).distinct()
    ordered = rows.repartition("id").sortWithinPartitions("id", "us")
    return ordered.mapInPandas(run, "id string, us bigint").select("id", F.timestamp_micros("us").alias("seen_at"))
