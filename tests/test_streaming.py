"""Streams give what their batch operators give, also out of order and in pieces."""
import datetime as dt
import random

from pyspark.sql import functions as F

from dirwise.operators.changes import current_votes
from dirwise.streaming import feeds

VOTES = "userId bigint, schoolId string, fieldName string, vote int, votedAt timestamp_ntz, event_id bigint"


def write_pieces(spark, rows, schema, folder, pieces=4):
    n = max(1, len(rows) // pieces)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i:i + n], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_vote_feed_equals_batch(spark, tmp_path):
    r = random.Random(3)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(r.randint(0, 4), f"s{r.randint(0, 3)}", r.choice("fg"), r.choice([-2, -1, 0, 1, 3]), t0 + dt.timedelta(minutes=r.randint(0, 50)), i) for i in range(200)]
    r.shuffle(rows)
    write_pieces(spark, rows, VOTES, tmp_path / "in")
    feed = feeds.vote_feed(str(tmp_path / "out"))
    stream = spark.readStream.schema(VOTES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed.start(stream, str(tmp_path / "cp")).awaitTermination()
    batch = current_votes(spark.createDataFrame(rows, VOTES), ["votedAt", "event_id"])
    keys = lambda df: sorted((x["userId"], x["schoolId"], x["fieldName"], x["event_id"]) for x in df.collect())
    assert keys(feed.snapshot(spark).filter("vote <> 0")) == keys(batch)
    feed.compact(spark, 1)
    assert keys(feed.snapshot(spark).filter("vote <> 0")) == keys(batch)
    reviews = spark.createDataFrame([("s0", "f")], "schoolId string, fieldName string")
    conf = feeds.confidence_now(feed.snapshot(spark), reviews).filter("isAdminVerified").collect()
    assert len(conf) == 1 and conf[0]["score"] == 100


def run_due(spark, tmp_path, rows, late):
    schema = "id string, seen_at timestamp"
    write_pieces(spark, rows, schema, tmp_path / "in")
    # a last event long after all others lets the watermark pass them
    write_pieces(spark, [("end", dt.datetime(2028, 1, 1))], schema, tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = feeds.due_feed(stream, late=late).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((x["id"], x["seen_at"]) for x in spark.table("due").filter("id <> 'end'").collect())


def test_due_feed_equals_batch_in_any_order(spark, tmp_path):
    r = random.Random(4)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(f"e{r.randint(0, 3)}", t0 + dt.timedelta(seconds=r.randint(0, 86400 * 60), microseconds=r.randint(0, 999_999))) for _ in range(150)]
    rows += rows[:40]
    batch = sorted((x["id"], x["seen_at"]) for x in feeds.due_batch(spark.createDataFrame(rows, "id string, seen_at timestamp")).collect())
    assert run_due(spark, tmp_path, rows, "90 days") == batch


def test_events_later_than_allowed_are_dropped(spark, tmp_path):
    d = lambda m, n: dt.datetime(2026, m, n)
    # one file each: the watermark has passed the last event long before it comes
    assert run_due(spark, tmp_path, [("a", d(5, 1)), ("b", d(6, 1)), ("a", d(6, 2)), ("a", d(1, 1))], "1 day") == [("a", d(5, 1)), ("a", d(6, 2)), ("b", d(6, 1))]


def test_due_batch(spark):
    d = lambda n: dt.datetime(2026, 1, n)
    df = spark.createDataFrame([("a", d(1)), ("a", d(5)), ("a", d(11)), ("a", d(20)), ("a", d(21))], "id string, seen_at timestamp")
    assert [x["seen_at"].day for x in feeds.due_batch(df).orderBy("seen_at").collect()] == [1, 11, 21]
    assert feeds.due_batch(df.filter(F.lit(False))).count() == 0


class Counted:
    """State in memory that counts what is asked of it."""

    def __init__(self):
        self.map, self.value, self.calls, self.timers = {}, None, 0, []

    def getMapState(self, *names):
        return self

    def getValueState(self, *names):
        own = Counted()
        own.exists, own.get = (lambda: own.value is not None), (lambda: own.value)
        own.update, own.clear = (lambda v: setattr(own, "value", v)), (lambda: setattr(own, "value", None))
        return own

    def containsKey(self, k):
        self.calls += 1
        return k in self.map

    def getValue(self, k):
        self.calls += 1
        return self.map[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.map[k] = v

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


def test_state_calls_of_the_due_feed_go_by_windows_not_events():
    import pandas as pd

    state, due = Counted(), feeds._Due(10)
    due.init(state)
    times = pd.Series(pd.date_range("2026-01-01", "2026-01-30", periods=3000))
    list(due.handleInputRows(("a",), iter([pd.DataFrame({"seen_at": times})]), None))
    assert state.calls < 40
