"""Bucketed snapshots against plain Python, the files a change writes, and plans without an exchange of what is stored."""

import random
import uuid

from dirwise.sources.buckets import BucketedSnapshot

SCHEMA = "id string, turn int, name string, la string"


def made(spark, tmp_path, buckets=8):
    return BucketedSnapshot(spark, f"b{uuid.uuid4().hex}", str(tmp_path / "t"), ["id"], ["turn"], buckets)


def files(spark, snap):
    return set(spark.table(snap.name).inputFiles())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_snapshot_of_batches(spark, tmp_path):
    r = random.Random(1)
    snap, want = made(spark, tmp_path), {}
    for batch in range(4):
        rows = [(f"e{r.randint(0, 200)}" if r.random() < 0.7 else "hot", r.randint(0, 50), f"n{i}", "Kent") for i in range(150)] + [(None, 1, "x", "y")]
        snap.take(spark.createDataFrame(rows, SCHEMA))
        for row in rows:
            if row[0] is not None and (row[0] not in want or row[1:] > want[row[0]][1:]):
                want[row[0]] = row
    got = lambda s: sorted(map(tuple, s.snapshot().collect()))
    assert got(snap) == sorted(want.values())
    snap.take(spark.createDataFrame(rows, SCHEMA))  # a batch that runs again
    assert got(snap) == sorted(want.values())
    folded = snap.compact(str(tmp_path / "c"))
    assert got(folded) == sorted(want.values()) and folded.table().count() == len(want)
    snap.drop(), folded.drop()


def test_a_change_writes_only_the_buckets_it_meets_and_moves_nothing_stored(spark, tmp_path):
    snap = made(spark, tmp_path)
    snap.take(spark.range(4000).selectExpr("concat('e', id) AS id", "0 AS turn", "'old' AS name", "'Kent' AS la"))
    before = files(spark, snap)
    assert len(before) == 8
    snap.take(spark.createDataFrame([("e7", 1, "new"), ("e9", 1, "new"), ("fresh", 1, "new")], "id string, turn int, name string"))
    assert before < files(spark, snap) and len(files(spark, snap) - before) <= 3
    assert exchanges(snap.snapshot()) == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = snap.snapshot().join(spark.range(50).selectExpr("concat('e', id) AS id", "id AS n"), "id")
        assert keyed.count() == 50 and exchanges(keyed) == 1  # of the small side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(x["id"], x["name"], x["la"]) for x in snap.snapshot().filter("turn = 1").collect()} == {("e7", "new", None), ("e9", "new", None), ("fresh", "new", None)}
    snap.drop()
