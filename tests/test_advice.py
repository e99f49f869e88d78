"""Advice without a limit: every user meets every entity that is not left out, and the pairs are not exchanged."""
from pyspark.sql import functions as F

from dirwise.operators import scoring


def test_left_out_entities_travel_with_the_user(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_ENTITIES", 10)
    df = spark.range(60).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"))
    for c, v in dict(gender="Mixed", schoolType="Academy", entranceExamType="", la="", postcode="", address="", ofstedRating="", exam_consortium="").items():
        df = df.withColumn(c, F.lit(v))
    for c in ("national_rank_england", "gcse_rank_england", "a_level_rank_england", "gcseAttainment8", "gcseProgress8", "easting", "northing", "primary_exam_type_id", "exam_consortium_id"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    keeps = spark.createDataFrame([(1, "e3"), (2, "e4"), (1, "e3")], "user_id int, id string")
    drops = spark.createDataFrame([(1, "e5"), (2, "e5"), (9, "e6"), (1, None)], "user_id int, id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scoring.recommend_many(df, users, keeps, drops, limit=None)
        got = [(x["user_id"], x["id"]) for x in out.collect()]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left_out = {(1, "e3"), (1, "e5"), (2, "e4"), (2, "e5")}
    assert sorted(got) == sorted({(u, f"e{i}") for u in (1, 2, 3) for i in range(60)} - left_out)
    assert "LeftAnti" not in plan
