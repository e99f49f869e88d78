"""Exports read back, and feeds run to their end over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dirwise.plans.fixtures import entities, view
from dirwise.plans.q_directory import D_CURRENT_VOTES, SCHOOL, schools
from dirwise.plans.registry import query
from dirwise.session import shared_dir
from dirwise import schemas
from dirwise.sources import readers, writers
from dirwise.sources.buckets import BucketedSnapshot
from dirwise.streaming import feeds


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_stream(df, spark, name: str, files: int = 6):
    """The rows of a table as a stream of files."""
    path = _folder(spark, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("str01_vote_feed", f"""SELECT userId AS "userId", schoolId AS "schoolId", fieldName AS "fieldName", CASE WHEN vote > 0 THEN 1 ELSE -1 END AS vote FROM {D_CURRENT_VOTES}""", uses=("votes",))
def vote_feed(spark, sf):
    feed = feeds.vote_feed(_folder(spark, "votes"))
    q = feed.start(_as_stream(view(spark, sf, "votes"), spark, "votes-in"), _folder(spark, "cp"))
    q.awaitTermination()
    snap = feed.snapshot(spark).filter("vote <> 0")
    return snap.select("userId", "schoolId", "fieldName", F.when(F.col("vote") > 0, 1).otherwise(-1).alias("vote"))


@query("str01_bucketed_votes", f"""SELECT userId AS "userId", schoolId AS "schoolId", fieldName AS "fieldName", CASE WHEN vote > 0 THEN 1 ELSE -1 END AS vote FROM {D_CURRENT_VOTES}""", uses=("votes",))
def bucketed_votes(spark, sf):
    """The vote stream into a bucketed table: each batch adds to the buckets it meets."""
    name = f"votes_{uuid.uuid4().hex}"
    snap = BucketedSnapshot(spark, name, _folder(spark, "votes-table"), feeds.VOTE_KEYS, ["votedAt", "event_id"], buckets=8)
    stream = _as_stream(view(spark, sf, "votes"), spark, "votes-in")
    q = stream.writeStream.foreachBatch(lambda rows, batch: snap.take(rows)).option("checkpointLocation", _folder(spark, "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return snap.snapshot().filter("vote <> 0").select("userId", "schoolId", "fieldName", F.when(F.col("vote") > 0, 1).otherwise(-1).alias("vote"))


@query("str03_change_feed", """SELECT schoolId AS "schoolId", max(id) AS id, arg_max(newState, id) AS "newState" FROM audit GROUP BY 1""", uses=("audit",))
def change_feed(spark, sf):
    feed = feeds.change_feed(_folder(spark, "changes"))
    q = feed.start(_as_stream(view(spark, sf, "audit"), spark, "changes-in"), _folder(spark, "cp"))
    q.awaitTermination()
    feed.compact(spark, 0)
    return feed.snapshot(spark).select("schoolId", "id", "newState")


DUE = """
WITH RECURSIVE e AS (SELECT DISTINCT concat('u', cast(user_id AS STRING)) AS id, ts AS t FROM events),
r(id, t) AS (SELECT id, min(t) FROM e GROUP BY 1 UNION ALL SELECT r.id, (SELECT min(e.t) FROM e WHERE e.id = r.id AND e.t >= r.t + INTERVAL 10 DAY) FROM r WHERE r.t IS NOT NULL)
SELECT id, epoch_us(t) AS seen_us FROM r WHERE t IS NOT NULL"""


def _seen(spark, sf):
    from dirwise.plans.fixtures import table

    return table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("seen_at"))


@query("str02_due_events", DUE)
def due_events(spark, sf):
    """The stream itself, over files in no order of time, each event twice; all come within one batch."""
    path, out = _folder(spark, "seen-in"), _folder(spark, "seen-out")
    e = _seen(spark, sf)
    e.unionAll(e).repartition(6).write.parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    q = feeds.due_feed(stream, late="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("id string, seen_at timestamp").parquet(out).select("id", F.unix_micros("seen_at").alias("seen_us"))


@query("str02_due_batch", DUE)
def due_batch(spark, sf):
    return feeds.due_batch(_seen(spark, sf)).select("id", F.unix_micros("seen_at").alias("seen_us"))


@query("snk02_csv_export", """SELECT id AS "ID", urn AS "URN", name AS "School Name", address AS "Address", d_examDate AS "Exam Date" FROM school""", uses=SCHOOL)
def csv_export(spark, sf):
    path = _folder(spark, "csv")
    writers.write_csv(schools(spark, sf), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    return back.select("ID", *[F.coalesce(c, F.lit("")).alias(c) for c in ("URN", "School Name", "Address", "Exam Date")])


@query("snk03_tsv_export", """SELECT id AS "ID", name AS "School Name", website AS "Website" FROM school""", uses=SCHOOL)
def tsv_export(spark, sf):
    path = _folder(spark, "tsv")
    writers.write_tsv(schools(spark, sf), path)
    back = spark.read.csv(path, header=True, sep="\t", quote="")
    return back.select("ID", "School Name", F.coalesce("Website", F.lit("")).alias("Website"))


@query("snk04_xml_export", """SELECT id, la AS "localAuthority", d_examDate AS exam, website FROM school""", uses=SCHOOL)
def xml_export(spark, sf):
    path = _folder(spark, "xml")
    writers.write_xml(schools(spark, sf), path)
    schema = "id string, localAuthority string, website string, entranceExamDates struct<examDate:string>"
    back = spark.read.format("xml").option("rowTag", "school").schema(schema).load(path)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return back.select("id", text("localAuthority").alias("localAuthority"), text("entranceExamDates.examDate").alias("exam"), text("website").alias("website"))


@query("snk01_json_export", "SELECT id, name, d_examDate AS exam FROM entity", uses=("entity",))
def json_export(spark, sf):
    path = _folder(spark, "json")
    e = entities(spark, sf).select("id", "name", "entranceExamDates")
    writers.write_json(e, path)
    return spark.read.schema(e.schema).json(path).select("id", "name", F.col("entranceExamDates")["examDate"].alias("exam"))


@query("snk06_domain_copies", """SELECT 'votes' AS name, count(*) AS n FROM votes UNION ALL SELECT 'entity', count(*) FROM entity""", uses=("votes", "entity"))
def domain_copies(spark, sf):
    root = _folder(spark, "domains")
    writers.write_domains({"votes": ("parent", view(spark, sf, "votes")), "entity": ("main", view(spark, sf, "entity"))}, root)
    count = lambda d, t: spark.read.parquet(f"{root}/{d}/{t}").agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return count("parent", "votes").unionByName(count("main", "entity"))


@query("snk07_saved_scan", """SELECT dimension, n FROM (SELECT 'tagged' AS dimension, count(*) AS n FROM school WHERE len(tags) > 0)""", uses=SCHOOL)
def saved_scan(spark, sf):
    root = _folder(spark, "scans")
    s = schools(spark, sf)
    writers.save_scan(s.filter(F.size("verification_tags") > 0).select("id"), root, "tag_audit", "2026-09-15", 0)
    return writers.read_scan(spark, root, "tag_audit").agg(F.lit("tagged").alias("dimension"), F.count("*").alias("n"))


# ---- files read back ---------------------------------------------------------------------------


@query("src03_coordinates_file", """SELECT postcode, outcode, cast(easting AS BIGINT) AS easting, cast(northing AS BIGINT) AS northing, coalesce(nullif(admin_district, ''), 'England') AS admin_district FROM coords WHERE easting <> 0 AND northing <> 0""", uses=("coords",))
def coordinates_file(spark, sf):
    path = _folder(spark, "coordinates")
    c = view(spark, sf, "coords")
    c.select(F.lower("postcode").alias("Postcode"), F.col("easting").alias("Easting"), F.col("northing").alias("Northing"), F.col("admin_district").alias("LA (name)")).write.csv(path, header=True)
    return readers.coordinates_csv(spark, path).select("postcode", "outcode", F.col("easting").cast("bigint"), F.col("northing").cast("bigint"), "admin_district")


@query("src04_register_file", """SELECT URN AS urn, SCHNAME AS name, LANAME AS la, POSTCODE AS postcode, GENDER AS gender, CASE WHEN AGELOW <> '' THEN AGELOW || '-' || AGEHIGH ELSE '' END AS "ageRange", ADMPOL AS "admissionsPolicy", lower(SCHSTATUS) <> 'closed' AS active FROM register""", uses=("register",))
def register_file(spark, sf):
    path = _folder(spark, "register")
    r = view(spark, sf, "register")
    at = {i: n for n, i in schemas.REGISTER_POSITIONS.items()}
    cells = [(F.coalesce(F.col(at[i]).cast("string"), F.lit("")) if at.get(i) in r.columns else F.lit("a, b" if i == 0 and 0 not in at else "")).alias(f"c{i}") for i in range(max(at) + 1)]
    r.select(*cells).write.option("quoteAll", True).option("emptyValue", "").csv(path, header=True)
    return readers.register_records(readers.register_by_position(spark, path)).select("urn", "name", "la", "postcode", "gender", "ageRange", "admissionsPolicy", "active")


@query("src05_rule_file", """SELECT c_name AS id, c_mktsegment AS word, true AS placed FROM customer""")
def rule_file(spark, sf):
    """Rule files of one rule per customer, written and read in many tasks; every rule has a place of its own in its file."""
    from dirwise.plans.fixtures import table

    path = _folder(spark, "rules")
    rules = table(spark, sf, "customer").select(F.col("c_name").alias("id"), F.concat(F.lit('say "}{" \\\\ '), "c_name").alias("name"), F.array("c_mktsegment").alias("schoolKeywords"))
    writers.write_json_document(rules.repartition(5), path, part="state_consortia")
    back = readers.rule_table(spark, path)
    held = back.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.max("ordinal").alias("m"))
    placed = (F.col("n") == F.col("d")) & (F.col("m") == F.col("n") - 1) & (F.col("name") == F.concat(F.lit('say "}{" \\\\ '), "id"))
    return back.join(held, "file").select("id", F.col("schoolKeywords")[0].alias("word"), placed.alias("placed"))


@query("src06_district_map", """SELECT postcode AS outcode, min(easting) AS easting, min(northing) AS northing, count(*) AS n FROM coords GROUP BY 1""", uses=("coords",))
def district_map(spark, sf):
    """One entry per postcode, written and read in many tasks."""
    path = _folder(spark, "districts")
    d = view(spark, sf, "coords").groupBy("postcode").agg(F.min("easting").alias("easting"), F.min("northing").alias("northing"), F.count("*").cast("string").alias("district"))
    writers.write_json_document(d, path, key="postcode")
    back = readers.outcode_map(spark, path)
    return back.select("outcode", F.col("easting").cast("bigint").alias("easting"), F.col("northing").cast("bigint").alias("northing"), F.col("district").cast("bigint").alias("n"))


@query("snk05_lookup_file", """SELECT id, coalesce(urn, '-') AS urn, coalesce(name, '-') AS name FROM entity""", uses=("entity",))
def lookup_file(spark, sf):
    path = _folder(spark, "lookup")
    writers.write_lookup(view(spark, sf, "entity").select("id", "urn", "name"), path)
    back = spark.read.schema("id string, urn string, name string").json(path)
    return back.select("id", F.coalesce("urn", F.lit("-")).alias("urn"), F.coalesce("name", F.lit("-")).alias("name"))
