"""Upserts, votes, change logs, rollback, merging and review ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dirwise.operators import changes, merge
from dirwise.operators import ranking
from dirwise.plans.fixtures import CTES, entities, table, view
from dirwise.plans.q_directory import D_CURRENT_VOTES, SCHOOL, schools
from dirwise.plans.registry import query
from dirwise.session import shared_dir
from dirwise.sources.buckets import BucketedSnapshot



def now():
    return F.lit("2026-09-15 00:00:00").cast("timestamp_ntz")

# Every delta key comes twice; what counts is the row with the larger turn (for insertions: the smaller).
_DELTA = "SELECT id, 'new ' || k AS name, 'p' || k AS phone FROM entity WHERE k % 5 = 2 UNION ALL SELECT 'n' || k, 'added ' || k, NULL FROM entity WHERE k % 50 = 9"


def _base_delta(spark, sf):
    e = view(spark, sf, "entity").select("id", "k", "name", "phone", "la")
    upd = e.filter("k % 5 = 2").select("id", F.concat(F.lit("new "), "k").alias("name"), F.concat(F.lit("p"), "k").alias("phone"))
    add = e.filter("k % 50 = 9").select(F.concat(F.lit("n"), "k").alias("id"), F.concat(F.lit("added "), "k").alias("name"), F.lit(None).cast("string").alias("phone"))
    delta = upd.unionByName(add)
    twice = delta.withColumn("turn", F.lit(2)).unionByName(delta.select("id", F.concat(F.lit("zz old "), "name").alias("name"), F.lit("zz").alias("phone"), F.lit(1).alias("turn")))
    return e.select("id", "name", "phone", "la"), twice


@query("ups01_upserted", f"WITH d AS ({_DELTA}) SELECT id, name, phone, la FROM entity WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT id, name, phone, NULL FROM d", uses=("entity",))
def upserted(spark, sf):
    return changes.upsert(*_base_delta(spark, sf), order=["turn"]).drop("turn")


@query("ups01_bucketed_upsert", f"WITH d AS ({_DELTA}) SELECT id, name, phone, la FROM entity WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT id, name, phone, NULL FROM d", uses=("entity",))
def bucketed_upsert(spark, sf):
    """The same upsert into a bucketed table, by appending the changed rows to their buckets."""
    base, delta = _base_delta(spark, sf)
    name = f"upserts_{uuid.uuid4().hex}"
    snap = BucketedSnapshot(spark, name, f"{shared_dir(spark).rstrip('/')}/{name}", ["id"], ["turn"])
    snap.take(base.withColumn("turn", F.lit(0)))
    snap.take(delta)
    return snap.snapshot().drop("turn")


@query("ups02_patched", f"WITH d AS ({_DELTA}) SELECT e.id, coalesce(d.name, e.name) AS name, CASE WHEN d.id IS NULL THEN e.phone ELSE d.phone END AS phone, la FROM entity e LEFT JOIN d USING (id)", uses=("entity",))
def patched(spark, sf):
    return changes.patch(*_base_delta(spark, sf), order=["turn"])


@query("ups03_patched_many", "SELECT id, CASE WHEN k % 7 = 3 THEN 'Essex' ELSE la END AS la, CASE WHEN k % 7 = 3 THEN true ELSE hot END AS hot FROM entity", uses=("entity",))
def patched_many(spark, sf):
    e = view(spark, sf, "entity")
    return changes.patch_many(e, e.filter("k % 7 = 3").select("id"), {"la": F.lit("Essex"), "hot": F.lit(True)}).select("id", "la", "hot")


@query("ups05_deleted", "SELECT id FROM entity WHERE k % 4 <> 1", uses=("entity",))
def deleted(spark, sf):
    e = view(spark, sf, "entity")
    return changes.delete(e, e.filter("k % 4 = 1").select("id")).select("id")


@query("ups06_current_votes", f'SELECT userId AS "userId", schoolId AS "schoolId", fieldName AS "fieldName", CASE WHEN vote > 0 THEN 1 ELSE -1 END AS vote FROM {D_CURRENT_VOTES}', uses=("votes",))
def current_votes(spark, sf):
    return changes.current_votes(view(spark, sf, "votes"), ["votedAt", "event_id"]).select("userId", "schoolId", "fieldName", "vote")


@query("win05_last_reports", """SELECT userId AS "userId", schoolId AS "schoolId", fieldName AS "fieldName", status, customValue AS "customValue" FROM (SELECT *, row_number() OVER (PARTITION BY userId, schoolId, fieldName ORDER BY reportedAt DESC, event_id DESC) rn FROM reports) WHERE rn = 1""", uses=("reports",))
def last_reports(spark, sf):
    r = view(spark, sf, "reports")
    return changes.upsert_by_key(r.limit(0), r, ["userId", "schoolId", "fieldName"], ["reportedAt", "event_id"]).select("userId", "schoolId", "fieldName", "status", "customValue")


@query("ups07_inserted", f"WITH d AS ({_DELTA}) SELECT id, name FROM entity UNION ALL SELECT id, 'zz old ' || name FROM d WHERE id NOT IN (SELECT id FROM entity)", uses=("entity",))
def inserted(spark, sf):
    return changes.insert_new(*_base_delta(spark, sf), order=["turn"]).select("id", "name")


# Merge plan: planted copies into the row they copy.
PLAN = """SELECT concat('e', lpad(cast(k - 1 AS STRING), 9, '0')) AS id_a, id AS id_b FROM entity WHERE k % 17 = 3"""
CTES["plan"] = """
WITH s AS (SELECT id, (CASE WHEN coalesce(urn, '') <> '' THEN 50 ELSE 0 END) + (CASE WHEN coalesce(ofstedRating, '') <> '' THEN 20 ELSE 0 END) + (CASE WHEN coalesce(website, '') <> '' THEN 10 ELSE 0 END) + (CASE WHEN coalesce(phone, '') <> '' THEN 10 ELSE 0 END) + coalesce(confidence_score, 0) AS sc FROM entity)
SELECT CASE WHEN a.sc >= b.sc THEN a.id ELSE b.id END AS prim, CASE WHEN a.sc >= b.sc THEN b.id ELSE a.id END AS sec FROM (""" + PLAN + """) p JOIN s a ON a.id = p.id_a JOIN s b ON b.id = p.id_b
"""


def _plan(spark, sf):
    e = view(spark, sf, "entity")
    e.createOrReplaceTempView("entity")
    return merge.merge_plan(spark.sql(PLAN), e)


@query("er05_merge_plan", 'SELECT prim AS "primary", sec AS secondary FROM plan', uses=("entity", "plan"))
def merge_plan(spark, sf):
    return _plan(spark, sf)


@query("er05_filled_survivors", """SELECT a.id, a.name, CASE WHEN coalesce(a.urn, '') = '' AND coalesce(b.urn, '') <> '' THEN b.urn ELSE a.urn END AS urn, CASE WHEN coalesce(a.phone, '') = '' AND coalesce(b.phone, '') <> '' THEN b.phone ELSE a.phone END AS phone,
 CASE WHEN a.gcseProgress8 IS NULL OR a.gcseProgress8 = 0 THEN CASE WHEN coalesce(b.gcseProgress8, 0) <> 0 THEN b.gcseProgress8 ELSE a.gcseProgress8 END ELSE a.gcseProgress8 END AS "gcseProgress8",
 'Merged with ' || b.name || ' (' || b.id || ')' AS "dedupNote" FROM plan p JOIN entity a ON a.id = p.prim JOIN entity b ON b.id = p.sec""", uses=("entity", "plan"))
def filled_survivors(spark, sf):
    return merge.blank_filled(_plan(spark, sf), entities(spark, sf)).select("id", "name", "urn", "phone", "gcseProgress8", "dedupNote")


_SMART = """SELECT a.id, CASE WHEN coalesce(a.urn, '') NOT IN ('', 'N/A') THEN a.urn ELSE coalesce(b.urn, '') END AS urn, CASE WHEN length(coalesce(a.address, '')) > length(coalesce(b.address, '')) THEN a.address ELSE coalesce(nullif(b.address, ''), a.address) END AS address,
 CASE WHEN contains(coalesce(a.website, ''), '.sch.uk') THEN a.website ELSE coalesce(nullif(b.website, ''), a.website) END AS website, CASE WHEN coalesce(a.ofstedRating, '') NOT IN ('', 'N/A') THEN a.ofstedRating ELSE coalesce(nullif(b.ofstedRating, ''), a.ofstedRating) END AS "ofstedRating",
 CASE WHEN coalesce(a.phone, '') <> '' THEN a.phone ELSE b.phone END AS phone, coalesce(a.gcseAttainment8, b.gcseAttainment8) AS "gcseAttainment8", CASE WHEN a.la <> '' THEN a.la ELSE b.la END AS la FROM plan p JOIN entity a ON a.id = p.prim JOIN entity b ON b.id = p.sec"""


@query("er04_smart_merged", _SMART, uses=("entity", "plan"))
def smart_merged(spark, sf):
    return merge.smart_merged(_plan(spark, sf), view(spark, sf, "entity")).select("id", "urn", "address", "website", "ofstedRating", "phone", "gcseAttainment8", "la")


@query("er06_merged_directory", f"""WITH m AS ({_SMART}) SELECT e.id, coalesce(m.address, e.address) AS address, CASE WHEN m.id IS NOT NULL THEN m.urn ELSE e.urn END AS urn, CASE WHEN m.id IS NOT NULL THEN 98 ELSE confidence_score END AS confidence_score, CASE WHEN m.id IS NOT NULL THEN m.la ELSE e.la END AS la
 FROM entity e LEFT JOIN m USING (id) WHERE e.id NOT IN (SELECT sec FROM plan)""", uses=("entity", "plan"))
def merged_directory(spark, sf):
    out = merge.merge_records(_plan(spark, sf), view(spark, sf, "entity"), "m1", "admin", now())["entities"]
    return out.select("id", "address", "urn", "confidence_score", "la")


def _merged(spark, sf):
    return merge.merge_records(_plan(spark, sf), view(spark, sf, "entity"), "m1", "admin", now())


@query("er06_merge_log", f"""WITH m AS ({_SMART})
SELECT e.id AS "schoolId", 'MERGE' AS "actionType", 'm1' AS "batchId", e.previous AS phone_before, m.phone AS phone_after FROM (SELECT id, phone AS previous FROM entity) e LEFT JOIN m USING (id) WHERE e.id IN (SELECT sec FROM plan) OR m.id IS NOT NULL""", uses=("entity", "plan"))
def merge_log(spark, sf):
    p = lambda c: F.get_json_object(c, "$.phone")
    return _merged(spark, sf)["log"].select("schoolId", "actionType", "batchId", p("previousState").alias("phone_before"), p("newState").alias("phone_after"))


@query("er06_merge_mapping", """SELECT sec AS old, prim AS new, least(prim, sec) || '___' || greatest(prim, sec) AS "pairKey" FROM plan""", uses=("entity", "plan"))
def merge_mapping(spark, sf):
    out = _merged(spark, sf)
    return out["mapping"].join(out["reviewed"].select(F.col("idB").alias("old"), "pairKey"), "old").select("old", "new", "pairKey")


# A chain of three: every row numbered 4 of 17 goes into number 3, which goes into number 2.
CTES["chain"] = """SELECT a.id AS a_id, b.id AS b_id, c.id AS c_id, a.urn AS au, b.urn AS bu, c.urn AS cu, a.phone AS ap, b.phone AS bp, c.phone AS cp, a.address AS aa, b.address AS ba, c.address AS ca
FROM entity a JOIN entity b ON b.k = a.k + 1 LEFT JOIN entity c ON c.k = a.k + 2 WHERE a.k % 17 = 2"""


@query("er06_merged_chains", """WITH x AS (SELECT *, CASE WHEN c_id IS NULL THEN bu ELSE cu END AS lu, CASE WHEN c_id IS NULL THEN bp ELSE cp END AS lp FROM chain)
SELECT a_id AS id, CASE WHEN coalesce(au, '') NOT IN ('', 'N/A') THEN au WHEN coalesce(bu, '') NOT IN ('', 'N/A') THEN bu ELSE coalesce(lu, '') END AS urn,
  CASE WHEN coalesce(ap, '') <> '' THEN ap WHEN coalesce(bp, '') <> '' THEN bp ELSE lp END AS phone,
  coalesce(CASE WHEN length(coalesce(ca, '')) >= greatest(length(coalesce(aa, '')), length(coalesce(ba, ''))) THEN nullif(ca, '') END, CASE WHEN length(coalesce(ba, '')) >= length(coalesce(aa, '')) THEN nullif(ba, '') END, aa) AS address FROM x""", uses=("entity", "chain"))
def merged_chains(spark, sf):
    e = view(spark, sf, "entity")
    eid = lambda c: F.concat(F.lit("e"), F.lpad(c.cast("string"), 9, "0"))
    links = e.filter("k % 17 in (3, 4)").select(eid(F.col("k") - 1).alias("primary"), F.col("id").alias("secondary"))
    out = merge.merge_records(links, e.select("id", "urn", "phone", "address", "name", "verification_status", "confidence_score"), "m2", "admin", now())
    return out["entities"].join(out["mapping"].select(F.col("new").alias("id")).distinct(), "id").select("id", "urn", "phone", "address")


@query("er07_explicit_records", f"""WITH m AS ({_SMART}) SELECT m.id, CASE WHEN right(m.id, 1) = '2' THEN 'by hand' ELSE m.phone END AS phone, m.urn FROM m""", uses=("entity", "plan"))
def explicit_records(spark, sf):
    plan = _plan(spark, sf)
    hand = plan.filter(F.col("primary").endswith("2")).select(F.col("primary").alias("id"), F.lit("by hand").alias("phone"))
    out = merge.merge_records(plan, view(spark, sf, "entity"), "m3", "admin", now(), explicit=hand)
    return out["entities"].join(plan.select(F.col("primary").alias("id")), "id").select("id", "phone", "urn")


@query("ups08_repointed_votes", """
WITH v AS (SELECT userId, schoolId, fieldName, max(event_id) AS event_id, arg_max(vote, event_id) AS vote FROM votes GROUP BY 1, 2, 3),
m AS (SELECT userId, coalesce(prim, schoolId) AS s, fieldName, vote, event_id, prim IS NOT NULL AS moved FROM v LEFT JOIN plan ON sec = schoolId)
SELECT userId AS "userId", s AS "schoolId", fieldName AS "fieldName", vote FROM (SELECT *, row_number() OVER (PARTITION BY userId, s, fieldName ORDER BY moved, event_id) rn FROM m) WHERE rn = 1""", uses=("entity", "votes", "plan"))
def repointed_votes(spark, sf):
    v = ranking.latest(view(spark, sf, "votes"), ["userId", "schoolId", "fieldName"], ["event_id"])
    mapping = _plan(spark, sf).select(F.col("secondary").alias("old"), F.col("primary").alias("new"))
    return changes.rekey(v, mapping, ["userId", "schoolId", "fieldName"], order="event_id").select("userId", "schoolId", "fieldName", "vote")


@query("jn17_repointed_lists", """
WITH l AS (SELECT cast(floor(o_custkey / 8) AS BIGINT) AS "userId", o_orderkey AS ord, concat('e', lpad(cast(o_custkey AS STRING), 9, '0')) AS item FROM orders)
SELECT "userId", string_agg(coalesce(prim, item), ',' ORDER BY ord) AS items FROM l LEFT JOIN plan ON sec = item GROUP BY 1""", uses=("entity", "plan"))
def repointed_lists(spark, sf):
    item = F.concat(F.lit("e"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    o = table(spark, sf, "orders").groupBy(F.floor(F.col("o_custkey") / 8).alias("userId")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda s: s["i"]).alias("items"))
    mapping = _plan(spark, sf).select(F.col("secondary").alias("old"), F.col("primary").alias("new"))
    return changes.remap_arrays(o, mapping, "userId", ["items"]).select("userId", F.array_join("items", ",").alias("items"))


@query("ups09_confidence_floor", "SELECT id, CASE WHEN verification_status = 'auto_verified' AND coalesce(confidence_score, 0) < 90 THEN 95 ELSE confidence_score END AS confidence_score FROM entity", uses=("entity",))
def confidence_floor(spark, sf):
    return changes.confidence_floor(view(spark, sf, "entity")).select("id", "confidence_score")


@query("ups10_committed", """SELECT id, CASE WHEN k % 6 = 1 AND k % 4 <> 0 THEN 'Grammar' ELSE schoolType END AS "schoolType", CASE WHEN k % 6 = 1 THEN 'auto_verified' ELSE verification_status END AS verification_status, CASE WHEN k % 6 = 1 THEN 98 ELSE confidence_score END AS confidence_score FROM school""", uses=SCHOOL)
def committed(spark, sf):
    s = schools(spark, sf)
    acc = s.filter("k % 6 = 1").select("id", F.when(F.col("k") % 4 != 0, "Grammar").alias("schoolType"), F.lit(2).alias("turn"))
    acc = acc.unionByName(acc.select("id", F.lit("Withdrawn").alias("schoolType"), F.lit(1).alias("turn")))
    return changes.commit_changes(s, acc, "2026-09-15T00:00:00Z", order=["turn"]).select("id", "schoolType", "verification_status", "confidence_score")


@query("ups11_logged_changes", """SELECT id AS "schoolId", 'EDIT' AS "actionType" FROM entity WHERE k % 7 = 3 AND la <> 'Essex'""", uses=("entity",))
def logged_changes(spark, sf):
    e = view(spark, sf, "entity").select("id", "k", "la", "name")
    after = changes.patch_many(e, e.filter("k % 7 = 3").select("id"), {"la": F.lit("Essex")})
    return changes.log_changes(e, after, "EDIT", "b1", "admin", now()).select("schoolId", "actionType")


@query("ups12_restored_states", """SELECT schoolId AS "schoolId", min(id) AS id, arg_min(previousState, id) AS "previousState" FROM audit WHERE batchId IN ('b3', 'b17') AND rolledBackAt IS NULL GROUP BY 1""", uses=("audit",))
def restored_states(spark, sf):
    return changes.restore_states(view(spark, sf, "audit"), ["b3", "b17"])


@query("ups12_rolled_back", """WITH r AS (SELECT schoolId, arg_min(previousState ->> 'phone', id) AS p, arg_min(previousState ->> 'website', id) AS w FROM audit WHERE batchId IN ('b3', 'b17') AND rolledBackAt IS NULL GROUP BY 1)
SELECT e.id, CASE WHEN r.schoolId IS NULL THEN phone ELSE p END AS phone, CASE WHEN r.schoolId IS NULL THEN website ELSE w END AS website, CASE WHEN r.schoolId IS NULL THEN gender ELSE 'Mixed' END AS gender, la FROM entity e LEFT JOIN r ON r.schoolId = e.id""", uses=("entity", "audit"))
def rolled_back(spark, sf):
    e = view(spark, sf, "entity").select("id", "phone", "website", "gender", "la")
    return changes.roll_back(e, view(spark, sf, "audit"), ["b3", "b17"], now())[0]


@query("ups13_version_rollback", """SELECT e.id, CASE WHEN a.id IS NULL THEN phone ELSE a.previousState ->> 'phone' END AS phone, CASE WHEN a.id IS NULL THEN e.gender ELSE 'Mixed' END AS gender, CASE WHEN a.id IS NULL THEN verification_status ELSE 'unverified' END AS verification_status
 FROM entity e LEFT JOIN audit a ON a.id = 77 AND a.schoolId = e.id""", uses=("entity", "audit"))
def version_rollback(spark, sf):
    e = view(spark, sf, "entity").select("id", "phone", "gender", "verification_status")
    entity_id = "e" + str(77 * 11 % 1200).zfill(9)
    return changes.roll_back_version(e, view(spark, sf, "audit"), 77, entity_id, "admin", now())[0]


@query("ups14_history", """SELECT id, actionType AS "actionType", batchId AS "batchId" FROM audit WHERE schoolId = 'e000000011' ORDER BY id DESC""", uses=("audit",))
def history(spark, sf):
    from dirwise.operators.search import history as h

    return h(view(spark, sf, "audit"), "e000000011").select("id", "actionType", "batchId")


@query("ups15_minimal_log", """SELECT id, CASE WHEN id % 4 <> 0 THEN '{"note":"n' || (id % 5) || '","phone":"p' || ((id + 1) % 7) || '"}' END AS "newState" FROM audit""", uses=("audit",))
def minimal_log(spark, sf):
    out = changes.minimal_diff(view(spark, sf, "audit"))
    m = F.from_json("newState", "map<string,string>")
    return out.select("id", F.when(F.col("newState").isNotNull(), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))).alias("newState"))


@query("ups16_pruned_log", """SELECT id, left(previousState ->> 'phone', 1) || '...' AS phone, previousState ->> 'website' AS website, NULL AS gender FROM audit""", uses=("audit",))
def pruned_log(spark, sf):
    out, _ = changes.prune(view(spark, sf, "audit"), "previousState", ["gender"], {"phone": 1, "website": 2})
    g = lambda k: F.get_json_object("previousState", f"$.{k}").alias(k)
    return out.select("id", g("phone"), g("website"), g("gender"))


@query("ups16_pruned_payloads", """SELECT id, previousState AS payload FROM audit""", uses=("audit",))
def pruned_payloads(spark, sf):
    return changes.prune(view(spark, sf, "audit"), "previousState", ["gender"], {"phone": 1})[1]


def _prompts(spark, sf):
    """Every text under two lines of an entity of its own."""
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("School Name: s"), "doc_id", F.lit("\nURN:"), "doc_id", F.lit("\n"), "text").alias("prompt"))


@query("ups16_template_dictionary", "SELECT sha256('School Name: {}' || chr(10) || 'URN: {}' || chr(10) || text) AS template, md5(min('School Name: {}' || chr(10) || 'URN: {}' || chr(10) || text)) AS text, count(*) AS uses FROM documents GROUP BY 1")
def template_dictionary(spark, sf):
    return changes.template_dictionary(_prompts(spark, sf), "prompt")[1].select("template", F.md5("text").alias("text"), "uses")


@query("ups16_restored_texts", "SELECT doc_id, md5('School Name: s' || doc_id || chr(10) || 'URN:' || doc_id || chr(10) || text) AS prompt FROM documents")
def restored_texts(spark, sf):
    return changes.restored_texts(*changes.template_dictionary(_prompts(spark, sf), "prompt"), "prompt").select("doc_id", F.md5("prompt").alias("prompt"))


@query("ups17_relocated", "SELECT count(*) AS rows_moved, sum(octet_length(encode(newState))) AS bytes_moved FROM audit", uses=("audit",))
def relocated(spark, sf):
    return changes.relocate(view(spark, sf, "audit"), "newState", "id", ["phone"])[2]


@query("ups18_rebuilt", "SELECT id, try_cast(pupilCount AS INT) AS \"pupilCount\", la, cast(NULL AS VARCHAR) AS headteacher FROM entity", uses=("entity",))
def rebuilt(spark, sf):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("pupilCount", T.IntegerType()), T.StructField("la", T.StringType()), T.StructField("headteacher", T.StringType())])
    return changes.rebuild(view(spark, sf, "entity"), schema)


@query("ups19_system_votes", """SELECT 'system_quality_auto' AS "userId", id AS "schoolId", unnest(['website', 'phone']) AS "fieldName", 1 AS vote FROM entity WHERE k % 8 = 1""", uses=("entity",))
def system_votes(spark, sf):
    ch = view(spark, sf, "entity").filter("k % 8 = 1").withColumn("fields", F.array(F.lit("website"), F.lit("phone")))
    return changes.votes_for(ch, "system_quality_auto", 1, now()).select("userId", "schoolId", "fieldName", "vote")


@query("ups19_system_reviews", """SELECT id AS "schoolId", unnest(CASE WHEN k % 3 = 0 THEN ['website', 'phone'] ELSE ['la'] END) AS "fieldName", 'system' AS "reviewedBy" FROM entity WHERE k % 8 = 1""", uses=("entity",))
def system_reviews(spark, sf):
    fields = F.when(F.col("k") % 3 == 0, F.array(F.lit("website"), F.lit("phone"))).otherwise(F.array(F.lit("la")))
    return changes.reviews_for(view(spark, sf, "entity").filter("k % 8 = 1").withColumn("fields", fields), "system", now()).drop("reviewedAt")


@query("ups21_promoted_reports", """WITH r AS (SELECT schoolId, fieldName, arg_max(customValue, (reportedAt, event_id)) AS v FROM reports WHERE status = 'down' AND customValue <> '' AND fieldName IN ('phone', 'website') GROUP BY 1, 2)
SELECT e.id, coalesce(p.v, e.phone) AS phone, coalesce(w.v, e.website) AS website FROM entity e LEFT JOIN r p ON p.schoolId = e.id AND p.fieldName = 'phone' LEFT JOIN r w ON w.schoolId = e.id AND w.fieldName = 'website'""", uses=("entity", "reports"))
def promoted_reports(spark, sf):
    return changes.promote_reports(view(spark, sf, "entity"), view(spark, sf, "reports"), ["phone", "website"], ["reportedAt", "event_id"]).select("id", "phone", "website")


@query("er09_review_ledger", """SELECT concat('e', lpad(cast(doc_id AS STRING), 9, '0')) || '::' || concat('e', lpad(cast(doc_id + 1 AS STRING), 9, '0')) AS pair_id, 'not_duplicate' AS decision FROM labels WHERE doc_id % 3 <> 0 OR quality <> 1""")
def review_ledger(spark, sf):
    eid = lambda c: F.concat(F.lit("e"), F.lpad(c.cast("string"), 9, "0"))
    d = table(spark, sf, "labels").select(
        eid(F.col("doc_id") + 1).alias("school_a_id"), eid(F.col("doc_id")).alias("school_b_id"), F.lit("not_duplicate").alias("decision"), F.lit("").alias("reason"),
        F.lit("admin").alias("reviewed_by"), F.col("doc_id").alias("reviewed_at"), "doc_id", "quality")
    ledger = changes.mark_pairs(d.limit(0).select(F.lit("").alias("pair_id"), "school_a_id", "school_b_id", "decision", "reason", "reviewed_by", "reviewed_at"), d)
    undo = d.filter("doc_id % 3 = 0 AND quality = 1").select(F.concat_ws("::", "school_b_id", "school_a_id").alias("pair_id"))
    return changes.unmark_pairs(ledger, undo).select("pair_id", "decision")


@query("er14_refreshed_candidates", """WITH s AS (SELECT id AS a, concat('e', lpad(cast(k + 3 AS STRING), 9, '0')) AS b, k FROM entity)
SELECT a AS "idA", b AS "idB", CASE WHEN b IN (SELECT id FROM entity) THEN 'pending' ELSE 'resolved' END AS status FROM s WHERE k % 5 <> 1""", uses=("entity",))
def refreshed_candidates(spark, sf):
    e = view(spark, sf, "entity").select("id", "k")
    stored = e.select(F.col("id").alias("idA"), F.concat(F.lit("e"), F.lpad((F.col("k") + 3).cast("string"), 9, "0")).alias("idB"), F.lit("pending").alias("status"), "k")
    return changes.refresh_candidates(stored, e, stored.filter("k % 5 = 1").select(F.concat_ws("::", "idA", "idB").alias("pair_id"))).select("idA", "idB", "status")


@query("er15_pruned_candidates", """WITH s AS (SELECT id AS a, concat('e', lpad(cast(k + 3 AS STRING), 9, '0')) AS b FROM entity) SELECT a AS "idA", b AS "idB" FROM s WHERE a NOT IN (SELECT sec FROM plan) AND b NOT IN (SELECT sec FROM plan)""", uses=("entity", "plan"))
def pruned_candidates(spark, sf):
    e = view(spark, sf, "entity").select("id", "k")
    stored = e.select(F.col("id").alias("idA"), F.concat(F.lit("e"), F.lpad((F.col("k") + 3).cast("string"), 9, "0")).alias("idB"))
    return changes.prune_candidates(stored, _plan(spark, sf).select("secondary"))


@query("jn02_open_reports", """SELECT r.event_id, r.schoolId AS "schoolId", e.name AS "schoolName", r.fieldName AS "fieldName" FROM reports r LEFT JOIN entity e ON e.id = r.schoolId WHERE r.status = 'down'""", uses=("entity", "reports"))
def open_reports(spark, sf):
    r = view(spark, sf, "reports").filter("status = 'down'")
    return r.join(view(spark, sf, "entity").select(F.col("id").alias("schoolId"), F.col("name").alias("schoolName")), "schoolId", "left").select("event_id", "schoolId", "schoolName", "fieldName")
