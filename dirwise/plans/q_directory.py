"""Reading, filtering, searching, counting and ranking the directory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dirwise.operators import aggregates as agg
from dirwise.operators import filters as flt
from dirwise.operators import ranking, records, search
from dirwise.plans.fixtures import CTES, entities, table, view
from dirwise.plans.q_scalars import d_type
from dirwise.plans.registry import query

AS_OF = dt.datetime(2026, 9, 15)

# The read form of an entity, in SQL.
CTES["school"] = f"""
SELECT id, k, name, coalesce(urn, '') AS urn, coalesce(la, '') AS la, coalesce(region, '') AS region, coalesce(postcode, '') AS postcode,
  coalesce(address, '') AS address, {d_type()} AS schoolType, schoolType AS rawSchoolType, coalesce(gender, '') AS gender, ageRange,
  coalesce(try_cast(nullif(regexp_extract(coalesce(pupilCount, ''), '^\\s*([-+]?[0-9]+)', 1), '') AS INT), 0) AS pupilCount,
  coalesce(ofstedRating, '') AS ofstedRating, gcseProgress8, gcseAttainment8, national_rank_england, gcse_rank_england, a_level_rank_england,
  coalesce(entranceExamType, '') AS entranceExamType, coalesce(website, '') AS website, coalesce(phone, '') AS phone, email,
  coalesce(feesTermly, '') AS feesTermly, registrationFee, coalesce(second_stage_exam_required, '') AS second_stage_exam_required,
  stage_one_format_and_subjects, stage_two_format_and_subjects, admissionsPolicy, official, hot, active, verification_status,
  list_filter(string_split(tags_text, ','), lambda t: t <> '') AS tags, verified_at, confidence_score, coalesce(completeness_score, 0) AS completeness_score,
  primary_exam_type_id, exam_consortium, exam_consortium_id, governing_body, easting, northing,
  d_registrationOpen, d_registrationDeadline, d_examDate, d_resultsDate, d_offersAcceptance, d_acceptanceDeadline
FROM entity
"""
SCHOOL = ("entity", "school")


def schools(spark, sf):
    return records.hydrate(entities(spark, sf))


def d_tags(*tags):
    return "list_has_any(tags, [" + ", ".join(f"'{t}'" for t in tags) + "])"


D_ENRICHED = f"({d_tags(*flt.ENRICHED_TAGS)} OR verification_status = 'llm_enriched')"
D_VERIFIED = f"({d_tags(*flt.VERIFIED_TAGS)} OR verification_status IN ('auto_verified', 'verified') OR coalesce(verified_at, '') <> '')"
D_TWO = "(contains(entranceExamType, 'Two-Stage') OR contains(entranceExamType, 'Stage 2'))"
D_TAG = {
    "llm_enriched": D_ENRICHED, "auto_verified": D_VERIFIED, "dates_verified": d_tags(*flt.CURRENT_TAGS),
    "two_stage": f"(second_stage_exam_required = 'Yes' OR {D_TWO} OR {d_tags('two_stage_exam')})",
    "fees": "(feesTermly <> '' OR registrationFee <> '')", "website": "(trim(website) <> '' AND website <> 'N/A')",
    "anomalies": "(verification_status IN (" + ", ".join(f"'{x}'" for x in flt.PROBLEM_STATUSES) + f") OR {d_tags(*flt.PROBLEM_TAGS)})",
    "unscanned": f"(NOT {D_ENRICHED} AND NOT {D_VERIFIED})", "crawl_stuck": d_tags("crawl_stuck"),
}


@query("prj01_read_rows", """SELECT id, urn, schoolType, rawSchoolType, pupilCount, ofstedRating, official, active, array_to_string(tags, '|') AS tags, completeness_score,
  CASE WHEN trim(urn) <> '' THEN 'https://www.compare-school-performance.service.gov.uk/school/' || trim(urn) END AS link FROM school""", uses=SCHOOL)
def read_rows(spark, sf):
    return schools(spark, sf).select("id", "urn", "schoolType", "rawSchoolType", "pupilCount", "ofstedRating", "official", "active",
                                     F.array_join("verification_tags", "|").alias("tags"), "completeness_score",
                                     F.col("compareSchoolPerformanceUrl").alias("link"))


@query("prj02_stored_rows", f"""
WITH f AS (SELECT *, try_cast(nullif(regexp_extract(replace(coalesce(feesTermly, ''), ',', ''), '[0-9]+'), '') AS INT) AS n FROM entity),
g AS (SELECT *, CASE WHEN n > 100 AND n < 100000 THEN n END AS t FROM f)
SELECT CASE WHEN k % 9 = 4 THEN CASE WHEN coalesce(urn, '') <> '' THEN 'sch-gov-' || urn END ELSE id END AS id, k, nullif(urn, '') AS urn, nullif(postcode, '') AS postcode,
  {d_type()} AS schoolType, t AS fees_termly_gbp, t * 3 AS fees_annual_gbp, coalesce(confidence_score, 70) AS confidence_score,
  nullif(ofstedRating, '') AS ofstedRating FROM g""", uses=("entity",))
def stored_rows(spark, sf):
    e = view(spark, sf, "entity").withColumn("id", F.when(F.col("k") % 9 == 4, "").otherwise(F.col("id")))
    return records.dehydrate(e).select("id", "k", "urn", "postcode", "schoolType", "fees_termly_gbp", "fees_annual_gbp", "confidence_score", "ofstedRating")


@query("prj04_overlays", """
SELECT e.id, coalesce(p.phone, e.phone) AS phone, e.la, coalesce(p.note, '') AS note,
  CASE WHEN p.id IS NULL THEN d_examDate ELSE '1 May 2030' END AS exam FROM entity e
LEFT JOIN (SELECT id, 'new' || k AS phone, 'checked' AS note FROM entity WHERE k % 3 = 1) p ON p.id = e.id""", uses=("entity",))
def overlays(spark, sf):
    e = entities(spark, sf)
    patch = e.filter("k % 3 = 1").select("id", F.concat(F.lit("new"), "k").alias("phone"), F.lit("checked").alias("note"),
                                         F.create_map(F.lit("examDate"), F.lit("1 May 2030")).alias("_dates"))
    out = records.overlay(e, patch)
    return out.select("id", "phone", "la", F.coalesce("note", F.lit("")).alias("note"),
                      records.overlay_map("entranceExamDates", "_dates")["examDate"].alias("exam"))


@query("prj05_website_rows", """SELECT id, name, website, postcode, la, schoolType, CASE WHEN gender = '' THEN 'Mixed' ELSE gender END AS gender,
  website LIKE 'https://%' AS "isHttps", list_contains(tags, 'dead_website') AS "isDead",
  coalesce(verified_at, '') <> '' OR list_has_any(tags, ['web_health_audited', 'auto_verified']) AS "isAudited", verified_at AS "verifiedAt"
FROM school WHERE trim(website) LIKE 'http%'""", uses=SCHOOL)
def website_rows(spark, sf):
    return records.drilldown(schools(spark, sf))


@query("prj06_rendered_texts", """
SELECT id, name || ' / ' || CASE WHEN urn = '' THEN 'N/A' ELSE urn END || ' / ' || postcode || ' / ' || schoolType || ' / ' || coalesce(nullif(region, ''), la) AS line FROM school""", uses=SCHOOL)
def rendered_texts(spark, sf):
    s = schools(spark, sf)
    return s.select("id", records.render(s, "{{SCHOOL_NAME}} / {{urn}} / {{postcode}} / {{School_Type}} / {{region}}").alias("line"))


@query("prj06_search_phrases", """
WITH d AS (SELECT *, '"' || name || '"' AS q, CASE WHEN website IN ('', 'N/A', 'null', 'Unknown') THEN '' ELSE lower(regexp_extract(website, '^(?:https?://)?(?:www\\.)?([^/?#:]*)', 1, 'i')) END AS host FROM school)
SELECT id, 1 AS pos, trim(q || ' admissions "11+" OR "Year 7" key dates 2026 2027 ' || postcode) AS phrase FROM d
UNION ALL SELECT id, 3, q || ' termly fees tuition 2025 2026 2027' FROM d
UNION ALL SELECT id, 4, CASE WHEN host <> '' THEN 'site:' || host || ' admissions OR "key dates" OR "entry 2026"' ELSE q || ' official prospectus admissions' END FROM d
UNION ALL SELECT id, 5, CASE WHEN urn NOT IN ('', 'N/A') THEN q || ' DfE GIAS URN ' || urn || ' gender age range' ELSE q || ' DfE GIAS school gender age range' END FROM d""", uses=SCHOOL)
def search_phrases(spark, sf):
    s = schools(spark, sf)
    return s.select("id", F.posexplode(records.search_phrases(s)).alias("pos", "phrase")).select("id", (F.col("pos") + 1).alias("pos"), "phrase").where("pos <> 2")


@query("prj07_compact_reports", """SELECT id, previousState ->> 'phone' AS phone, previousState ->> 'gender' AS gender FROM audit""", uses=("audit",))
def compact_reports(spark, sf):
    log = view(spark, sf, "audit")
    c = records.compact(log, "previousState", ["phone", "gender"], ["changes"])
    return c.select("id", F.get_json_object("previousState", "$.phone").alias("phone"), F.get_json_object("previousState", "$.gender").alias("gender"))


@query("prj08_canonical_milestones", """
WITH m AS (SELECT id, trim(d_registrationOpen) AS "registrationOpen", trim(d_registrationDeadline) AS "registrationDeadline", trim(d_examDate) AS "stage_one_examDate",
  trim(coalesce(nullif(d_offersAcceptance, ''), d_resultsDate)) AS "offerDate", trim(d_acceptanceDeadline) AS "acceptanceDeadline" FROM entity)
SELECT id, milestone, value FROM m UNPIVOT (value FOR milestone IN ("registrationOpen", "registrationDeadline", "stage_one_examDate", "offerDate", "acceptanceDeadline"))
WHERE value NOT IN ('', 'N/A', 'null')""", uses=("entity",))
def canonical_milestones(spark, sf):
    return entities(spark, sf).select("id", F.explode(records.canonical_milestones("entranceExamDates")).alias("milestone", "value"))


@query("flt01_text_filter", """SELECT id FROM school WHERE contains(lower(concat_ws('|', name, postcode, la, address, urn, region, entranceExamType, admissionsPolicy, website,
  stage_one_format_and_subjects, stage_two_format_and_subjects, array_to_string(tags, ' '))), 'verbal') OR contains(lower(name), 'ring') OR contains(array_to_string(tags, ' '), 'current')""", uses=SCHOOL)
def text_filter(spark, sf):
    s = schools(spark, sf)
    return s.filter(flt.has_text("Verbal ", s.columns) | flt.has_text("RING", ["name"]) | flt.has_text("current", ["verification_tags"])).select("id")


@query("flt03_facets", """SELECT id, name FROM school WHERE official AND lower(schoolType) LIKE '%compre%' AND lower(gender) LIKE '%mixed%' AND lower(region) = 'south east'
  AND pupilCount BETWEEN 200 AND 1500 AND coalesce(confidence_score, 0) < 80 AND coalesce(confidence_score, 0) >= 50""", uses=SCHOOL)
def facets(spark, sf):
    s = schools(spark, sf)
    return s.filter(flt.facets(s.columns, official=True, type="Compre", gender="mixed", region="SOUTH EAST", min_pupils=200, max_pupils=1500,
                               confidence="medium")).select("id", "name")


@query("flt04_tag_families", "SELECT id, " + ", ".join(f"{c} AS {n}" for n, c in D_TAG.items()) + " FROM school", uses=SCHOOL)
def tag_families(spark, sf):
    return schools(spark, sf).select("id", *[flt.by_tag(n).alias(n) for n in D_TAG])


@query("flt05_bands", f"""SELECT id, second_stage_exam_required = 'Yes' OR {D_TWO} OR contains(entranceExamType, 'SET') AS stage_yes,
  second_stage_exam_required = 'No' OR (second_stage_exam_required = '' AND NOT contains(entranceExamType, 'Two-Stage')) AS stage_no,
  coalesce(confidence_score, 0) >= 80 AS high, coalesce(confidence_score, 0) < 50 AS low, schoolType IN ('Comprehensive', 'Grammar', 'State') AS state_fee,
  contains(schoolType, 'Independent') AS paying, feesTermly <> '' OR registrationFee <> '' AS recorded FROM school""", uses=SCHOOL)
def bands(spark, sf):
    return schools(spark, sf).select(
        "id", flt.second_stage("yes").alias("stage_yes"), flt.second_stage("no").alias("stage_no"), flt.confidence_band("high").alias("high"),
        flt.confidence_band("low").alias("low"), flt.fee_class("state").alias("state_fee"), flt.fee_class("paying").alias("paying"),
        flt.fee_class("recorded").alias("recorded"))


_QD = ", ".join(f"'{d}'" for d in flt.QUEUE_DISTRICTS)


def d_like(*w):
    return "len(list_filter(tags, lambda t: " + " OR ".join(f"contains(lower(t), '{x}')" for x in w) + ")) > 0"


@query("flt10_categories", f"""SELECT id, region = 'Greater London' OR la IN ({_QD}) AS london,
  schoolType = 'Independent' AND (region = 'Greater London' OR la IN ({_QD})) AS london_independent,
  coalesce(trim(verified_at), '') = '' OR verification_status IN ('unverified', 'unscanned') AS unverified,
  verification_status = 'has_anomalies' OR {d_like('date_inversion', 'historical_date_stale')} AS critical,
  trim(website) = '' OR website = 'N/A' OR {d_like('missing_website', 'dead_website', 'auto_verification_data_missing')} AS missing_info,
  verification_status <> 'llm_enriched' AND NOT {d_like('llm_enriched', 'llm_verified')} AND (coalesce(trim(verified_at), '') = '' OR verified_at < '2026-09-05T00:00:00.000Z') AS due
FROM school""", uses=SCHOOL)
def categories(spark, sf):
    return schools(spark, sf).select("id", *[flt.category(c).alias(c.lower()) for c in ("LONDON", "LONDON_INDEPENDENT", "UNVERIFIED", "CRITICAL", "MISSING_INFO")],
                                     flt.due(AS_OF).alias("due"))


@query("flt12_preferences", """WITH g AS (SELECT id, lower(trim(gender)) AS s, lower(schoolType) AS t, lower(ofstedRating) AS r FROM school),
c AS (SELECT *, s LIKE '%boy%' AND s NOT LIKE '%girl%' AS b, s LIKE '%girl%' AND s NOT LIKE '%boy%' AS gi, s LIKE '%mixed%' OR s LIKE '%co-ed%' OR s LIKE '%coeducational%' AS m FROM g)
SELECT id, gi AS girls, b AS boys, m AS mixed, gi OR m AS girls_mixed, b OR m AS boys_mixed, b OR gi AS single, true AS everyone,
  t LIKE '%grammar%' OR t LIKE '%comprehensive%' OR t LIKE '%academy%' OR t LIKE '%community%' AS types,
  r LIKE '%outstanding%' OR r LIKE '%excellent%' AS top_rating, r LIKE '%outstanding%' OR r LIKE '%excellent%' OR r LIKE '%good%' AS good_rating FROM c""", uses=SCHOOL)
def preferences(spark, sf):
    sexes = {"girls": ["girls"], "boys": ["boys"], "mixed": ["co-ed"], "girls_mixed": ["girls", "mixed"], "boys_mixed": ["boys", "mixed"],
             "single": ["boys", "girls"], "everyone": ["boys", "girls", "mixed"]}
    return schools(spark, sf).select("id", *[flt.accepts_sexes(v).alias(k) for k, v in sexes.items()], flt.accepts_types(["Grammar", "comprehensive"]).alias("types"),
                                     flt.rating_floor("outstanding").alias("top_rating"), flt.rating_floor("Good").alias("good_rating"))


@query("flt15_left_out", "SELECT id FROM entity WHERE id NOT IN (SELECT schoolId FROM reviews)", uses=("entity", "reviews"))
def left_out(spark, sf):
    return flt.without_ids(view(spark, sf, "entity"), view(spark, sf, "reviews").select("schoolId")).select("id")


@query("flt18_website_states", """SELECT id, w AS registered, w AND coalesce(verified_at, '') = '' AND NOT list_has_any(tags, ['web_health_audited', 'auto_verified']) AS unscanned,
  w AND trim(website) LIKE 'https://%' AS https, w AND trim(website) LIKE 'http://%' AS http, w AND list_contains(tags, 'dead_website') AS dead FROM (SELECT *, trim(website) LIKE 'http%' AS w FROM school)""", uses=SCHOOL)
def website_states(spark, sf):
    return schools(spark, sf).select("id", *[flt.website_state(s).alias(s) for s in ("registered", "unscanned", "https", "http", "dead")])


@query("agg01_overview", """SELECT count(*) AS total, count(*) FILTER (contains(schoolType, 'Grammar')) AS grammar, count(*) FILTER (contains(schoolType, 'Independent')) AS independent,
  count(*) FILTER (contains(schoolType, 'Comprehensive')) AS comprehensive, count(*) FILTER (lower(ofstedRating) = 'outstanding') AS outstanding FROM school""", uses=SCHOOL)
def overview(spark, sf):
    return agg.overview(schools(spark, sf))


@query("agg02_distinct_values", """SELECT DISTINCT 'la' AS field, la AS value FROM school WHERE la <> '' UNION ALL SELECT DISTINCT 'region', region FROM school WHERE region <> ''""", uses=SCHOOL)
def distinct_values(spark, sf):
    return agg.distinct_values(schools(spark, sf), "la", "region")


@query("agg03_rating_counts", "SELECT CASE WHEN ofstedRating = '' THEN 'Unknown' ELSE ofstedRating END AS \"ofstedRating\", count(*) AS n FROM school GROUP BY 1", uses=SCHOOL)
def rating_counts(spark, sf):
    return agg.group_counts(schools(spark, sf), "ofstedRating")


@query("agg04_coverage", """WITH c AS (SELECT count(*) AS total, count(*) FILTER (entranceExamType <> '') AS a, count(*) FILTER (website <> '') AS b, count(*) FILTER (email <> '') AS c FROM school)
SELECT field, f AS filled, total - f AS blank, cast(floor(f * 100.0 / total + 0.5) AS BIGINT) AS percentage FROM (SELECT total, 'exam' AS field, a AS f FROM c UNION ALL SELECT total, 'website', b FROM c UNION ALL SELECT total, 'email', c FROM c)""", uses=SCHOOL)
def coverage(spark, sf):
    from dirwise.functions.values import filled

    return agg.coverage(schools(spark, sf), {"exam": filled("entranceExamType"), "website": filled("website"), "email": filled("email")})


@query("agg05_category_statistics", f"""
WITH b AS (SELECT schoolType AS type, CASE WHEN region = '' THEN 'Other' ELSE region END AS region, CASE WHEN second_stage_exam_required = 'Yes' OR {D_TWO} THEN 'yes' ELSE 'no' END AS second_stage,
  CASE WHEN contains(schoolType, 'Independent') OR feesTermly <> '' THEN 'independent' ELSE 'state' END AS fee,
  {d_tags('llm_enriched', 'llm_verified', 'auto_verified', 'web_verified')} OR verification_status IN ('llm_enriched', 'auto_verified', 'verified') OR coalesce(verified_at, '') <> '' AS done FROM school),
g AS (SELECT type, region, second_stage, fee, count(*) AS total, count(*) FILTER (done) AS enriched FROM b GROUP BY GROUPING SETS ((type), (region), (second_stage), (fee), ()))
SELECT CASE WHEN fee IS NOT NULL THEN 'fee' WHEN second_stage IS NOT NULL THEN 'second_stage' WHEN region IS NOT NULL THEN 'region' WHEN type IS NOT NULL THEN 'type' ELSE 'all' END AS dimension,
  coalesce(type, region, second_stage, fee, 'all') AS value, total, enriched, total - enriched AS unscanned FROM g""", uses=SCHOOL)
def category_statistics(spark, sf):
    return agg.category_statistics(schools(spark, sf))


@query("agg05_enrichment_totals", f"""SELECT count(*) AS total, count(*) FILTER ({D_ENRICHED}) AS llm_enriched, count(*) FILTER ({d_tags(*flt.CURRENT_TAGS)}) AS dates_verified,
  count(*) FILTER (len(list_filter(tags, lambda t: regexp_matches(t, 'mismatch|dead|missing|error|stuck|anomal'))) > 0 OR verification_status = 'anomaly_flagged') AS anomalies FROM school""", uses=SCHOOL)
def enrichment_totals(spark, sf):
    return agg.enrichment_totals(schools(spark, sf))


@query("agg06_missing_counts", """WITH c AS (SELECT count(*) AS total, count(*) FILTER (trim(ofstedRating) = '') AS missing_rating, count(*) FILTER (trim(website) = '') AS missing_website,
  count(*) FILTER (trim(phone) = '') AS missing_phone, count(*) FILTER (trim(urn) = '') AS missing_key FROM school)
SELECT *, cast(floor((total - missing_rating) * 100.0 / total + 0.5) AS BIGINT) AS coverage_rate FROM c""", uses=SCHOOL)
def missing_counts(spark, sf):
    return agg.missing_counts(schools(spark, sf))


D_CURRENT_VOTES = """(SELECT userId, schoolId, fieldName, vote, event_id, votedAt FROM (SELECT *, row_number() OVER (PARTITION BY userId, schoolId, fieldName ORDER BY votedAt DESC, event_id DESC) AS rn FROM votes) WHERE rn = 1 AND vote <> 0)"""


@query("agg07_field_confidence", f"""
WITH v AS (SELECT schoolId, fieldName, count(*) FILTER (vote > 0) AS up, count(*) FILTER (vote < 0) AS down FROM {D_CURRENT_VOTES} GROUP BY 1, 2),
r AS (SELECT DISTINCT schoolId, fieldName FROM reviews),
j AS (SELECT coalesce(v.schoolId, r.schoolId) AS s, coalesce(v.fieldName, r.fieldName) AS f, coalesce(up, 0) AS up, coalesce(down, 0) AS down, r.schoolId IS NOT NULL AS adm
  FROM v FULL JOIN r ON r.schoolId = v.schoolId AND r.fieldName = v.fieldName),
c AS (SELECT *, CASE WHEN adm THEN 100 ELSE greatest(15, least(98, 60 + 5 * up - 10 * down)) END AS score FROM j)
SELECT s AS "schoolId", f AS "fieldName", score, CASE WHEN score >= 85 THEN 'High' WHEN score < 60 THEN 'Low' ELSE 'Medium' END AS level, adm AS "isAdminVerified",
  CASE WHEN adm THEN 'Admin Verified' ELSE score || '% Confidence' END AS label, up AS upvotes, down AS downvotes FROM c""", uses=("votes", "reviews"))
def field_confidence(spark, sf):
    from dirwise.operators.changes import current_votes

    return agg.field_confidence(current_votes(view(spark, sf, "votes"), ["votedAt", "event_id"]), view(spark, sf, "reviews"))


@query("agg08_report_rollup", """
WITH d AS (SELECT * FROM reports WHERE status = 'down')
SELECT d.event_id, d.schoolId AS "schoolId", coalesce(nullif(e.name, ''), d.schoolId) AS "schoolName", coalesce(nullif(e.urn, ''), 'N/A') AS "schoolUrn", d.fieldName AS "fieldName",
 count(*) OVER (PARTITION BY d.schoolId, d.fieldName) AS "fieldErrorCount", count(*) OVER (PARTITION BY d.schoolId) AS "totalErrorCount", d.customValue AS "customValue"
FROM d LEFT JOIN entity e ON e.id = d.schoolId""", uses=("entity", "reports"))
def report_rollup(spark, sf):
    out = agg.report_rollup(view(spark, sf, "reports"), view(spark, sf, "entity"))
    return out.select("event_id", "schoolId", "schoolName", "schoolUrn", "fieldName", "fieldErrorCount", "totalErrorCount", "customValue")


@query("agg10_score_histogram", """SELECT count(*) FILTER (completeness_score >= 80) AS excellent, count(*) FILTER (completeness_score >= 60 AND completeness_score < 80) AS good,
  count(*) FILTER (completeness_score >= 40 AND completeness_score < 60) AS fair, count(*) FILTER (completeness_score < 40) AS poor, cast(floor(avg(completeness_score) + 0.5) AS BIGINT) AS average, count(*) AS total FROM school""", uses=SCHOOL)
def score_histogram(spark, sf):
    return agg.score_histogram(schools(spark, sf))


@query("agg13_website_counters", """WITH w AS (SELECT *, trim(website) LIKE 'http%' AS ok FROM school)
SELECT count(*) AS total, count(*) FILTER (ok) AS registered, count(*) FILTER (ok AND coalesce(verified_at, '') = '' AND NOT list_has_any(tags, ['web_health_audited', 'auto_verified'])) AS unscanned,
 count(*) FILTER (ok AND NOT list_contains(tags, 'dead_website')) AS healthy, count(*) FILTER (ok AND trim(website) LIKE 'https://%') AS https, count(*) FILTER (ok AND trim(website) LIKE 'http://%') AS http,
 count(*) FILTER (ok AND list_contains(tags, 'dead_website')) AS dead FROM w""", uses=SCHOOL)
def website_counters(spark, sf):
    return agg.website_counters(schools(spark, sf))


@query("agg14_guardrail_report", """SELECT id, name, schoolType AS "schoolType", region, list_contains(tags, 'stale_dates_pending_recrawl') AS "isStale", list_contains(tags, 'has_anomalies') AS "isAnomaly"
FROM school WHERE list_has_any(tags, ['stale_dates_pending_recrawl', 'has_anomalies']) ORDER BY id LIMIT 100""", uses=SCHOOL)
def guardrail_report(spark, sf):
    return agg.flagged(schools(spark, sf))


@query("agg15_rank_coverage", """SELECT count(*) AS total, count(*) FILTER (gcse_rank_england <= 100) AS top100_gcse, count(*) FILTER (a_level_rank_england <= 100) AS top100_alevel, count(*) FILTER (national_rank_england <= 100) AS top100_national,
 count(*) FILTER (gcse_rank_england <= 500) AS ranked_gcse, count(*) FILTER (a_level_rank_england <= 500) AS ranked_alevel, count(*) FILTER (national_rank_england <= 500) AS ranked_national FROM school""", uses=SCHOOL)
def rank_coverage(spark, sf):
    return agg.rank_coverage(schools(spark, sf))


@query("agg16_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM school) GROUP BY 1", uses=SCHOOL)
def tag_counts(spark, sf):
    return agg.tag_counts(schools(spark, sf))


@query("agg16_scan_outcomes", f"""SELECT count(*) FILTER ({d_tags('auto_verified', 'llm_enriched')}) AS verified, count(*) FILTER (len(tags) > 1) AS anomalies,
 count(*) FILTER ({d_tags('missing_website', 'dead_website')}) AS missing_websites, count(*) FILTER ({d_tags('auto_verification_data_missing')}) AS data_missing, count(*) FILTER ({d_tags('crawl_stuck')}) AS stuck FROM school""", uses=SCHOOL)
def scan_outcomes(spark, sf):
    return agg.scan_outcomes(schools(spark, sf), F.size("verification_tags") > 1)


@query("agg17_dictionary", "SELECT schoolId AS code, row_number() OVER (ORDER BY schoolId) AS code_id FROM (SELECT DISTINCT schoolId FROM audit)", uses=("audit",))
def code_dictionary(spark, sf):
    return ranking.dictionary(view(spark, sf, "audit"), "schoolId")


@query("agg19_top_exam_types", "SELECT entranceExamType AS \"entranceExamType\", count(*) AS n FROM school WHERE entranceExamType <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5", uses=SCHOOL)
def top_exam_types(spark, sf):
    return agg.top_groups(schools(spark, sf), "entranceExamType", 5)


@query("agg21_verification_summary", f"""SELECT count(*) AS total, count(*) FILTER ({d_tags('auto_verified', 'web_verified', 'llm_verified')}) AS verified, count(*) FILTER ({d_tags(*flt.PROBLEM_TAGS, 'has_anomalies')}) AS anomalies,
 count(*) FILTER ({d_tags('missing_website', 'dead_website')}) AS missing_websites, count(*) FILTER ({d_tags('auto_verification_data_missing')}) AS data_missing, cast(floor(avg(coalesce(confidence_score, 0)) + 0.5) AS BIGINT) AS mean_quality FROM school""", uses=SCHOOL)
def verification_summary(spark, sf):
    return agg.verification_summary(schools(spark, sf))


@query("agg22_key_check", """SELECT count(*) AS rows, count(DISTINCT id) AS keys, count(*) FILTER (schoolType = 'Grammar') AS grammar, count(*) FILTER (schoolType = 'Independent') AS independent, count(*) FILTER (schoolType = 'Comprehensive') AS comprehensive FROM school""", uses=SCHOOL)
def key_check(spark, sf):
    return agg.key_check(schools(spark, sf))


@query("jn16_user_overrides", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY userId, schoolId, fieldName ORDER BY reportedAt DESC, event_id DESC) AS rn FROM reports)
SELECT schoolId AS "schoolId", string_agg(fieldName || '=' || status, ',' ORDER BY fieldName) AS states,
 coalesce(string_agg(fieldName || '=' || customValue, ',' ORDER BY fieldName) FILTER (status = 'down' AND customValue <> ''), '') AS customs FROM l WHERE rn = 1 AND userId = 7 GROUP BY 1""", uses=("reports",))
def user_overrides(spark, sf):
    last = ranking.latest(view(spark, sf, "reports"), ["userId", "schoolId", "fieldName"], ["reportedAt", "event_id"])
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return agg.user_overrides(last, 7).select("schoolId", flat("userReports").alias("states"), flat("userCustomOverrides").alias("customs"))


@query("win01_rank_allocation", """
WITH u AS (SELECT *, CASE WHEN contains(lower(schoolType), 'grammar') THEN 1 WHEN schoolType = 'Independent' AND (ageRange LIKE '%18%' OR ageRange LIKE '%16%' OR pupilCount >= 200) THEN 2
   WHEN schoolType = 'Comprehensive' AND (ofstedRating = 'Outstanding' OR coalesce(gcseAttainment8 >= 55, false) OR coalesce(gcseProgress8 >= 0.5, false)) THEN 3 END AS tier FROM school
   WHERE NOT coalesce(least(gcse_rank_england, a_level_rank_england, national_rank_england) <= 100, false)),
o AS (SELECT *, row_number() OVER (ORDER BY tier, CASE tier WHEN 1 THEN coalesce(gcseAttainment8, 70) WHEN 2 THEN CASE WHEN lower(ofstedRating) LIKE '%excellent%' THEN 3 WHEN ofstedRating = 'Outstanding' THEN 2 ELSE 1 END
   ELSE coalesce(gcseAttainment8, CASE WHEN ofstedRating = 'Outstanding' THEN 65 ELSE 55 END) END DESC, CASE tier WHEN 1 THEN 0 ELSE pupilCount END DESC, name, id) + 100 AS r FROM u WHERE tier IS NOT NULL)
SELECT id, tier, r AS national_rank_england, least(500, greatest(101, r + r % 5 - 2)) AS gcse_rank_england, least(500, greatest(101, r - r % 5 + 2)) AS a_level_rank_england FROM o WHERE r <= 500""", uses=SCHOOL)
def rank_allocation(spark, sf):
    return ranking.allocate_ranks(schools(spark, sf), jitter=True)


@query("win02_rank_sync", """
WITH u AS (SELECT *, CASE WHEN contains(lower(schoolType), 'grammar') THEN 1 WHEN schoolType = 'Independent' AND (ageRange LIKE '%18%' OR ageRange LIKE '%16%' OR pupilCount >= 200) THEN 2
   WHEN schoolType = 'Comprehensive' AND (ofstedRating = 'Outstanding' OR coalesce(gcseAttainment8 >= 55, false) OR coalesce(gcseProgress8 >= 0.5, false)) THEN 3 END AS tier FROM school
   WHERE NOT coalesce(least(gcse_rank_england, a_level_rank_england, national_rank_england) <= 100, false)),
o AS (SELECT *, row_number() OVER (ORDER BY tier, CASE tier WHEN 1 THEN coalesce(gcseAttainment8, 70) WHEN 2 THEN CASE WHEN lower(ofstedRating) LIKE '%excellent%' THEN 3 WHEN ofstedRating = 'Outstanding' THEN 2 ELSE 1 END
   ELSE coalesce(gcseAttainment8, CASE WHEN ofstedRating = 'Outstanding' THEN 65 ELSE 55 END) END DESC, CASE tier WHEN 1 THEN 0 ELSE pupilCount END DESC, name, id) + 100 AS r FROM u WHERE tier IS NOT NULL)
SELECT s.id, CASE WHEN top THEN s.gcse_rank_england WHEN r IS NOT NULL THEN r WHEN high THEN NULL ELSE s.gcse_rank_england END AS gcse_rank_england,
 CASE WHEN top THEN s.a_level_rank_england WHEN r IS NOT NULL THEN r WHEN high THEN NULL ELSE s.a_level_rank_england END AS a_level_rank_england,
 CASE WHEN top THEN s.national_rank_england WHEN r IS NOT NULL THEN r WHEN high THEN NULL ELSE s.national_rank_england END AS national_rank_england
FROM (SELECT *, coalesce(least(gcse_rank_england, a_level_rank_england, national_rank_england) <= 100, false) AS top,
  coalesce(greatest(gcse_rank_england, a_level_rank_england, national_rank_england) > 100, false) AS high FROM school) s LEFT JOIN (SELECT id, r FROM o WHERE r <= 500) n ON n.id = s.id""", uses=SCHOOL)
def rank_sync(spark, sf):
    return ranking.sync_ranks(schools(spark, sf)).select("id", *ranking.RANKS)


@query("win04_latest_change", "SELECT schoolId AS \"schoolId\", max(id) AS id, arg_max(actionType, id) AS \"actionType\" FROM audit GROUP BY 1", uses=("audit",))
def latest_change(spark, sf):
    return ranking.latest(view(spark, sf, "audit"), ["schoolId"], ["id"]).select("schoolId", "id", "actionType")


@query("top03_typeahead", """
WITH e AS (SELECT trim(la) AS name, 'Borough' AS type, region AS subtitle, 1 AS priority, 3 AS claim, id FROM school WHERE trim(la) <> ''
 UNION ALL SELECT upper(split_part(trim(postcode), ' ', 1)), 'Postcode Area', CASE WHEN la <> '' THEN la || ' (' || region || ')' ELSE region END, 3, 1, id FROM school WHERE trim(postcode) <> ''
 UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{n}', 'Area / Town', '{s}', 2, 2, '')" for n, s in search.KEY_AREAS) + """) v),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY claim DESC, id) AS rn FROM e) WHERE rn = 1)
SELECT name, type, subtitle, priority FROM b WHERE contains(lower(name), 'en') OR contains(lower(subtitle), 'en')
ORDER BY CASE WHEN lower(name) LIKE 'en%' THEN 0 ELSE 1 END, priority, length(name), name LIMIT 10""", uses=SCHOOL)
def typeahead(spark, sf):
    return search.suggest(search.location_index(schools(spark, sf)), " EN")


@query("top04_work_queue", f"""
SELECT id, verification_status, verified_at FROM school WHERE verification_status <> 'llm_enriched' AND NOT {d_like('llm_enriched', 'llm_verified')}
  AND (coalesce(trim(verified_at), '') = '' OR verified_at < '2026-09-05T00:00:00.000Z') AND schoolType = 'Comprehensive'
ORDER BY CASE WHEN coalesce(trim(verified_at), '') = '' AND verification_status IN ('unverified', 'unscanned') THEN 0 WHEN NOT {d_like(*flt.ENRICHED_TAGS)} THEN 1
  WHEN coalesce(trim(verified_at), '') = '' THEN 2 WHEN verification_status = 'has_anomalies' THEN 3 ELSE 4 END, verified_at NULLS FIRST, id LIMIT 50""", uses=SCHOOL)
def work_queue(spark, sf):
    return flt.work_queue(schools(spark, sf), "STATE_COMPREHENSIVE", AS_OF).select("id", "verification_status", "verified_at")


@query("top05_top_ranked", "SELECT id, name, postcode, schoolType AS \"schoolType\", gcse_rank_england, a_level_rank_england, national_rank_england FROM school WHERE gcse_rank_england IS NOT NULL ORDER BY gcse_rank_england, id LIMIT 10", uses=SCHOOL)
def top_ranked(spark, sf):
    return ranking.top_ranked(schools(spark, sf), "gcse_rank_england")


def d_words(c):
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_END = "|".join(search.ENDINGS)


@query("txt01_text_search", f"""
WITH w AS (SELECT doc_id, list_transform({d_words('text')}, lambda t: regexp_replace(t, '^(.{{3,64}}?)({_END})$', '\\1')) AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda t: t = 'that')) AS a, len(list_filter(ws, lambda t: t LIKE 'ther%')) AS b FROM w)
SELECT doc_id, a + b AS score FROM c WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def text_search(spark, sf):
    return search.search(table(spark, sf, "documents"), "That, ther", "doc_id", ["text"])


@query("txt01_search_index", f"""
WITH w AS (SELECT doc_id, unnest(list_transform({d_words('text')}, lambda t: regexp_replace(t, '^(.{{3,64}}?)({_END})$', '\\1'))) AS term FROM documents)
SELECT term, doc_id, count(*) AS hits FROM w GROUP BY 1, 2""")
def search_index(spark, sf):
    return search.token_table(table(spark, sf, "documents"), "doc_id", ["text"])


@query("txt02_contains_search", "SELECT id, name FROM school WHERE contains(lower(name), 'gear') OR contains(lower(la), 'gear') OR contains(lower(postcode), 'gear') ORDER BY id LIMIT 50", uses=SCHOOL)
def contains_search(spark, sf):
    return search.contains_search(schools(spark, sf), "GEAR").select("id", "name")


@query("agg20_location_index", """
WITH e AS (SELECT trim(la) AS name, 'Borough' AS type, region AS subtitle, 1 AS priority, 3 AS claim, id FROM school WHERE trim(la) <> ''
 UNION ALL SELECT upper(split_part(trim(postcode), ' ', 1)), 'Postcode Area', CASE WHEN la <> '' THEN la || ' (' || region || ')' ELSE region END, 3, 1, id FROM school WHERE trim(postcode) <> ''
 UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{n}', 'Area / Town', '{s}', 2, 2, '')" for n, s in search.KEY_AREAS) + """) v),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY claim DESC, id) AS rn FROM e) WHERE rn = 1)
SELECT name, type, subtitle, priority FROM b""", uses=SCHOOL)
def location_index(spark, sf):
    return search.location_index(schools(spark, sf))


@query("top06_health_queue", """SELECT id, website, verified_at FROM school WHERE trim(website) LIKE 'http%'
ORDER BY CASE WHEN coalesce(verified_at, '') = '' AND NOT list_has_any(tags, ['web_health_audited', 'auto_verified']) THEN 0 ELSE 1 END, verified_at NULLS FIRST, id LIMIT 50""", uses=SCHOOL)
def health_queue(spark, sf):
    return flt.health_queue(schools(spark, sf)).select("id", "website", "verified_at")


@query("scl26_format_keys", """SELECT id, concat(CASE WHEN primary_exam_type_id IS NOT NULL THEN 'T:' || primary_exam_type_id WHEN trim(entranceExamType) <> '' THEN 'TN:' || lower(trim(entranceExamType)) ELSE 'T:none' END, '|',
 CASE WHEN exam_consortium_id IS NOT NULL THEN 'C:' || exam_consortium_id ELSE 'CN:' || CASE WHEN lower(trim(coalesce(exam_consortium, ''))) IN ('', 'none', 'null', 'na') THEN 'none' ELSE lower(trim(exam_consortium)) END END) AS format_key,
 CASE WHEN lower(trim(coalesce(exam_consortium, ''))) NOT IN ('', 'none', 'null', 'na') THEN exam_consortium WHEN entranceExamType <> '' AND lower(entranceExamType) <> 'none' THEN entranceExamType ELSE '' END AS label FROM school""", uses=SCHOOL)
def format_keys(spark, sf):
    from dirwise.operators import scoring

    return schools(spark, sf).select("id", scoring.format_key().alias("format_key"), scoring.format_label().alias("label"))


@query("src02_point_lookup", "SELECT id, name, urn FROM school WHERE id = 'e000000042' LIMIT 1", uses=SCHOOL)
def point_lookup(spark, sf):
    return search.point_lookup(schools(spark, sf), "id", "e000000042").select("id", "name", "urn")


@query("src09_open_register", "SELECT URN AS urn, SCHNAME AS name FROM register WHERE ISSECONDARY = '1' AND SCHSTATUS = 'Open'", uses=("register",))
def open_register(spark, sf):
    from dirwise.operators.link import open_secondary

    return open_secondary(view(spark, sf, "register")).select(F.col("URN").alias("urn"), F.col("SCHNAME").alias("name"))
