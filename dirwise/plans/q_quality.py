"""Guard rules, canonical forms, payloads, page checks, enrichment and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirwise.functions import markup
from dirwise.operators import enrich, quality, verify
from dirwise.plans.fixtures import CTES, entities, table, view
from dirwise.plans.q_directory import SCHOOL, schools
from dirwise.plans.q_scalars import _LONG, d_admissions, d_better, d_roll, d_timeline
from dirwise.plans.registry import query
from dirwise.sources import seeds

AS_OF = "2026-09-15T00:00:00Z"

_CHRONO = f"""
d AS (SELECT id, {d_admissions("nullif(d_registrationDeadline, '')")} AS dl, {d_admissions("nullif(d_examDate, '')")} AS ex, {d_admissions("nullif(d_resultsDate, '')")} AS rs,
  {d_admissions("nullif(d_offersAcceptance, '')")} AS ofr, {d_admissions("nullif(d_acceptanceDeadline, '')")} AS ac,
  regexp_matches(concat_ws(' ', d_registrationDeadline, d_examDate, d_resultsDate, d_offersAcceptance, d_acceptanceDeadline), '\\b(2022|2023|2024|2025)\\b') AS stale FROM entity),
c AS (SELECT id, coalesce(dl > ex, false) OR coalesce(ex > rs, false) OR coalesce(ofr > ac, false) AS wrong, stale FROM d)"""


@query("dq01_chronology", f"WITH {_CHRONO} SELECT id, wrong AS out_of_order, stale FROM c", uses=("entity",))
def chronology(spark, sf):
    return quality.chronology(entities(spark, sf)).select("id", "out_of_order", "stale")


@query("dq02_guarded_rows", f"""WITH {_CHRONO}
SELECT s.id, array_to_string(list_concat(tags, list_concat(CASE WHEN wrong AND NOT list_contains(tags, 'has_anomalies') THEN ['has_anomalies'] ELSE [] END, CASE WHEN stale THEN ['stale_dates_pending_recrawl'] ELSE [] END)), '|') AS tags,
 CASE WHEN stale THEN 'unverified' ELSE verification_status END AS verification_status, CASE WHEN NOT stale THEN verified_at END AS verified_at,
 CASE WHEN schoolType IN ('Grammar', 'Comprehensive') AND feesTermly <> '' THEN NULL ELSE feesTermly END AS "feesTermly",
 CASE WHEN schoolType = 'Comprehensive' THEN 'No' ELSE second_stage_exam_required END AS second_stage,
 cast(CASE WHEN schoolType IN ('Grammar', 'Comprehensive') AND feesTermly <> '' THEN 1 ELSE 0 END + CASE WHEN schoolType = 'Comprehensive' AND second_stage_exam_required <> 'No' THEN 1 ELSE 0 END AS INT) AS fixes
FROM school s JOIN c USING (id)""", uses=SCHOOL)
def guarded_rows(spark, sf):
    return quality.guard(schools(spark, sf)).select(
        "id", F.array_join("verification_tags", "|").alias("tags"), "verification_status", "verified_at", "feesTermly",
        F.col("second_stage_exam_required").alias("second_stage"), "fixes")


@query("dq04_standard_rows", """
WITH p AS (SELECT *, upper(regexp_replace(coalesce(postcode, ''), '\\s+', '', 'g')) AS c, lower(trim(gender)) AS g, try_cast(nullif(regexp_extract(replace(coalesce(feesTermly, ''), ',', ''), '[0-9]+'), '') AS BIGINT) AS n FROM entity)
SELECT id, CASE WHEN postcode IS NULL OR postcode = '' THEN postcode WHEN length(c) NOT BETWEEN 5 AND 8 THEN trim(postcode) ELSE left(c, length(c) - 3) || ' ' || right(c, 3) END AS postcode,
 CASE WHEN gender = '' THEN gender WHEN g LIKE 'boy%' OR g = 'male' THEN 'Boys' WHEN g LIKE 'girl%' OR g = 'female' THEN 'Girls' ELSE 'Mixed' END AS gender, CASE WHEN n BETWEEN 200 AND 50000 THEN n END AS fees_termly_gbp FROM p""", uses=("entity",))
def standard_rows(spark, sf):
    return quality.standardize(view(spark, sf, "entity")).select("id", "postcode", "gender", "fees_termly_gbp")


@query("dq25_moved_dates", f"SELECT id, substr(field, 3) AS field, v AS old, s6 AS new FROM ({d_roll(_LONG, 'id, field, v')}) WHERE n6 > 0", uses=("entity",))
def moved_dates(spark, sf):
    return quality.roll_dates(entities(spark, sf))[1]


@query("dq25_dropped_reviews", """SELECT r.schoolId AS "schoolId", r.fieldName AS "fieldName", r.reviewedBy AS "reviewedBy" FROM reviews r
 WHERE NOT EXISTS (SELECT 1 FROM entity e WHERE e.id = r.schoolId AND ((e.k % 2 = 0 AND r.fieldName = 'website') OR (e.k % 3 = 0 AND r.fieldName = 'phone')))""", uses=("entity", "reviews"))
def dropped_reviews(spark, sf):
    k = F.col("k")
    fields = F.array_compact(F.array(F.when(k % 2 == 0, F.lit("website")), F.when(k % 3 == 0, F.lit("phone"))))
    return quality.drop_reviews(view(spark, sf, "reviews"), view(spark, sf, "entity").withColumn("fields", fields)).select("schoolId", "fieldName", "reviewedBy")


@query("dq21_cleared_test_rows", """
WITH e AS (SELECT id, k, CASE WHEN k % 40 = 3 THEN name || ' Test' WHEN k % 40 = 4 THEN 'Ingatestone Test Hall' ELSE name END AS name, CASE WHEN k % 50 = 6 THEN 'http://testschool.org' ELSE coalesce(website, '') END AS website,
   CASE WHEN k % 60 = 1 THEN '999999' ELSE coalesce(urn, '') END AS urn, verification_status FROM entity WHERE k % 70 <> 5)
SELECT id, CASE WHEN k % 40 = 3 THEN '' ELSE name END AS name, CASE WHEN k % 50 = 6 THEN '' ELSE website END AS website, CASE WHEN trim(urn) IN ('N/A','100100','999888','999999','999111222','123456','000000','111111') THEN '' ELSE urn END AS urn,
 CASE WHEN k % 40 = 3 OR k % 50 = 6 THEN 'unverified' ELSE verification_status END AS verification_status FROM e""", uses=("entity",))
def cleared_test_rows(spark, sf):
    k = F.col("k")
    e = schools(spark, sf).withColumns({
        "name": F.when(k % 40 == 3, F.concat("name", F.lit(" Test"))).when(k % 40 == 4, "Ingatestone Test Hall").otherwise(F.col("name")),
        "website": F.when(k % 50 == 6, "http://testschool.org").otherwise(F.col("website")), "urn": F.when(k % 60 == 1, "999999").otherwise(F.col("urn")),
        "id": F.when(k % 70 == 5, F.concat(F.lit("temp_test_school_"), "id")).otherwise(F.col("id"))})
    return quality.clear_test_values(e).select("id", "name", "website", "urn", "verification_status")


@query("dq15_website_verdicts", """
WITH f AS (SELECT id, CASE k % 7 WHEN 0 THEN 'healthy' WHEN 1 THEN 'redirect' WHEN 2 THEN 'not_found' WHEN 3 THEN 'timeout' WHEN 4 THEN 'active_with_warning' WHEN 5 THEN 'redirect' END AS st FROM entity WHERE k % 7 <> 6)
SELECT s.id, CASE WHEN st = 'redirect' AND trim(website) LIKE 'http://%' THEN 'https://new.example.org/' || s.id WHEN st IS NOT NULL AND website <> '' THEN trim(website) ELSE website END AS website,
 CASE WHEN st IS NULL OR website = '' THEN NULL WHEN st = 'redirect' AND trim(website) LIKE 'http://%' THEN 'Auto-Upgraded to HTTPS' WHEN st = 'redirect' THEN 'Redirect Verified' WHEN st IN ('not_found', 'timeout') THEN 'Tagged dead_website' ELSE 'Verified Clean' END AS action,
 array_to_string(list_concat(list_concat(tags, CASE WHEN st IS NOT NULL AND website <> '' THEN ['web_health_audited'] ELSE [] END), CASE WHEN st IN ('not_found', 'timeout') AND website <> '' AND NOT list_contains(tags, 'dead_website') THEN ['dead_website'] ELSE [] END), '|') AS tags
FROM school s LEFT JOIN f USING (id)""", uses=SCHOOL)
def website_verdicts(spark, sf):
    s = schools(spark, sf)
    k = F.col("k") % 7
    code = F.when(k == 0, 200).when(k.isin(1, 5), 301).when(k == 2, 404).when(k == 4, 503).otherwise(0)
    fetched = s.filter("k % 7 <> 6").select("id", quality.fetch_state(
        code, F.when(k.isin(1, 5), "x"), F.when(k == 3, "ETIMEDOUT")).alias("status"), F.concat(F.lit("https://new.example.org/"), "id").alias("redirectUrl"))
    return quality.website_verdicts(s, fetched, AS_OF).select("id", "website", "action", F.array_join("verification_tags", "|").alias("tags"))


# Payloads: one JSON text per entity, with aliases, junk and gaps.
PAYLOAD = """
SELECT id, k, concat('{"gender":"', CASE k % 4 WHEN 0 THEN 'Mixed' WHEN 1 THEN 'Girls' WHEN 2 THEN 'unknown' ELSE 'Boys' END, '","type":"Grammar","examBoard":" GL Assessment ","website":"',
  CASE k % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'www.x' ELSE concat('https://p', cast(k AS STRING), '.org') END, '","email":"', CASE k % 3 WHEN 0 THEN 'nobody' ELSE 'a@b.org' END,
  '","address":"', CASE k % 3 WHEN 0 THEN 'Kent' WHEN 1 THEN '5 New Road, Kent, Britain' ELSE 'N/A' END, '","postcode":"en5 4dq","confidenceScore":"', cast((k * 7) % 140 AS STRING),
  '","national_rank_england":', cast(k % 50 - 5 AS STRING), ',"entranceExamDates":{"examDate":"', d_examDate, '","registrationCloses":"1 July 2026"}}') AS payload FROM entity WHERE k % 6 <> 4
"""
CTES["payload"] = PAYLOAD


def payload_rows(spark, sf):
    view(spark, sf, "entity").createOrReplaceTempView("entity")
    return spark.sql(PAYLOAD)


@query("dq23_read_payloads", """
SELECT id, CASE k % 4 WHEN 0 THEN 'Mixed' WHEN 1 THEN 'Girls' WHEN 3 THEN 'Boys' END AS gender, 'GL Assessment' AS "entranceExamType", CASE WHEN k % 5 > 1 THEN 'https://p' || k || '.org' END AS website,
 CASE WHEN k % 3 <> 0 THEN 'a@b.org' END AS email, CASE k % 3 WHEN 0 THEN 'Kent' WHEN 1 THEN '5 New Road, Kent, Britain' END AS address, 'EN5 4DQ' AS postcode,
 cast(greatest(70, least(100, CASE WHEN (k * 7) % 140 = 0 THEN 95 ELSE (k * 7) % 140 END)) AS INT) AS "confidenceScore", CASE WHEN k % 50 > 5 THEN cast(k % 50 - 5 AS INT) END AS national_rank_england FROM payload""", uses=("entity", "payload"))
def read_payloads(spark, sf):
    p = quality.read_payload(payload_rows(spark, sf), "payload")
    return p.select("id", "gender", "entranceExamType", "website", "email", "address", "postcode", "confidenceScore", "national_rank_england")


_PAY = f"""
p AS (SELECT e.*, p.id IS NOT NULL AS has, CASE k % 4 WHEN 0 THEN 'Mixed' WHEN 1 THEN 'Girls' WHEN 3 THEN 'Boys' END AS pg, CASE WHEN k % 5 > 1 THEN 'https://p' || k || '.org' END AS pw, CASE WHEN k % 3 <> 0 THEN 'a@b.org' END AS pe,
   CASE k % 3 WHEN 0 THEN 'Kent' WHEN 1 THEN '5 New Road, Kent, Britain' END AS pa, greatest(70, least(100, CASE WHEN (k * 7) % 140 = 0 THEN 95 ELSE (k * 7) % 140 END)) AS pc, CASE WHEN k % 50 > 5 THEN k % 50 - 5 END AS pr
 FROM school e LEFT JOIN (SELECT id FROM payload) p USING (id)),
t AS (SELECT *, has AND pg IS NOT NULL AND (trim(gender) IN ('', 'N/A') OR (trim(gender) <> pg AND NOT (trim(gender) IN ('Boys', 'Girls') AND pg = 'Mixed' AND NOT (pc >= 95 AND pw IS NOT NULL)))) AS tg,
  has AND pw IS NOT NULL AND trim(website) <> coalesce(pw, '') AS tw, has AND pe IS NOT NULL AND trim(email) <> coalesce(pe, '') AS te, has AND pa IS NOT NULL AND {d_better('address', 'pa')} AS ta FROM p)"""


@query("dq24_applied_payloads", f"""WITH {_PAY}
SELECT id, CASE WHEN tg THEN pg ELSE gender END AS gender, CASE WHEN tw THEN pw ELSE website END AS website, CASE WHEN te THEN pe ELSE email END AS email, CASE WHEN ta THEN pa ELSE address END AS address,
 CASE WHEN has THEN 'EN5 4DQ' ELSE postcode END AS postcode, CASE WHEN has AND pr IS NOT NULL THEN cast(pr AS INT) ELSE national_rank_england END AS national_rank_england, tg AS took_gender, ta AS took_address FROM t""", uses=(*SCHOOL, "payload"))
def applied_payloads(spark, sf):
    p = quality.read_payload(payload_rows(spark, sf), "payload")
    out = quality.apply_payload(schools(spark, sf), p, AS_OF)
    has = lambda c: F.array_contains("updated", c)
    up = F.when(F.upper(F.trim("postcode")) == "EN5 4DQ", "EN5 4DQ").otherwise(F.col("postcode"))
    return out.select("id", "gender", "website", "email", "address", up.alias("postcode"), "national_rank_england", has("gender").alias("took_gender"), has("address").alias("took_address"))


@query("dq11_valid_payloads", """
SELECT id, NOT (k % 9 = 3 OR (k % 9 <> 3 AND k % 7 = 2) OR k % 11 = 4 OR k % 13 = 5) AS valid FROM entity""", uses=("entity",))
def valid_payloads(spark, sf):
    k = F.col("k")
    dates = F.create_map(F.lit("examDate"), F.when(k % 7 == 2, F.repeat(F.lit("x"), 121)).otherwise("1 May"), F.lit("stage_one_format"), F.repeat(F.lit("y"), 250))
    v = quality.validate(F.when(k % 9 == 3, "  ").otherwise(F.col("name")), dates, F.when(k % 11 == 4, "nodots").otherwise("N/A"), F.when(k % 13 == 5, "at.sign").otherwise(""))
    return view(spark, sf, "entity").select("id", v["valid"].alias("valid"))


_NEXT = """SELECT id, CASE k % 3 WHEN 0 THEN website WHEN 1 THEN 'https://other.org' ELSE 'N/A' END AS website, CASE k % 2 WHEN 0 THEN upper(gender) ELSE 'Boys' END AS gender, CASE k % 4 WHEN 1 THEN '' ELSE phone END AS phone,
  CASE k % 5 WHEN 0 THEN lower(postcode) ELSE 'AA1 1AA' END AS postcode, CASE k % 2 WHEN 0 THEN d_examDate ELSE '1 May 2027' END AS exam FROM entity"""


def _next(spark, sf):
    view(spark, sf, "entity").createOrReplaceTempView("entity")
    return spark.sql(_NEXT).select("id", "website", "gender", "phone", "postcode", F.create_map(F.lit("examDate"), "exam").alias("entranceExamDates"))


_OLDNEW = f"""o AS (SELECT e.id, e.website AS w, e.gender AS g, e.phone AS p, e.postcode AS c, trim(e.d_examDate) AS x, n.website AS nw, n.gender AS ng, n.phone AS np, n.postcode AS nc, trim(n.exam) AS nx FROM entity e JOIN ({_NEXT}) n USING (id)),
l AS (SELECT id, 'website' AS field, w AS o, nw AS n FROM o UNION ALL SELECT id, 'gender', g, ng FROM o UNION ALL SELECT id, 'phone', p, np FROM o UNION ALL SELECT id, 'postcode', c, nc FROM o
 UNION ALL SELECT id, 'entranceExamDates.stage_one_examDate', x, nx FROM o)"""


@query("dq12_field_differences", f"""WITH {_OLDNEW}
SELECT id, field, nullif(o, '') AS "oldVal", n AS "newVal" FROM l WHERE coalesce(n, '') NOT IN ('', 'N/A', 'null') AND CASE WHEN field = 'postcode' THEN upper(coalesce(o, '')) <> upper(n) ELSE coalesce(o, '') <> n END""", uses=("entity",))
def field_differences(spark, sf):
    return quality.field_differences(entities(spark, sf), _next(spark, sf))


@query("dq13_confirmed_fields", f"""WITH {_OLDNEW},
f AS (SELECT id, field, o, CASE field WHEN 'website' THEN regexp_replace(lower(trim(coalesce(o, ''))), '/$', '') WHEN 'gender' THEN lower(trim(coalesce(o, ''))) WHEN 'phone' THEN regexp_replace(trim(coalesce(o, '')), '[\\s()-]', '', 'g')
   WHEN 'postcode' THEN regexp_replace(upper(trim(coalesce(o, ''))), '\\s+', '', 'g') ELSE trim(coalesce(o, '')) END AS a,
  CASE field WHEN 'website' THEN regexp_replace(lower(trim(coalesce(n, ''))), '/$', '') WHEN 'gender' THEN lower(trim(coalesce(n, ''))) WHEN 'phone' THEN regexp_replace(trim(coalesce(n, '')), '[\\s()-]', '', 'g')
   WHEN 'postcode' THEN regexp_replace(upper(trim(coalesce(n, ''))), '\\s+', '', 'g') ELSE trim(coalesce(n, '')) END AS b FROM l)
SELECT id, field, o AS value FROM f WHERE a = b AND a NOT IN ('', 'n/a') AND NOT (field LIKE 'entrance%' AND a IN ('TBC', 'N/A', 'null')) AND NOT (field = 'postcode' AND a = 'N/A')""", uses=("entity",))
def confirmed_fields(spark, sf):
    return quality.confirmed_fields(entities(spark, sf), _next(spark, sf))


@query("dq14_saved_tags", """SELECT id, array_to_string(CASE WHEN verification_status IN ('missing_website', 'crawl_stuck') THEN list_filter(tags, lambda t: t NOT IN ('llm_enriched', 'llm_verified', 'auto_verified')) ELSE tags END, '|') AS tags FROM school""", uses=SCHOOL)
def saved_tags(spark, sf):
    st = F.when(F.col("verification_status") == "missing_website", "llm_error").when(F.col("verification_status") == "crawl_stuck", "http 429").otherwise(F.col("verification_status"))
    return schools(spark, sf).select("id", F.array_join(quality.saved_status(st, F.col("verification_tags")), "|").alias("tags"))


# ---- pages -------------------------------------------------------------------------------------

# Fetched pages of entities: every given page, with the texts an own site would hold added to most.
SITE = """
SELECT e.id, e.k, p.page_id, p.url, e.name, e.phone, e.email, e.postcode, e.la, e.address, e.gender, e.entranceExamType, e.d_examDate, e.d_resultsDate, e.d_registrationDeadline,
  replace(p.html, '</article>', concat('<p>', CASE e.k % 5 WHEN 0 THEN 'This domain is for sale.' WHEN 1 THEN concat('Welcome to ', e.name, '.') WHEN 2 THEN concat('<H1 class="t">', e.name, ' &amp; Friends</H1>') ELSE '' END,
    CASE e.k % 4 WHEN 0 THEN concat(' Call 020 8', lpad(cast(e.k % 1000000 AS STRING), 3, '0'), ' 4567 or 01234 567890, office@e', cast(e.k AS STRING), '.sch.uk or ADMIN@e', cast(e.k AS STRING), '.sch.uk, ', coalesce(e.postcode, ''), '.') WHEN 1 THEN ' Call 020 7946 0123. EN5 4DQ' ELSE '' END,
    CASE e.k % 3 WHEN 0 THEN ' Admissions: the registration deadline is Friday 13 November 2026. Our entrance exam takes place on 9 January. Results will be emailed by 12 February 2027. National Offer Day 1 March 2027.' WHEN 1 THEN ' How to apply: apply by 31st October. Interviews 16 January 2027.' ELSE '' END,
    CASE e.k % 7 WHEN 0 THEN ' We use the GL Assessment papers. A school for boys.' WHEN 1 THEN ' ISEB Common Pre-Test. Girls only.' WHEN 2 THEN ' We are non-selective and co-educational.' ELSE '' END,
    CASE e.k % 2 WHEN 0 THEN ' <a href="/news">News</a> <a class="b" href="/our-admissions.html">Join <b>us</b></a>' ELSE ' <a href="https://other.example.org/how-to-apply?x=1">Apply</a>' END, '</p></article>')) AS html
FROM pages p JOIN entity e ON e.k = p.page_id * 3 + 1
"""
CTES["site"] = SITE
CTES["seen"] = """
SELECT *, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) AS title,
 trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
   '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\\s+', ' ', 'g')) AS body,
 list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda h: trim(regexp_replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '\\s+', ' ', 'g'))) AS headings FROM site
"""
CTES["found"] = f"""
SELECT *, list_filter(list_transform(regexp_extract_all(body, '{markup.PHONE_TEXT}'), lambda p: trim(p)), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 13) AS phones,
 list_filter(list_transform(regexp_extract_all(body, '{markup.EMAIL_TEXT}'), lambda m: lower(m)), lambda m: NOT contains(m, 'example.com') AND NOT contains(m, 'wixpress.com') AND NOT contains(m, 'schema.org')) AS emails,
 list_transform(regexp_extract_all(body, '{markup.POSTCODE_TEXT}'), lambda p: regexp_replace(upper(p), '\\s+', ' ', 'g')) AS postcodes, lower(concat_ws(' ', title, '', array_to_string(headings, ' '), body)) AS low FROM seen
"""
SEEN = ("entity", "site", "seen", "found")


def sites(spark, sf):
    view(spark, sf, "entity").createOrReplaceTempView("entity")
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    s = spark.sql(SITE)
    return s.withColumn("entranceExamDates", F.create_map(F.lit("examDate"), "d_examDate", F.lit("resultsDate"), "d_resultsDate", F.lit("registrationDeadline"), "d_registrationDeadline"))


@query("txt04_page_texts", """SELECT page_id, length(body) AS chars, md5(body) AS body, title, array_to_string(headings, '|') AS headings FROM seen""", uses=SEEN[:3])
def page_texts(spark, sf):
    x = verify.extract(sites(spark, sf))
    return x.select("page_id", F.length("body").alias("chars"), F.md5("body").alias("body"), "title", F.array_join("headings", "|").alias("headings"))


@query("txt06_page_contacts", """SELECT page_id, (SELECT string_agg(DISTINCT p, '|' ORDER BY p) FROM unnest(phones) t(p)) AS phones, (SELECT string_agg(DISTINCT p, '|' ORDER BY p) FROM unnest(emails) t(p)) AS emails,
 (SELECT string_agg(DISTINCT p, '|' ORDER BY p) FROM unnest(postcodes) t(p)) AS postcodes FROM found""", uses=SEEN)
def page_contacts(spark, sf):
    x = verify.extract(sites(spark, sf))
    flat = lambda c: F.nullif(F.array_join(F.array_sort(c), "|"), F.lit("")).alias(c)
    return x.select("page_id", flat("phones"), flat("emails"), flat("postcodes"))


@query("txt07_result_links", """
WITH h AS (SELECT page_id, generate_subscripts(l, 1) AS ord, unnest(l) AS u FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s+(?:[^>]*?\\s+)?href=["'']([^"''>]+)["'']', 1) AS l FROM site)),
a AS (SELECT page_id, ord, u, lower(regexp_extract(u, '://([^/?#:]*)', 1)) AS host, regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM h WHERE u LIKE 'http%'),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, host ORDER BY ord) AS rn FROM a)
SELECT s.page_id, coalesce(string_agg('https://' || host || CASE WHEN path = '/' THEN '' ELSE path END, '|' ORDER BY ord), '') AS links FROM site s LEFT JOIN f ON f.page_id = s.page_id AND rn = 1 GROUP BY 1""", uses=SEEN[:2])
def result_links(spark, sf):
    return sites(spark, sf).select("page_id", F.array_join(markup.result_links("html"), "|").alias("links"))


@query("txt08_subpage_links", """SELECT page_id, CASE WHEN k % 2 = 0 THEN regexp_extract(url, '^https?://[^/?#]*') || '/our-admissions.html' ELSE 'https://other.example.org/how-to-apply?x=1' END AS link FROM site""", uses=SEEN[:2])
def subpage_links(spark, sf):
    return sites(spark, sf).select("page_id", markup.subpage_link("html", "url").alias("link"))


@query("txt10_page_milestones", "SELECT page_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN m{i} <> '' THEN '{k}=' || m{i} || CASE WHEN regexp_matches(m{i}, '\\b202[4567]\\b') THEN '' WHEN regexp_matches(m{i}, '{verify.AUTUMN}') THEN ' 2026' WHEN regexp_matches(m{i}, '{verify.SPRING}') THEN ' 2027' ELSE '' END END"
    for i, k in enumerate(sorted(verify.MILESTONE_MARKS))) + ") AS milestones FROM (SELECT page_id, " + ", ".join(
    f"trim(regexp_extract(body, '{verify.milestone_pattern(k)}', 1)) AS m{i}" for i, k in enumerate(sorted(verify.MILESTONE_MARKS))) + " FROM seen)", uses=SEEN[:3])
def page_milestones(spark, sf):
    x = verify.extract(sites(spark, sf)).select("page_id", F.array_sort(F.map_entries(verify.milestones_seen())).alias("m"))
    return x.select("page_id", F.array_join(F.transform("m", lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("milestones"))


_STOP = ", ".join(f"'{w}'" for w in verify.COMMON_WORDS)


def d_keys(c):
    long = f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)"
    tell = f"list_filter({long}, lambda w: w NOT IN ({_STOP}))"
    return f"CASE WHEN len({tell}) > 0 THEN {tell} ELSE {long} END"


_RATIO = f"f AS (SELECT *, {d_keys('name')} AS ks FROM found), r AS (SELECT *, CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda w: contains(low, w))) * 1.0 / len(ks) ELSE 1 END AS ratio FROM f)"


@query("dq05_page_identity", f"""WITH {_RATIO},
v AS (SELECT *, regexp_matches(low, '{verify.PARKED}') AS parked, NOT (contains(low, lower(trim(name))) OR (ratio >= 0.5 AND len(ks) > 0)) AND len(ks) > 0 AS wrong FROM r)
SELECT page_id, NOT parked AND NOT wrong AS valid, cast(CASE WHEN parked THEN 0 WHEN wrong THEN floor(ratio * 100 + 0.5) ELSE floor(greatest(ratio * 100, 90) + 0.5) END AS BIGINT) AS "matchScore" FROM v""", uses=SEEN)
def page_identity(spark, sf):
    return verify.identity(verify.extract(sites(spark, sf))).select("page_id", "valid", "matchScore")


@query("dq06_candidate_pages", f"""WITH {_RATIO},
v AS (SELECT *, contains(low, lower(name)) AS exact, regexp_replace(upper(coalesce(postcode, '')), '\\s+', '', 'g') AS code, upper(split_part(trim(coalesce(postcode, '')), ' ', 1)) AS oc,
  list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(address, '')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP})) AS aw, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS tel, lower(split_part(coalesce(email, ''), '@', 2)) AS dom FROM r),
w AS (SELECT *, code <> '' AND (len(list_filter(postcodes, lambda p: replace(p, ' ', '') = code)) > 0 OR contains(low, lower(code)) OR (oc <> '' AND contains(low, lower(oc)))) AS place, coalesce(la, '') <> '' AND contains(low, lower(la)) AS district,
  len(aw) > 0 AND len(list_filter(aw, lambda x: contains(low, x))) * 1.0 / greatest(len(aw), 1) >= 0.5 AS street,
  length(tel) >= 7 AND len(list_filter(phones, lambda p: contains(regexp_replace(p, '[^0-9]', '', 'g'), tel) OR contains(tel, regexp_replace(p, '[^0-9]', '', 'g')) OR right(regexp_replace(p, '[^0-9]', '', 'g'), 8) = right(tel, 8))) > 0 AS ph,
  dom <> '' AND len(list_filter(emails, lambda e: contains(e, dom))) > 0 AS mail FROM v),
h AS (SELECT *, NOT regexp_matches(low, '{verify.PARKED_OR_LIST}') AND (exact OR ratio >= 0.5) AS base, (exact OR ratio >= 0.75) AND (place OR district OR street OR ph OR mail) AS high, (exact OR ratio >= 0.6) AND (place OR district OR street) AND (ph OR mail) AS fair FROM w)
SELECT page_id, base AND (high OR fair) AS "isMatch", CASE WHEN base AND (high OR fair) THEN CASE WHEN high THEN 92 ELSE 85 END END AS "confidenceScore" FROM h""", uses=SEEN)
def candidate_pages(spark, sf):
    return verify.candidate_match(verify.extract(sites(spark, sf))).select("page_id", "isMatch", "confidenceScore")


@query("dq07_contact_mismatches", """
WITH v AS (SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS tel, lower(trim(coalesce(email, ''))) AS mail, regexp_replace(upper(coalesce(postcode, '')), '\\s+', '', 'g') AS code FROM found)
SELECT page_id, concat_ws('|', CASE WHEN len(phones) > 0 AND tel <> '' AND len(list_filter(phones, lambda p: contains(regexp_replace(p, '[^0-9]', '', 'g'), tel) OR contains(tel, regexp_replace(p, '[^0-9]', '', 'g')) OR right(regexp_replace(p, '[^0-9]', '', 'g'), 8) = right(tel, 8))) = 0 THEN 'CONTACT_PHONE_MISMATCH' END,
 CASE WHEN len(emails) > 0 AND mail <> '' AND len(list_filter(emails, lambda e: e = mail OR e LIKE '%' || coalesce(nullif(split_part(mail, '@', 2), ''), '---'))) = 0 THEN 'CONTACT_EMAIL_MISMATCH' END,
 CASE WHEN len(postcodes) > 0 AND code <> '' AND len(list_filter(postcodes, lambda p: replace(p, ' ', '') = code)) = 0 THEN 'CONTACT_POSTCODE_MISMATCH' END) AS kinds FROM v""", uses=SEEN)
def contact_mismatches(spark, sf):
    x = verify.extract(sites(spark, sf))
    return x.select("page_id", F.array_join(verify.contact_mismatches(x), "|").alias("kinds"))


@query("dq08_exam_and_sex_checks", f"""
WITH s AS (SELECT *, trim(coalesce(entranceExamType, '')) AS st, lower(body) AS lb, CASE {' '.join(f"WHEN regexp_matches(lower(body), '{m}') THEN '{k}'" for k, m, _ in verify.EXAM_MARKS)} END AS ex,
   lower(concat_ws(' ', title, '', body)) AS tb FROM seen),
x AS (SELECT *, CASE WHEN regexp_matches(tb, '{verify.BOTH}') THEN 'Mixed' WHEN regexp_matches(tb, '{verify.BOYS_ONLY.replace("'", "''")}') AND NOT regexp_matches(tb, '{verify.MIXED_SIXTH}') THEN 'Boys'
   WHEN regexp_matches(tb, '{verify.GIRLS_ONLY.replace("'", "''")}') AND NOT regexp_matches(tb, '{verify.MIXED_SIXTH}') THEN 'Girls' END AS sx FROM s)
SELECT page_id, ex AS exam_seen, ex IS NOT NULL AND st <> '' AND NOT ({' OR '.join(f"(ex = '{k}' AND contains(st, '{w}'))" for k, _, ws in verify.EXAM_MARKS for w in ws)}) AS exam_mismatch, sx AS sex_seen,
 coalesce(sx IS NOT NULL AND trim(gender) <> '' AND lower(trim(gender)) <> lower(sx) AND ((sx = 'Girls' AND contains(lower(name), 'girls')) OR (sx = 'Boys' AND contains(lower(name), 'boys'))), false) AS sex_mismatch FROM x""", uses=SEEN[:3])
def exam_and_sex_checks(spark, sf):
    x = verify.extract(sites(spark, sf)).withColumns({"_e": verify.exam_seen(), "_s": verify.sex_seen()})
    return x.select("page_id", F.col("_e").alias("exam_seen"), verify.exam_mismatch(F.col("_e")).alias("exam_mismatch"), F.col("_s").alias("sex_seen"), verify.sex_mismatch(F.col("_s")).alias("sex_mismatch"))


def _dq10():
    okb, yb, mb, db = d_timeline("w")
    ok, y, m, d = d_timeline("v")
    keys = ("registrationDeadline", "examDate", "resultsDate")
    parts = []
    for k in sorted(verify.MILESTONE_MARKS):
        stored = f"d_{k}" if k in keys else "NULL"
        parts.append(f"SELECT id, '{k}' AS field, {stored} AS v, trim(regexp_extract(body, '{verify.milestone_pattern(k)}', 1)) AS r, adm FROM b")
    return f"""WITH b AS (SELECT *, regexp_matches(lower(body), '{verify.ADMISSIONS_TEXT}') AS adm FROM seen), l AS ({' UNION ALL '.join(parts)}),
w AS (SELECT id, field, v, r || CASE WHEN regexp_matches(r, '\\b202[4567]\\b') THEN '' WHEN regexp_matches(r, '{verify.AUTUMN}') THEN ' 2026' WHEN regexp_matches(r, '{verify.SPRING}') THEN ' 2027' ELSE '' END AS w FROM l WHERE r <> '' AND adm),
h AS (SELECT *, trim(coalesce(v, '')) NOT IN ('', 'N/A', 'null') AS has, lower(trim(v)) = lower(trim(w)) OR regexp_replace(lower(trim(v)), '[^a-z0-9_]', '', 'g') = regexp_replace(lower(trim(w)), '[^a-z0-9_]', '', 'g')
  OR ({ok} AND {okb} AND ({y}) = ({yb}) AND ({m}) = ({mb}) AND ({d}) = ({db})) AS same FROM w)
SELECT id, field, CASE WHEN has THEN v ELSE 'N/A' END AS "dbValue", w AS "webValue", CASE WHEN has AND same THEN 'verified' WHEN has THEN 'discrepancy' ELSE 'enrichment' END AS status FROM h
UNION ALL SELECT id, 'entranceExamDates', NULL, NULL, 'data_missing' FROM b WHERE NOT adm"""


@query("dq10_milestone_verdicts", _dq10(), uses=SEEN[:3])
def milestone_verdicts(spark, sf):
    return verify.milestone_verdicts(verify.extract(sites(spark, sf)))


@query("txt09_register_pages", """SELECT URN AS urn, CASE GENDER WHEN 'Boys' THEN 'Boys' WHEN 'Girls' THEN 'Girls' ELSE 'Mixed' END AS gender, LANAME AS la, CASE WHEN AGELOW <> '' THEN AGELOW || '-' || AGEHIGH ELSE AGEHIGH END AS "ageRange", SCHSTATUS = 'Closed' AS "isClosed" FROM register""", uses=("register",))
def register_pages(spark, sf):
    r = view(spark, sf, "register")
    dl = lambda k, v: F.concat(F.lit(f"<dt class='k'><b>{k}</b></dt>\n<dd>"), v, F.lit("</dd>"))
    page = F.concat(F.lit("<dl>"), dl("Local authority", F.concat("LANAME", F.lit(" (301)"))), dl("Gender of entry", "GENDER"), dl("Establishment status", "SCHSTATUS"),
                    dl("Age range", F.when(F.col("AGELOW") != "", F.concat("AGELOW", F.lit(" to "), "AGEHIGH")).otherwise(F.col("AGEHIGH"))), F.lit("</dl>"))
    return r.select(F.col("URN").alias("urn"), verify.register_page(page).alias("p")).select("urn", "p.gender", "p.la", "p.ageRange", "p.isClosed")


@query("flt16_foreign_hosts", """SELECT page_id, regexp_matches(h, '(^|\\.)(gov\\.uk|x\\.com|yell\\.com)$') AS foreign_host FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'www.gov.uk' WHEN 1 THEN 'notx.com' WHEN 2 THEN 'x.com' ELSE regexp_extract(url, '://([^/?#:]*)', 1) END AS h FROM pages)""")
def foreign_hosts(spark, sf):
    i = F.col("page_id") % 4
    u = F.when(i == 0, "www.gov.uk/find").when(i == 1, "https://notx.com").when(i == 2, "http://X.com/a").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", markup.is_foreign_host(u).alias("foreign_host"))


# ---- enrichment --------------------------------------------------------------------------------

STATE_RULES = [
    {"id": "kent", "schoolKeywords": ["small ring", "Blue bolt"], "laList": ["Kent"], "examType": "11+ GL Assessment (Kent Test)", "dates": {"registrationOpen": "1 June 2026", "examDate": "10 September 2026", "secondExamDate": None}},
    {"id": "sutton", "schoolKeywords": ["red widget"], "laList": ["Sutton", "Trafford"], "examType": "11+ Sutton SET", "dates": {"registrationOpen": "5 May 2026"}},
]
INDEPENDENT_RULES = [{"id": "iseb", "schoolKeywords": ["gear", "green"], "examType": "11+ ISEB Common Pre-Test", "dates": {"examDate": "November 2026"}}]

_PROPOSE = f"""
e AS (SELECT s.*, r.ADMPOL, r.MINORGROUP, r.RELCHAR, r.SCHOOLTYPE AS regtype, try_cast(r.AGELOW AS INT) AS lo, try_cast(r.AGEHIGH AS INT) AS hi, trim(regexp_replace(lower(s.name), '[^a-z0-9]+', ' ', 'g')) AS nm, lower(trim(s.la)) AS place FROM school s LEFT JOIN register r ON r.URN = s.urn),
f AS (SELECT *, coalesce(ADMPOL = 'Selective', false) AS sel, schoolType = 'Independent' OR coalesce(contains(MINORGROUP, 'Independent'), false) AS ind FROM e),
g AS (SELECT *, CASE WHEN contains(nm, 'small ring') OR contains(nm, 'blue bolt') OR (sel AND contains(place, 'kent')) THEN 0 WHEN contains(nm, 'red widget') OR (sel AND (contains(place, 'sutton') OR contains(place, 'trafford'))) THEN 1 END AS si,
  contains(nm, 'gear') OR contains(nm, 'green') AS ii, contains(nm, 'special') OR contains(nm, 'centre') OR coalesce(contains(lower(regtype), 'special'), false) AS send, coalesce(lo <= 5 AND hi >= 18, false) AS thr FROM f),
h AS (SELECT *, CASE WHEN contains(nm, 'queens') THEN 'herts' WHEN ind THEN CASE WHEN ii THEN 'independent rule' WHEN send THEN 'send' WHEN thr THEN 'all-through' ELSE 'senior' END WHEN si IS NOT NULL THEN 'state rule' WHEN sel THEN 'selective'
   WHEN contains(nm, 'music') OR contains(nm, 'sports') OR contains(nm, 'technology') THEN 'aptitude' WHEN coalesce(RELCHAR, '') NOT IN ('', 'None', 'Does not apply', 'Not applicable') THEN 'faith' WHEN contains(nm, 'academy') AND contains(nm, 'ark') THEN 'banding' ELSE 'standard' END AS route FROM g),
p AS (SELECT *, CASE WHEN route IN ('herts', 'state rule', 'selective') THEN 'Grammar' WHEN route IN ('independent rule', 'send', 'all-through', 'senior', 'prep') THEN 'Independent' ELSE 'Comprehensive' END AS pt,
  CASE route WHEN 'independent rule' THEN '11+ ISEB Common Pre-Test' WHEN 'send' THEN '11+ Specialist Assessment & EHCP Review' WHEN 'senior' THEN '11+ School Entrance Examination (English, Mathematics & Reasoning)'
   WHEN 'state rule' THEN CASE si WHEN 0 THEN '11+ GL Assessment (Kent Test)' ELSE '11+ Sutton SET' END WHEN 'selective' THEN '11+ GL Assessment (' || coalesce(nullif(la, ''), 'Regional') || ' Selective)'
   WHEN 'faith' THEN 'Faith-based Admissions (' || trim(RELCHAR) || ' - Supplementary Information Form [SIF] Required)' ELSE 'Non-selective (Distance & Sibling Criteria - Local Authority CAF)' END AS px FROM h)"""


@query("dq16_proposals", f"""WITH {_PROPOSE}
SELECT id, route, pt AS "proposedType", px AS "proposedExam", CASE route WHEN 'state rule' THEN CASE si WHEN 0 THEN '10 September 2026' END WHEN 'independent rule' THEN 'November 2026' WHEN 'selective' THEN '12 September 2026'
  WHEN 'send' THEN '11 January 2027' WHEN 'senior' THEN '9 January 2027' WHEN 'faith' THEN 'N/A (Faith Priority Criteria)' ELSE 'N/A (Non-selective Admissions)' END AS exam_date,
 (CASE WHEN pt <> schoolType THEN 'schoolType,' ELSE '' END) || (CASE WHEN px <> entranceExamType THEN 'entranceExamType' ELSE '' END) AS changed FROM p""", uses=(*SCHOOL, "register"))
def proposals(spark, sf):
    p = enrich.preview(schools(spark, sf), view(spark, sf, "register"), STATE_RULES, INDEPENDENT_RULES)
    has = lambda f: F.array_contains("changedFields", f)
    changed = F.concat(F.when(has("schoolType"), "schoolType,").otherwise(""), F.when(has("entranceExamType"), "entranceExamType").otherwise(""))
    return p.select("id", "route", "proposedType", "proposedExam", F.try_element_at("proposedDates", F.lit("examDate")).alias("exam_date"), changed.alias("changed"))


@query("dq17_proposal_sources", f"""WITH {_PROPOSE}
SELECT id, cast((CASE WHEN urn <> '' THEN 2 ELSE 0 END) + (CASE WHEN pt = 'Comprehensive' THEN 2 ELSE 1 END) + (CASE WHEN trim(website) <> '' AND website <> 'N/A' THEN 1 ELSE 0 END) AS INT) AS n,
 CASE WHEN pt = 'Independent' THEN CASE WHEN contains(px, 'ISEB') THEN 'Independent Schools Examinations Board (ISEB CPT)' ELSE 'Independent Schools Council (ISC) Admissions Standards' END
  WHEN pt = 'Grammar' THEN CASE WHEN contains(px, 'Kent Test') THEN 'Kent County Council 11+ Secondary Transfer (PESE)' WHEN contains(px, 'Sutton SET') THEN 'Sutton Selective Eligibility Test (SET) Authority'
   WHEN contains(px, 'Buckinghamshire') THEN 'The Buckinghamshire Grammar Schools (TBGS)' WHEN contains(px, 'Birmingham') THEN 'King Edward VI Foundation Grammar Admissions' WHEN contains(px, 'Trafford') THEN 'Trafford Grammar Schools Consortium Testing'
   WHEN contains(px, 'Redbridge') THEN 'London Borough of Redbridge 11+ Admissions' ELSE 'National Grammar Schools Association & Statutory Code' END ELSE 'Pan-London eAdmissions & Statutory LA CAF Timetable' END AS policy FROM p""", uses=(*SCHOOL, "register"))
def proposal_sources(spark, sf):
    p = enrich.preview(schools(spark, sf), view(spark, sf, "register"), STATE_RULES, INDEPENDENT_RULES)
    policy = F.filter("sources", lambda s: ~s["type"].isin("dfe", "school"))[0]["title"]
    return p.select("id", F.size("sources").alias("n"), policy.alias("policy"))


@query("jn06_first_rules", """
WITH r(ordinal, word) AS (VALUES (0, 'small ring'), (1, 'bolt'), (2, 'nation 1'), (3, 'gear'), (3, 'zz')), p(ordinal, word) AS (VALUES (0, 'kent'), (1, 'sutton'), (2, 'essex'), (3, 'nowhere')),
e AS (SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS nm, lower(coalesce(la, '')) AS pl, k % 3 = 1 AS sel FROM entity)
SELECT id, min(ordinal) AS ordinal FROM (SELECT id, ordinal FROM e JOIN r ON contains(nm, word) UNION ALL SELECT id, ordinal FROM e JOIN p ON sel AND contains(pl, word)) GROUP BY 1""", uses=("entity",))
def first_rules(spark, sf):
    words = spark.createDataFrame([(0, "small ring"), (1, "bolt"), (2, "nation 1"), (3, "gear"), (3, "zz")], "ordinal int, word string")
    places = spark.createDataFrame([(0, "Kent"), (1, "Sutton"), (2, "Essex"), (3, "Nowhere")], "ordinal int, word string")
    return enrich.first_rule_table(view(spark, sf, "entity"), words, "name", districts=places, selective=F.col("k") % 3 == 1)


@query("dq18_refined_blanks", """SELECT id, CASE WHEN b THEN 'Comprehensive' ELSE schoolType END AS "schoolType", CASE WHEN b THEN 'Non-selective (Distance & Sibling Criteria - Local Authority CAF)' ELSE entranceExamType END AS "entranceExamType",
 CASE WHEN b THEN coalesce(nullif(rawSchoolType, ''), 'Academy Converter') || ' (Historic Grammar Academy - Non-selective)' ELSE rawSchoolType END AS "rawSchoolType" FROM (SELECT *, trim(entranceExamType) = '' AND contains(schoolType, 'Grammar') AS b FROM school)""", uses=SCHOOL)
def refined_blanks(spark, sf):
    return enrich.refine_blanks(schools(spark, sf)).select("id", "schoolType", "entranceExamType", "rawSchoolType")


_CLASS = """
c AS (SELECT *, lower(name) AS nm, lower(entranceExamType) AS et, lower(la) AS pl, schoolType = 'Grammar' AS gr FROM school),
d AS (SELECT *, CASE WHEN contains(et, 'sutton') OR contains(et, 'set') THEN 'SUTTON_SET' WHEN contains(et, 'kent test') OR (pl = 'kent' AND gr) THEN 'KENT_PESE' WHEN contains(et, 'csse') OR (contains(et, 'essex') AND gr) THEN 'CSSE_ESSEX'
  WHEN pl = 'trafford' AND gr THEN 'TRAFFORD_CONSORTIUM' WHEN pl = 'birmingham' AND gr THEN 'BIRMINGHAM_CONSORTIUM' WHEN contains(et, 'london 11+') THEN 'LONDON_11PLUS_CONSORTIUM' WHEN pl = 'buckinghamshire' AND gr THEN 'BUCKINGHAMSHIRE_STT'
  WHEN pl = 'redbridge' AND gr THEN 'REDBRIDGE_11PLUS' END AS cc FROM c),
x AS (SELECT *, CASE WHEN cc = 'SUTTON_SET' THEN 'SUTTON_SET' WHEN cc = 'CSSE_ESSEX' THEN 'CSSE' WHEN cc = 'LONDON_11PLUS_CONSORTIUM' THEN 'LONDON_CONSORTIUM' WHEN cc IS NOT NULL THEN 'GL_ASSESSMENT'
  WHEN contains(et, 'gl assessment') THEN 'GL_ASSESSMENT' WHEN contains(et, 'cem') THEN 'CEM' WHEN contains(et, 'iseb') THEN 'ISEB_CPT' WHEN contains(et, 'aptitude') THEN 'SPECIALIST_APTITUDE' WHEN gr THEN 'GL_ASSESSMENT' WHEN schoolType = 'Independent' THEN 'SCHOOL_OWN' ELSE 'NON_SELECTIVE' END AS xc,
  second_stage_exam_required = 'Yes' OR contains(et, 'two-stage') OR stage_two_format_and_subjects NOT IN ('', 'N/A') OR coalesce(cc = 'SUTTON_SET', false) AS two FROM d)"""


@query("dq20_classified", f"WITH {_CLASS} SELECT id, cc AS \"consortiumCode\", xc AS \"examCode\", CASE WHEN two THEN 'Yes' ELSE 'No' END AS second_stage, 'LOCAL_AUTHORITY_MAINTAINED' AS \"bodyCode\" FROM x", uses=SCHOOL)
def classified(spark, sf):
    return enrich.classify(schools(spark, sf)).select("id", "consortiumCode", "examCode", F.col("second_stage_exam_required").alias("second_stage"), "bodyCode")


@query("dq19_stages", f"""WITH {_CLASS}
SELECT id AS school_id, cast(1 AS INT) AS stage_number, xc AS exam_type, CASE WHEN cc IN ('SUTTON_SET', 'KENT_PESE') THEN 'Multiple Choice' WHEN xc IN ('ISEB_CPT', 'LONDON_CONSORTIUM') THEN 'Online Adaptive' WHEN xc = 'NON_SELECTIVE' THEN 'Distance & Sibling Allocation'
   WHEN xc = 'SPECIALIST_APTITUDE' THEN 'Aptitude Assessment' ELSE 'Standard Written' END AS paper_format,
  CASE WHEN contains(stage_one_format_and_subjects, 'Verbal') THEN 'Mathematics,Verbal Reasoning' WHEN stage_one_format_and_subjects <> '' THEN 'Mathematics,English' WHEN cc = 'SUTTON_SET' THEN 'Mathematics,English'
   WHEN cc = 'KENT_PESE' OR xc = 'ISEB_CPT' THEN 'English,Mathematics,Verbal Reasoning,Non-Verbal Reasoning' WHEN xc = 'LONDON_CONSORTIUM' THEN 'Verbal Reasoning,Non-Verbal Reasoning,Mathematics,English' WHEN xc = 'NON_SELECTIVE' THEN 'Non-academic Criteria'
   WHEN xc = 'SPECIALIST_APTITUDE' THEN 'Music Aptitude,Sport Aptitude' ELSE 'Mathematics,English' END AS subjects, two AS is_sifting FROM x
UNION ALL SELECT id, 2, 'SCHOOL_OWN', 'Standard Written Papers', CASE WHEN contains(stage_two_format_and_subjects, 'essay') THEN 'Mathematics,English,Creative Writing' WHEN cc = 'SUTTON_SET' THEN 'Mathematics,English' ELSE 'Mathematics,English,Creative Writing' END, false FROM x WHERE two""", uses=SCHOOL)
def stage_rows(spark, sf):
    s = enrich.stages(enrich.classify(schools(spark, sf)))
    return s.select("school_id", "stage_number", "exam_type", "paper_format", F.array_join("subjects", ",").alias("subjects"), "is_sifting")


@query("jn03_named_stages", f"""WITH {_CLASS}, s AS (SELECT id, xc, 1 AS n FROM x UNION ALL SELECT id, 'SCHOOL_OWN', 2 FROM x WHERE two)
SELECT s.id AS school_id, cast(s.n AS INT) AS stage_number, t.name AS exam_name FROM s JOIN (VALUES {', '.join("('" + e[0] + "', '" + e[1].replace("'", "''") + "')" for e in seeds.EXAM_TYPES)}) t(code, name) ON t.code = s.xc""", uses=SCHOOL)
def named_stages(spark, sf):
    return seeds.stages_with_names(enrich.stages(enrich.classify(schools(spark, sf)))).select("school_id", "stage_number", "exam_name")


# One record for every body rule and for near misses of some, as the rules are stated.
BODIES = (
    ("Harris Academy", "", "", "HARRIS_FEDERATION"), ("Plain", "a member of the Harris Federation", "", "HARRIS_FEDERATION"), ("Ark Burlington", "", "", "ARK_SCHOOLS"),
    ("Parkland", "", "", "LOCAL_AUTHORITY_MAINTAINED"), ("Oasis Academy Hadley", "", "", "OASIS_COMMUNITY_LEARNING"), ("Wallington County Grammar", "", "", "FOLIO_EDUCATION_TRUST"),
    ("King Edward VI Aston", "", "", "KEVI_FOUNDATION"), ("King Edward VI Morpeth", "", "", "LOCAL_AUTHORITY_MAINTAINED"), ("Plain", "run by GDST", "", "GDST"),
    ("Haberdashers' Girls", "", "", "HABERDASHERS_TRUST"), ("Plain", "United Learning academy", "", "UNITED_LEARNING"), ("Plain", "GLF Schools", "", "GLF_SCHOOLS"),
    ("Plain", "Leigh Academies Trust", "", "LEIGH_ACADEMIES_TRUST"), ("Plain", "Outwood Grange trust", "", "OUTWOOD_GRANGE_ACADEMIES"), ("The Tiffin Girls", "", "", "TIFFIN_ACADEMY_TRUST"),
    ("Wilson's School", "", "", "WILSONS_ACADEMY_TRUST"), ("Plain", "", "Roman Catholic families first", "DIOCESE_OF_WESTMINSTER"), ("Plain C of E", "", "", "LDBS_LONDON"),
    ("Plain", "", "Church of England", "LDBS_LONDON"), ("Harris RC Hall", "LDBS", "", "HARRIS_FEDERATION"),
)
_BODY = " ".join(f"WHEN {i} THEN '{b[3]}'" for i, b in enumerate(BODIES))


@query("dq20_body_codes", f"SELECT id, CASE k % {len(BODIES)} {_BODY} END AS code FROM entity", uses=("entity",))
def body_codes(spark, sf):
    pick = lambda j: F.get(F.array(*[F.lit(b[j]) for b in BODIES]), (F.col("k") % len(BODIES)).cast("int"))
    e = view(spark, sf, "entity").select("id", "k", "la", pick(0).alias("name"), pick(1).alias("description"), pick(2).alias("admissionsPolicy"))
    return e.select("id", enrich.body_code(e.columns).alias("code"))
