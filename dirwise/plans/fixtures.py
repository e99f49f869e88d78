"""Directory-shaped input views over the given tables.

Each view is plain SQL text that Spark and DuckDB both accept, so a check
query shares the input mapping and nothing of the operator logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirwise.session import spread

# k: row number of the entity; g: key it copies its identity from (every 17th
# row repeats its neighbour, which plants duplicates at any scale).
ENTITY = """
SELECT
  concat('e', lpad(cast(k AS STRING), 9, '0')) AS id,
  k,
  concat(CASE WHEN k % 10 = 4 THEN 'The ' ELSE '' END, upper(substr(p_name, 1, 1)), substr(p_name, 2), ' ',
         replace(n_name, '_', ' '),
         CASE g % 6 WHEN 0 THEN ' School' WHEN 1 THEN ' Grammar School' WHEN 2 THEN ' Academy'
                    WHEN 3 THEN ' High School' WHEN 4 THEN ' College' ELSE '' END,
         CASE WHEN k % 23 = 5 THEN ' for Girls' ELSE '' END) AS name,
  CASE WHEN k % 19 = 7 THEN '' WHEN k % 23 = 9 THEN NULL ELSE cast(100000 + g AS STRING) END AS urn,
  CASE n_nationkey WHEN 0 THEN 'Barnet' WHEN 1 THEN 'Sutton' WHEN 2 THEN 'Kent' WHEN 3 THEN 'Buckinghamshire'
       WHEN 4 THEN 'Trafford' WHEN 5 THEN 'Birmingham' WHEN 6 THEN 'Essex' WHEN 7 THEN 'Kingston upon Thames'
       WHEN 8 THEN 'Redbridge' WHEN 9 THEN 'Reading' WHEN 10 THEN '' ELSE replace(n_name, '_', ' ') END AS la,
  CASE r_name WHEN 'AFRICA' THEN 'Greater London' WHEN 'AMERICA' THEN 'South East' WHEN 'ASIA' THEN 'West Midlands'
       WHEN 'EUROPE' THEN 'North West' ELSE 'East of England' END AS region,
  CASE WHEN k % 29 = 11 THEN '' WHEN k % 31 = 13 THEN NULL WHEN k % 37 = 15 THEN 'invalid-123'
       WHEN k % 7 = 2 THEN lower(concat('EN', cast(1 + h % 97 AS STRING), cast(h % 9 AS STRING), pl1, pl2))
       WHEN k % 5 = 1 THEN concat('  EN', cast(1 + h % 97 AS STRING), '  ', cast(h % 9 AS STRING), pl1, pl2, ' ')
       ELSE concat('EN', cast(1 + h % 97 AS STRING), ' ', cast(h % 9 AS STRING), pl1, pl2) END AS postcode,
  CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN replace(n_name, '_', ' ')
       ELSE concat(cast(1 + k % 300 AS STRING), ' High Street, ', replace(n_name, '_', ' '), ', ', r_name) END AS address,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Grammar (Academy)' WHEN 'BUILDING' THEN 'Other independent school'
       WHEN 'FURNITURE' THEN 'Academy converter' WHEN 'HOUSEHOLD' THEN 'Community school' ELSE '' END AS schoolType,
  CASE WHEN k % 17 = 3 AND k % 2 = 0 THEN '' ELSE
    CASE g % 9 WHEN 0 THEN 'Boys' WHEN 1 THEN 'Girls' WHEN 2 THEN 'Mixed' WHEN 3 THEN 'Co-ed'
       WHEN 4 THEN 'Boys (11-16), Co-ed Sixth Form' WHEN 5 THEN 'girls only' WHEN 6 THEN 'Mixed'
       WHEN 7 THEN 'Mixed' ELSE 'Male' END END AS gender,
  CASE k % 4 WHEN 0 THEN '11-18' WHEN 1 THEN '11-16' WHEN 2 THEN '4-18' ELSE '' END AS ageRange,
  CASE k % 6 WHEN 0 THEN cast(p_size * 40 AS STRING) WHEN 1 THEN concat(cast(p_size * 40 AS STRING), ' pupils')
       WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE cast(p_size * 25 AS STRING) END AS pupilCount,
  CASE k % 9 WHEN 0 THEN 'Outstanding' WHEN 1 THEN 'Good' WHEN 2 THEN 'Requires improvement' WHEN 3 THEN ''
       WHEN 4 THEN 'N/A' WHEN 5 THEN NULL WHEN 6 THEN 'Good' WHEN 7 THEN 'Independent (ISI Excellent)'
       ELSE 'Inadequate' END AS ofstedRating,
  CASE WHEN k % 5 = 2 THEN NULL ELSE cast((k * 37) % 200 - 100 AS DOUBLE) / 100 END AS gcseProgress8,
  CASE WHEN k % 7 = 3 THEN NULL ELSE cast(300 + (k * 13) % 600 AS DOUBLE) / 10 END AS gcseAttainment8,
  CASE WHEN k % 3 = 0 THEN cast(1 + (k * 7) % 1000 AS INT) ELSE NULL END AS national_rank_england,
  CASE WHEN k % 4 = 1 THEN cast(1 + (k * 11) % 1000 AS INT) ELSE NULL END AS gcse_rank_england,
  CASE WHEN k % 5 = 3 THEN cast(1 + (k * 3) % 1000 AS INT) ELSE NULL END AS a_level_rank_england,
  CASE k % 11 WHEN 0 THEN 'GL Assessment' WHEN 1 THEN 'CSSE 11+ (Essex)' WHEN 2 THEN 'CEM' WHEN 3 THEN 'ISEB Common Pre-Test'
       WHEN 4 THEN 'School-Own Exam' WHEN 5 THEN 'Non-Selective (Distance)' WHEN 6 THEN 'London 11+ Consortium'
       WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN 'Sutton SET Two-Stage' ELSE ' Music aptitude ' END AS entranceExamType,
  CASE k % 6 WHEN 0 THEN concat(cast(1 + k % 28 AS STRING), ' May 2026') WHEN 1 THEN 'TBC' WHEN 2 THEN 'Open year-round'
       WHEN 3 THEN '2026-05-11' WHEN 4 THEN '' ELSE concat(cast(1 + k % 28 AS STRING), ' June 2026') END AS d_registrationOpen,
  CASE k % 7 WHEN 0 THEN concat(cast(1 + k % 28 AS STRING), ' November 2026') WHEN 1 THEN '3 July 2025'
       WHEN 2 THEN 'N/A' WHEN 3 THEN concat(cast(1 + k % 28 AS STRING), '/07/2026') WHEN 4 THEN '2026-08-31'
       WHEN 5 THEN 'mid-Sept 2026' ELSE concat(cast(1 + k % 28 AS STRING), ' September 2026') END AS d_registrationDeadline,
  CASE k % 8 WHEN 0 THEN concat(cast(1 + k % 28 AS STRING), ' September 2026') WHEN 1 THEN 'Autumn 2026'
       WHEN 2 THEN concat(cast(1 + k % 28 AS STRING), 'th Nov 2025') WHEN 3 THEN 'November/December 2025'
       WHEN 4 THEN 'January 2026' WHEN 5 THEN '' WHEN 6 THEN concat('Saturday ', cast(1 + k % 28 AS STRING), ' October 2026')
       ELSE 'TBC' END AS d_examDate,
  CASE k % 5 WHEN 0 THEN concat(cast(1 + k % 28 AS STRING), ' October 2026') WHEN 1 THEN 'Rolling' WHEN 2 THEN 'October 2024'
       WHEN 3 THEN '31 February 2027' ELSE '' END AS d_resultsDate,
  CASE k % 6 WHEN 0 THEN '1 March 2027' WHEN 1 THEN 'Spring' WHEN 2 THEN '' WHEN 3 THEN concat(cast(1 + k % 31 AS STRING), ' March 2027')
       WHEN 4 THEN 'following interview' ELSE 'Feb/Mar 2026' END AS d_offersAcceptance,
  CASE k % 4 WHEN 0 THEN '15 March 2027' WHEN 1 THEN concat(cast(1 + k % 28 AS STRING), ' February 2027') ELSE '' END AS d_acceptanceDeadline,
  CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL
       WHEN 3 THEN concat('HTTP://WWW.E', cast(g AS STRING), '.example.org')
       WHEN 4 THEN concat('www.e', cast(g AS STRING), '.sch.uk/?utm_source=list&page=2&ref=x')
       WHEN 5 THEN concat('https://e', cast(g AS STRING), '.sch.uk/')
       WHEN 6 THEN concat('http://e', cast(g AS STRING), '.example.com/about?gclid=1#top')
       ELSE concat('https://www.e', cast(g AS STRING), '.sch.uk/admissions?id=', cast(k % 5 AS STRING)) END AS website,
  CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN concat('+44 (0)20 8', lpad(cast(g % 1000000 AS STRING), 7, '0'))
       WHEN 3 THEN concat('0044208', lpad(cast(g % 1000000 AS STRING), 7, '0')) WHEN 4 THEN concat('44208', lpad(cast(g % 1000000 AS STRING), 7, '0'))
       WHEN 5 THEN '020 8'  ELSE concat('020 8', lpad(cast(g % 1000000 AS STRING), 7, '0')) END AS phone,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN concat('Office@E', cast(g AS STRING), '.sch.uk') WHEN 2 THEN 'not an email'
       ELSE concat('info@e', cast(g AS STRING), '.sch.uk') END AS email,
  CASE k % 8 WHEN 0 THEN concat('£', cast(1 + k % 9 AS STRING), ',', lpad(cast(k % 1000 AS STRING), 3, '0'), ' per term')
       WHEN 1 THEN 'Free' WHEN 2 THEN NULL WHEN 3 THEN '£150' WHEN 4 THEN '£250,000 a year' ELSE '' END AS feesTermly,
  CASE WHEN k % 10 = 0 THEN '£100' ELSE '' END AS registrationFee,
  CASE k % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN NULL ELSE '' END AS second_stage_exam_required,
  CASE k % 4 WHEN 0 THEN 'Verbal Reasoning and Maths' WHEN 1 THEN 'English, Maths; CEM style' ELSE '' END AS stage_one_format_and_subjects,
  CASE k % 10 WHEN 0 THEN 'English essay and Mathematics paper' WHEN 5 THEN 'N/A' ELSE '' END AS stage_two_format_and_subjects,
  CASE k % 3 WHEN 0 THEN 'Distance and sibling criteria' WHEN 1 THEN 'Selective by examination' ELSE '' END AS admissionsPolicy,
  k % 12 <> 5 AS official, k % 10 = 1 AS hot, k % 50 <> 49 AS active,
  CASE k % 10 WHEN 0 THEN 'verified' WHEN 1 THEN 'llm_enriched' WHEN 2 THEN 'has_anomalies' WHEN 3 THEN 'dead_website'
       WHEN 4 THEN 'auto_verified' WHEN 5 THEN 'missing_website' WHEN 6 THEN 'crawl_stuck' WHEN 7 THEN 'data_missing'
       ELSE 'unverified' END AS verification_status,
  CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN 'auto_verified,dates_verified' WHEN 2 THEN 'llm_enriched' WHEN 3 THEN 'dead_website'
       WHEN 4 THEN 'contact_mismatch,has_anomalies' WHEN 5 THEN 'two_stage_exam,p0_cycle_current' WHEN 6 THEN 'missing_website'
       WHEN 7 THEN 'crawl_stuck' ELSE 'web_verified' END AS tags_text,
  CASE WHEN k % 4 = 3 THEN NULL ELSE concat('2026-', lpad(cast(1 + k % 9 AS STRING), 2, '0'), '-',
       lpad(cast(1 + k % 28 AS STRING), 2, '0'), 'T08:00:00Z') END AS verified_at,
  CASE WHEN k % 6 = 5 THEN NULL ELSE cast((k * 17) % 101 AS INT) END AS confidence_score,
  CASE WHEN k % 6 = 2 THEN NULL ELSE cast((k * 29) % 101 AS INT) END AS completeness_score,
  CASE WHEN k % 5 = 4 THEN NULL ELSE cast(1 + k % 6 AS INT) END AS primary_exam_type_id,
  CASE k % 6 WHEN 0 THEN 'Kent Consortium' WHEN 1 THEN 'none' WHEN 2 THEN 'CSSE Consortium' WHEN 3 THEN NULL ELSE '' END AS exam_consortium,
  CASE WHEN k % 6 IN (0, 2) THEN cast(1 + k % 6 AS INT) ELSE NULL END AS exam_consortium_id,
  CASE k % 5 WHEN 0 THEN 'Local Authority' WHEN 1 THEN 'GDST' ELSE '' END AS governing_body,
  500000 + (k * 173) % 60000 AS easting,
  150000 + (k * 311) % 50000 AS northing
FROM (
  SELECT c.c_custkey AS k, c.c_mktsegment, p.p_name, p.p_size, n.n_name, n.n_nationkey, r.r_name, c.g, c.h,
         substr('ABDEFGHJLNPQRSTUWXYZ', cast(1 + c.h % 20 AS INT), 1) AS pl1,
         substr('ABDEFGHJLNPQRSTUWXYZ', cast(1 + cast(floor(c.h / 20) AS BIGINT) % 20 AS INT), 1) AS pl2
  FROM (SELECT c_custkey, c_mktsegment, c_custkey - CASE WHEN c_custkey % 17 = 3 THEN 1 ELSE 0 END AS g,
               c_custkey - c_custkey % 3 AS h,
               CASE WHEN c_custkey % 17 = 3 THEN 1 ELSE 0 END AS copied, c_nationkey
        FROM customer) c
  JOIN part p ON p.p_partkey = c.g
  JOIN nation n ON n.n_nationkey = CASE WHEN c.copied = 1 THEN cast(c.g % 25 AS INT) ELSE c.c_nationkey END
  JOIN region r ON r.r_regionkey = n.n_regionkey
) base
"""

# Second source: the official register. Rows copy some entities (same key, or
# same postcode with a longer name) and add organisations nobody lists yet.
REGISTER = """
SELECT
  CASE WHEN s_suppkey % 4 = 0 THEN cast(900000 + s_suppkey AS STRING) ELSE cast(100000 + s_suppkey * 3 AS STRING) END AS URN,
  concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' ', replace(n_name, '_', ' '),
         CASE s_suppkey % 3 WHEN 0 THEN ' School' WHEN 1 THEN ' Academy' ELSE ' Foundation School' END) AS SCHNAME,
  replace(n_name, '_', ' ') AS LANAME,
  concat(cast(1 + s_suppkey % 200 AS STRING), ' Station Road') AS STREET,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Old Town' END AS LOCALITY,
  CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE '' END AS ADDRESS3,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'Newtown' END AS TOWN,
  concat('EN', cast(1 + (s_suppkey * 3) % 97 AS STRING), ' ', cast((s_suppkey * 3) % 9 AS STRING),
         substr('ABDEFGHJLNPQRSTUWXYZ', cast(1 + (s_suppkey * 3) % 20 AS INT), 1),
         substr('ABDEFGHJLNPQRSTUWXYZ', cast(1 + cast(floor(s_suppkey * 3 / 20) AS BIGINT) % 20 AS INT), 1)) AS POSTCODE,
  CASE WHEN s_suppkey % 11 = 4 THEN 'Closed' ELSE 'Open' END AS SCHSTATUS,
  CASE WHEN s_suppkey % 6 = 5 THEN '0' ELSE '1' END AS ISSECONDARY,
  CASE s_suppkey % 4 WHEN 0 THEN 'Academy converter' WHEN 1 THEN 'Other independent school' WHEN 2 THEN 'Community school'
       ELSE 'Academy special sponsor led' END AS SCHOOLTYPE,
  CASE s_suppkey % 4 WHEN 1 THEN 'Independent school' WHEN 3 THEN 'Special school' ELSE 'Academy' END AS MINORGROUP,
  CASE s_suppkey % 5 WHEN 0 THEN 'Selective' WHEN 1 THEN 'Not applicable' ELSE 'Non-selective' END AS ADMPOL,
  CASE s_suppkey % 4 WHEN 0 THEN 'Church of England' WHEN 1 THEN 'Does not apply' ELSE 'None' END AS RELCHAR,
  CASE s_suppkey % 3 WHEN 0 THEN 'Boys' WHEN 1 THEN 'Girls' ELSE 'Mixed' END AS GENDER,
  CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE '11' END AS AGELOW, '18' AS AGEHIGH
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = s_suppkey * 3
"""

# Votes, reports and reviews drawn from the event table.
VOTES = """
SELECT event_id, user_id AS userId, concat('e', lpad(cast((event_id * 7) % (SELECT count(*) FROM customer) AS STRING), 9, '0')) AS schoolId,
  CASE event_type WHEN 'click' THEN 'website' WHEN 'view' THEN 'phone' WHEN 'purchase' THEN 'examDate'
       WHEN 'error' THEN 'feesTermly' ELSE 'gender' END AS fieldName,
  CASE WHEN event_id % 13 = 0 THEN 0 WHEN value > 20 THEN 3 WHEN value > 5 THEN 1 ELSE -1 END AS vote,
  ts AS votedAt
FROM events
"""

REPORTS = """
SELECT event_id, user_id AS userId, concat('e', lpad(cast((event_id * 3) % (SELECT count(*) FROM customer) AS STRING), 9, '0')) AS schoolId,
  CASE event_type WHEN 'click' THEN 'website' WHEN 'view' THEN 'phone' WHEN 'purchase' THEN 'address'
       WHEN 'error' THEN 'feesTermly' ELSE 'gender' END AS fieldName,
  CASE WHEN value > 12 THEN 'down' ELSE 'up' END AS status,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('value ', cast(event_id % 50 AS STRING)) END AS customValue,
  concat('old ', cast(event_id % 9 AS STRING)) AS originalValue, ts AS reportedAt
FROM events
"""

REVIEWS = """
SELECT concat('e', lpad(cast(doc_id AS STRING), 9, '0')) AS schoolId,
  CASE doc_id % 3 WHEN 0 THEN 'website' WHEN 1 THEN 'phone' ELSE 'address' END AS fieldName,
  concat('admin', cast(quality AS STRING)) AS reviewedBy
FROM labels
"""

# Change log: every event is one logged write to an entity.
AUDIT = """
SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'EDIT' WHEN 'view' THEN 'VERIFY' WHEN 'purchase' THEN 'MERGE'
         WHEN 'error' THEN 'CRAWL' ELSE 'BULK' END AS actionType,
  concat('b', cast(event_id % 40 AS STRING)) AS batchId,
  concat('e', lpad(cast((event_id * 11) % (SELECT count(*) FROM customer) AS STRING), 9, '0')) AS schoolId,
  concat('{"phone":"p', cast(event_id % 7 AS STRING), '","website":"w', cast(event_id % 3 AS STRING), '","gender":"Mixed"}') AS previousState,
  CASE WHEN event_id % 4 = 0 THEN concat('{"phone":"p', cast(event_id % 7 AS STRING), '","website":"w', cast(event_id % 3 AS STRING), '","gender":"Mixed"}')
       ELSE concat('{"phone":"p', cast((event_id + 1) % 7 AS STRING), '","website":"w', cast(event_id % 3 AS STRING), '","gender":"Mixed","note":"n', cast(event_id % 5 AS STRING), '"}') END AS newState,
  concat('u', cast(user_id AS STRING)) AS appliedBy, ts AS appliedAt,
  CASE WHEN event_id % 9 = 2 THEN ts ELSE NULL END AS rolledBackAt
FROM events
"""

# Coordinates: most entity postcodes, in their unit form.
COORDS = """
SELECT postcode, outcode, easting, northing,
  CASE WHEN easting % 7 = 0 THEN '' ELSE 'District' END AS admin_district, ord
FROM (
  SELECT concat('EN', cast(1 + h % 97 AS STRING), ' ', cast(h % 9 AS STRING),
           substr('ABDEFGHJLNPQRSTUWXYZ', cast(1 + h % 20 AS INT), 1),
           substr('ABDEFGHJLNPQRSTUWXYZ', cast(1 + cast(floor(h / 20) AS BIGINT) % 20 AS INT), 1)) AS postcode,
         concat('EN', cast(1 + h % 97 AS STRING)) AS outcode, h AS ord,
         500000 + (h * 173) % 60000 AS easting, 150000 + (h * 311) % 50000 AS northing
  FROM (SELECT c_custkey AS h FROM customer WHERE c_custkey % 3 = 0) s
) t WHERE ord % 4 <> 1
"""

CTES = {"entity": ENTITY, "register": REGISTER, "votes": VOTES, "reports": REPORTS, "reviews": REVIEWS,
        "audit": AUDIT, "coords": COORDS}

_NEEDS = {
    "entity": ("customer", "part", "nation", "region"),
    "register": ("supplier", "nation", "part"),
    "votes": ("events", "customer"), "reports": ("events", "customer"), "reviews": ("labels",), "audit": ("events", "customer"),
    "coords": ("customer",),
}


# Tables whose rows cost a lot of work each.
HEAVY = ("customer", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared input views as a DataFrame."""
    for t in _NEEDS[name]:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(CTES[name])


MILESTONE_COLS = ("registrationOpen", "registrationDeadline", "examDate", "resultsDate", "offersAcceptance", "acceptanceDeadline")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity view with its nested columns: milestones map and tag array."""
    df = view(spark, sf_dir, "entity")
    pairs = [x for c in MILESTONE_COLS for x in (F.lit(c), F.col(f"d_{c}"))]
    return df.withColumn("entranceExamDates", F.create_map(*pairs)).withColumn(
        "verification_tags",
        F.filter(F.split("tags_text", ","), lambda t: t != ""),
    )
