"""Completeness, recommendation and confidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirwise.operators import aggregates as agg
from dirwise.operators import scoring
from dirwise.plans.fixtures import CTES
from dirwise.plans.q_directory import SCHOOL, schools
from dirwise.plans.registry import query

_M = ["d_registrationOpen", "d_registrationDeadline", "d_examDate", "d_resultsDate", "d_offersAcceptance"]
_N = " + ".join(f"CASE WHEN trim({c}) <> '' AND NOT contains(lower({c}), 'tbc') AND NOT contains(lower({c}), 'n/a') THEN 1 ELSE 0 END" for c in _M)


def d_part(weight, *parts):
    s = " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in parts)
    return f"cast(floor({weight}::DOUBLE * least(1.0::DOUBLE, {s}) + 0.5) AS BIGINT)"


def d_completeness(w):
    return f"""SELECT id, {d_part(w['website'], ("trim(website) LIKE 'http%'", 1.0))} AS p1, cast(floor({w['examDates']}::DOUBLE * (({_N}) / 5.0::DOUBLE) + 0.5) AS BIGINT) AS p2,
 {d_part(w['examFormat'], ("trim(entranceExamType) <> '' AND NOT contains(lower(entranceExamType), 'unknown')", 0.7), ("stage_one_format_and_subjects <> '' OR second_stage_exam_required <> ''", 0.3))} AS p3,
 {d_part(w['schoolClassification'], ("trim(schoolType) <> ''", 0.6), ("trim(gender) <> ''", 0.4))} AS p4,
 {d_part(w['academicOfsted'], ("trim(ofstedRating) <> '' AND NOT contains(lower(ofstedRating), 'unknown')", 0.5), ('gcseAttainment8 IS NOT NULL', 0.3), ('coalesce(national_rank_england, 0) <> 0 OR coalesce(gcse_rank_england, 0) <> 0', 0.2))} AS p5,
 {d_part(w['contactChannels'], ("length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 7", 0.5), ("contains(email, '@')", 0.5))} AS p6,
 {d_part(w['addressGeography'], ("trim(address) <> ''", 0.4), ("trim(postcode) <> ''", 0.4), ("trim(la) <> ''", 0.2))} AS p7,
 {d_part(w['leadershipCapacity'], ("feesTermly <> '' OR NOT contains(lower(schoolType), 'independent')", 0.3))} AS p8 FROM school"""


@query("sco01_completeness", f"""SELECT id, p1 AS website, p2 AS dates, p5 AS academic, cast(greatest(0, least(100, floor((p1+p2+p3+p4+p5+p6+p7+p8) / 100.0 * 100 + 0.5))) AS INT) AS completeness
FROM ({d_completeness(scoring.WEIGHTS)})""", uses=SCHOOL)
def completeness(spark, sf):
    return scoring.completeness(schools(spark, sf)).select(
        "id", F.col("breakdown.website").alias("website"), F.col("breakdown.examDates").alias("dates"), F.col("breakdown.academicOfsted").alias("academic"), "completeness")


_W2 = {**scoring.WEIGHTS, "website": 50, "examDates": 0, "contactChannels": 13}


@query("sco02_rescored_histogram", f"""WITH s AS (SELECT id, floor((p1+p2+p3+p4+p5+p6+p7+p8) / {float(sum(_W2.values()))!r} * 100 + 0.5) AS s FROM ({d_completeness(_W2)}))
SELECT count(*) FILTER (s >= 80) AS excellent, count(*) FILTER (s >= 60 AND s < 80) AS good, count(*) FILTER (s >= 40 AND s < 60) AS fair, count(*) FILTER (s < 40) AS poor,
  cast(floor(avg(s) + 0.5) AS BIGINT) AS average, count(*) AS total FROM s""", uses=SCHOOL)
def rescored_histogram(spark, sf):
    return agg.score_histogram(scoring.rescored(schools(spark, sf), {"website": 50, "examDates": 0, "contactChannels": 13}))


# One user: keeps every 400th entity, has dismissed every 90th.
_SEX = "lower(trim(gender))"
_FMT = """concat(CASE WHEN primary_exam_type_id IS NOT NULL THEN 'T:' || primary_exam_type_id WHEN trim(entranceExamType) <> '' THEN 'TN:' || lower(trim(entranceExamType)) ELSE 'T:none' END, '|',
 CASE WHEN exam_consortium_id IS NOT NULL THEN 'C:' || exam_consortium_id ELSE 'CN:' || CASE WHEN lower(trim(coalesce(exam_consortium, ''))) IN ('', 'none', 'null', 'na') THEN 'none' ELSE lower(trim(exam_consortium)) END END)"""
CTES["fits"] = f"""
WITH s AS (SELECT *, {_SEX} LIKE '%boy%' AND {_SEX} NOT LIKE '%girl%' AS b, {_SEX} LIKE '%girl%' AND {_SEX} NOT LIKE '%boy%' AS g, {_SEX} LIKE '%mixed%' OR {_SEX} LIKE '%co-ed%' AS m, {_FMT} AS fmt FROM school),
u AS (SELECT bool_or(b) AS ub, bool_or(g) AS ug, bool_or(m AND NOT b AND NOT g) AS um, bool_or(schoolType = 'Grammar') AS tg, bool_or(schoolType = 'Independent') AS ti, bool_or(schoolType = 'Comprehensive') AS tc,
  list(DISTINCT fmt) AS fmts, floor(avg(easting) + 0.5) AS ue, floor(avg(northing) + 0.5) AS un FROM s WHERE k % 400 = 7),
c AS (SELECT s.*, u.*, round(sqrt(cast((easting - ue) * (easting - ue) + (northing - un) * (northing - un) AS DOUBLE)) / 1609.344, 2) AS miles FROM s, u
  WHERE k % 400 <> 7 AND k % 90 <> 5 AND CASE WHEN (ub OR ug OR um) AND NOT (ub AND ug AND um) THEN (ub AND b) OR (ug AND g) OR (um AND m) ELSE true END),
d AS (SELECT *, CASE WHEN miles <= 3 THEN 1.0 WHEN miles <= 6 THEN 0.88 WHEN miles <= 10 THEN 0.72 WHEN miles <= 15 THEN 0.52 WHEN miles <= 25 THEN 0.32 ELSE 0.12 END AS near,
  contains(lower(la), 'kent') OR contains(lower(postcode), 'kent') OR contains(lower(address), 'kent') AS named, list_contains(fmts, fmt) AS shared,
  CASE WHEN national_rank_england <= 100 OR gcse_rank_england <= 100 OR a_level_rank_england <= 100 THEN 1.0 WHEN national_rank_england <= 250 THEN 0.94 WHEN gcseAttainment8 >= 70 THEN 0.9 WHEN national_rank_england <= 500 THEN 0.85 ELSE 0.45 END AS acad,
  CASE WHEN gcseProgress8 IS NULL THEN 0.5 WHEN gcseProgress8 >= 0.7 THEN 1.0 WHEN gcseProgress8 >= 0.4 THEN 0.85 WHEN gcseProgress8 >= 0 THEN 0.65 ELSE 0.35 END AS growth,
  (tg AND schoolType = 'Grammar') OR (ti AND schoolType = 'Independent') OR (tc AND schoolType = 'Comprehensive') AS typed, lower(ofstedRating) AS r FROM c),
f AS (SELECT *, (CASE WHEN named THEN greatest(near, 0.85) ELSE near END::DOUBLE * 17.0::DOUBLE + CASE WHEN shared THEN 0.95 ELSE 0.4 END::DOUBLE * 25.0::DOUBLE + acad::DOUBLE * 25.0::DOUBLE
   + growth::DOUBLE * 9.0::DOUBLE + CASE WHEN typed THEN 0.9 WHEN ti AND schoolType = 'Grammar' THEN 0.75 ELSE 0.5 END::DOUBLE * 15.0::DOUBLE) / 91.0::DOUBLE * 100 AS fit,
  CASE WHEN r LIKE '%outstanding%' OR r LIKE '%excellent%' THEN 4 WHEN r LIKE '%good%' THEN 2 WHEN r LIKE '%requires improvement%' OR r LIKE '%special measures%' OR r LIKE '%inadequate%' THEN -30 ELSE 0 END AS adj FROM d)
SELECT id, cast(greatest(15, least(99, floor(fit + adj + 0.5))) AS INT) AS score, miles FROM f
"""


def _fits(spark, sf, limit):
    s = schools(spark, sf)
    return scoring.recommend(
        s, s.filter("k % 400 = 7").select("id"), removed=s.filter("k % 90 = 5").select("id"), places=["Kent"], ability="top_class",
        importance={"proximity": "very", "academicExcellence": "top_priority"}, limit=limit)


@query("sco11_fit_scores", 'SELECT id, score AS "matchScore", miles AS "distanceMiles" FROM fits', uses=(*SCHOOL, "fits"))
def fit_scores(spark, sf):
    return _fits(spark, sf, None).select("id", "matchScore", "distanceMiles")


@query("top02_recommended", 'SELECT id, score AS "matchScore" FROM fits ORDER BY score DESC, id LIMIT 10', uses=(*SCHOOL, "fits"))
def recommended(spark, sf):
    return _fits(spark, sf, 10).select("id", "matchScore")


# Two dozen users with different wishes: all levels of ability, asked-for formats, types, sexes and places, more or less travel.
USERS = 24
_USER = """SELECT u, CASE u % 5 WHEN 0 THEN 'top_class' WHEN 1 THEN 'above_average' WHEN 2 THEN 'average' WHEN 3 THEN 'below_average' ELSE 'NA' END AS ability, u % 3 = 0 AS travels, u % 4 = 1 AS asks_exam, u % 4 = 2 AS asks_type, u % 6 = 5 AS asks_girls, u % 2 = 0 AS kent"""
_ADVICE = f"""
s AS (SELECT *, {_SEX} LIKE '%boy%' AND {_SEX} NOT LIKE '%girl%' AS b, {_SEX} LIKE '%girl%' AND {_SEX} NOT LIKE '%boy%' AS g, {_SEX} LIKE '%mixed%' OR {_SEX} LIKE '%co-ed%' AS m, {_FMT} AS fmt FROM school),
w AS ({_USER} FROM range({USERS}) t(u)),
o AS (SELECT k % 240 AS u, bool_or(b) AS sb, bool_or(g) AS sg, bool_or(m AND NOT b AND NOT g) AS sm, bool_or(schoolType = 'Grammar') AS tg, bool_or(schoolType = 'Independent') AS ti, bool_or(schoolType = 'Comprehensive') AS tc,
  list(DISTINCT fmt) AS fmts, floor(avg(easting) + 0.5) AS ue, floor(avg(northing) + 0.5) AS un FROM s WHERE k % 240 < {USERS} GROUP BY 1),
x AS (SELECT w.*, o.* EXCLUDE (u, sg), sg OR asks_girls AS sg FROM w JOIN o ON o.u = w.u),
c AS (SELECT s.*, x.*, round(sqrt(cast((easting - ue) * (easting - ue) + (northing - un) * (northing - un) AS DOUBLE)) / 1609.344, 2) AS miles FROM s, x
  WHERE k % 240 <> u AND k % 90 <> u AND CASE WHEN (sb OR sg OR sm) AND NOT (sb AND sg AND sm) THEN (sb AND b) OR (sg AND g) OR (sm AND m) ELSE true END
   AND CASE WHEN asks_type THEN schoolType = 'Grammar' OR (tg AND schoolType = 'Grammar') OR (ti AND schoolType = 'Independent') OR (tc AND schoolType = 'Comprehensive') ELSE true END),
d AS (SELECT *, CASE WHEN miles <= 3 THEN 1.0 WHEN miles <= 6 THEN 0.88 WHEN miles <= 10 THEN 0.72 WHEN miles <= 15 THEN 0.52 WHEN miles <= 25 THEN 0.32 ELSE 0.12 END AS near,
  kent AND (contains(lower(la), 'kent') OR contains(lower(postcode), 'kent') OR contains(lower(address), 'kent')) AS named, list_contains(fmts, fmt) AS shared, contains(lower(entranceExamType), 'cem') OR contains(lower(coalesce(exam_consortium, '')), 'cem') AS met,
  CASE ability WHEN 'top_class' THEN CASE WHEN national_rank_england <= 100 OR gcse_rank_england <= 100 OR a_level_rank_england <= 100 THEN 1.0 WHEN national_rank_england <= 250 THEN 0.94 WHEN gcseAttainment8 >= 70 THEN 0.9 WHEN national_rank_england <= 500 THEN 0.85 ELSE 0.45 END
   WHEN 'above_average' THEN CASE WHEN gcseAttainment8 >= 60 THEN 0.92 WHEN national_rank_england <= 400 THEN 0.85 WHEN gcseProgress8 >= 0.35 THEN 0.85 ELSE 0.6 END
   WHEN 'NA' THEN CASE WHEN national_rank_england <= 100 THEN 0.95 WHEN gcseAttainment8 >= 65 THEN 0.85 WHEN gcseProgress8 >= 0.4 THEN 0.8 ELSE 0.5 END
   ELSE CASE WHEN gcseProgress8 >= 0.5 THEN 1.0 WHEN gcseProgress8 >= 0.2 THEN 0.85 WHEN gcseProgress8 >= 0 THEN 0.7 ELSE 0.4 END END AS acad,
  CASE WHEN gcseProgress8 IS NULL THEN 0.5 WHEN gcseProgress8 >= 0.7 THEN 1.0 WHEN gcseProgress8 >= 0.4 THEN 0.85 WHEN gcseProgress8 >= 0 THEN 0.65 ELSE 0.35 END AS growth,
  (tg AND schoolType = 'Grammar') OR (ti AND schoolType = 'Independent') OR (tc AND schoolType = 'Comprehensive') AS typed, lower(ofstedRating) AS r FROM c),
e AS (SELECT *, CASE WHEN asks_exam THEN CASE WHEN met THEN 1.0 WHEN shared THEN 0.8 ELSE 0.4 END ELSE CASE WHEN shared THEN 0.95 ELSE 0.4 END END AS exam,
  CASE WHEN asks_type THEN CASE WHEN schoolType = 'Grammar' THEN 1.0 WHEN typed THEN 0.7 ELSE 0.4 END ELSE CASE WHEN typed THEN 0.9 WHEN ti AND schoolType = 'Grammar' THEN 0.75 ELSE 0.5 END END AS kind,
  CASE WHEN travels THEN 17.0 ELSE 12.0 END::DOUBLE AS wn, CASE WHEN r LIKE '%outstanding%' OR r LIKE '%excellent%' THEN 4 WHEN r LIKE '%good%' THEN 2 WHEN r LIKE '%requires improvement%' OR r LIKE '%special measures%' OR r LIKE '%inadequate%' THEN -30 ELSE 0 END AS adj,
  CASE WHEN lower(trim(coalesce(exam_consortium, ''))) NOT IN ('', 'none', 'null', 'na') THEN exam_consortium WHEN entranceExamType <> '' AND lower(entranceExamType) <> 'none' THEN entranceExamType ELSE '' END AS lab,
  coalesce(exam_consortium, '') <> '' AND lower(exam_consortium) <> 'none' AS grp FROM d),
f AS (SELECT *, (CASE WHEN named THEN greatest(near, 0.85) ELSE near END::DOUBLE * wn + exam::DOUBLE * 25.0::DOUBLE + acad::DOUBLE * 21.25::DOUBLE + growth::DOUBLE * 9.0::DOUBLE + kind::DOUBLE * 15.0::DOUBLE) / (wn + 25.0::DOUBLE + 21.25::DOUBLE + 9.0::DOUBLE + 15.0::DOUBLE) * 100 AS fit,
  CASE WHEN asks_exam THEN CASE WHEN met THEN 'Matches requested exam format: ' || CASE WHEN lab <> '' THEN lab ELSE coalesce(nullif(exam_consortium, ''), entranceExamType) END WHEN shared THEN 'Shares exam format with shortlisted schools (' || CASE WHEN lab <> '' THEN lab ELSE 'Shortlist compatible admissions format' END || ')' END
   ELSE CASE WHEN shared THEN CASE WHEN grp THEN 'Shares ' || exam_consortium || ' admissions format' ELSE 'Matches entrance exam format: ' || CASE WHEN lab <> '' THEN lab ELSE entranceExamType END END END END AS said_exam,
  CASE WHEN asks_type THEN CASE WHEN schoolType = 'Grammar' THEN 'Matches requested school type: ' || schoolType WHEN typed THEN 'Shares school type with shortlisted schools (' || schoolType || ')' END
   ELSE CASE WHEN typed THEN 'Matches school type of your shortlisted schools (' || schoolType || ')' END END AS said_kind FROM e),
z AS (SELECT u AS user_id, id, cast(greatest(15, least(99, floor(fit + adj + CASE WHEN asks_girls AND g THEN 8 ELSE 0 END + 0.5))) AS INT) AS score, miles, concat_ws('|', said_exam, said_kind) AS said FROM f)
"""


def _advice(spark, sf, limit):
    s = schools(spark, sf)
    yes = lambda cond, *words: F.when(F.expr(cond), F.array(*[F.lit(w) for w in words]))
    users = spark.sql(_USER + f" FROM (SELECT id AS u FROM range({USERS}))")
    users = users.select(F.col("u").alias("user_id"), "ability", F.when(F.col("travels"), "very").alias("proximity"), yes("asks_exam", " CEM ").alias("exam_formats"), yes("asks_type", "Grammar").alias("types"),
                         yes("asks_girls", "girls").alias("sexes"), yes("kent", "Kent").alias("places"))
    keeps = s.filter(f"k % 240 < {USERS}").select((F.col("k") % 240).alias("user_id"), "id")
    drops = s.filter(f"k % 90 < {USERS}").select((F.col("k") % 90).alias("user_id"), "id")
    said = F.array_join(F.filter("reasons", lambda r: r.startswith("Matches ") | r.startswith("Shares ")), "|").alias("said")
    out = scoring.recommend_many(s, users, keeps, drops, limit=limit)
    return out.select("user_id", "id", F.col("matchScore").alias("score"), F.col("distanceMiles").alias("miles"), said)


@query("sco11_many_users", f"WITH {_ADVICE} SELECT * FROM z", uses=SCHOOL)
def many_users(spark, sf):
    return _advice(spark, sf, None)


@query("top02_many_users", f"WITH {_ADVICE} SELECT user_id, id, score, said FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS n FROM z) WHERE n <= 10", uses=SCHOOL)
def many_users_best(spark, sf):
    return _advice(spark, sf, 10).drop("miles")


@query("agg11_saved_profile", f"""WITH s AS (SELECT *, {_SEX} AS x, {_FMT} AS fmt FROM school WHERE k % 400 = 7)
SELECT array_to_string(list_sort(list(DISTINCT CASE WHEN x LIKE '%girl%' AND x NOT LIKE '%boy%' THEN 'girls' WHEN x LIKE '%boy%' AND x NOT LIKE '%girl%' THEN 'boys' WHEN x LIKE '%mixed%' OR x LIKE '%co-ed%' THEN 'mixed' END)), ',') AS sexes,
 array_to_string(list_sort(list(DISTINCT lower(schoolType))), ',') AS types, array_to_string(list_sort(list(DISTINCT fmt)), ',') AS formats, round(coalesce(avg(gcseAttainment8), 65), 6) AS attainment, count(*) AS n FROM s""", uses=SCHOOL)
def saved_profile(spark, sf):
    p = scoring.profile(schools(spark, sf).filter("k % 400 = 7"))
    return p.select(*[F.array_join(c, ",").alias(c) for c in ("sexes", "types", "formats")], F.round("attainment", 6).alias("attainment"), "n")


@query("sco12_place_scores", """WITH s AS (SELECT *, upper(trim(postcode)) AS pc FROM school),
a AS (SELECT *, split_part(pc, ' ', 1) AS sec, CASE WHEN pc = 'EN5 4DQ' THEN 1.0 WHEN split_part(pc, ' ', 1) = 'EN5' THEN 0.95 WHEN regexp_replace(pc, '[0-9\\s]', '', 'g') = 'ENDQ' THEN 0.75
   WHEN contains(lower(trim(la)), 'en5 4dq') THEN 0.85 WHEN contains(lower(trim(address)), 'en5 4dq') THEN 0.65 ELSE 0.0 END AS s0, sqrt(cast((easting - 530000) * (easting - 530000) + (northing - 180000) * (northing - 180000) AS DOUBLE)) / 1000 AS km FROM s),
b AS (SELECT *, CASE WHEN lower(trim(la)) = 'barnet' AND s0 < 0.8 THEN 0.8 ELSE s0 END AS s1 FROM a), c AS (SELECT *, CASE WHEN sec = 'EN7' AND s1 < 0.9 THEN 0.9 ELSE s1 END AS s2 FROM b)
SELECT id, cast(greatest(s2, CASE WHEN km <= 3 THEN 1.0 WHEN km <= 7 THEN 0.85 WHEN km <= 15 THEN 0.65 WHEN km <= 25 THEN 0.4 ELSE 0 END) AS DOUBLE) AS score FROM c""", uses=SCHOOL)
def place_scores(spark, sf):
    near = [{"name": "Saved", "la": "Barnet", "postcode": "en7 1AA", "easting": 530000, "northing": 180000}]
    return schools(spark, sf).select("id", scoring.place_score("EN5 4DQ", near)["score"].alias("score"))


@query("sco13_verification_confidence", """SELECT id, CASE verification_status WHEN 'dead_website' THEN 45 WHEN 'missing_website' THEN 40 WHEN 'crawl_stuck' THEN 35
 ELSE CASE WHEN len(tags) = 0 THEN 95 ELSE greatest(40, 90 - 15 * len(tags)) END END AS confidence FROM school""", uses=SCHOOL)
def verification_confidence(spark, sf):
    return schools(spark, sf).select("id", scoring.verification_confidence(F.col("verification_status"), F.size("verification_tags")).alias("confidence"))
