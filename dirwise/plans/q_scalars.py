"""Scalar functions over whole input columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirwise.functions import dates, geo, markup, names, payloads, sets, values
from dirwise.plans.fixtures import entities, table, view
from dirwise.plans.registry import query

# Pieces of check SQL shared by several queries.
D_UNIT = "regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]', '', 'g')"


def d_unit(c: str, least: int = 4) -> str:
    clean = D_UNIT.format(c=c)
    return (f"CASE WHEN length({clean}) <= {least} THEN {clean} ELSE left({clean}, length({clean}) - 3) || ' ' || right({clean}, 3) END")


def d_phone(c: str) -> str:
    s = f"regexp_replace(replace(coalesce({c}, ''), '(0)', ''), '[^0-9+]', '', 'g')"
    return (f"regexp_replace(CASE WHEN {s} LIKE '+44%' THEN '0' || substr({s}, 4) "
            f"WHEN {s} LIKE '44%' AND length({s}) > 10 THEN '0' || substr({s}, 3) "
            f"WHEN {s} LIKE '0044%' THEN '0' || substr({s}, 5) ELSE {s} END, '[^0-9]', '', 'g')")


def d_na(c: str) -> str:
    s = f"lower(trim({c}))"
    exact = ", ".join("'" + w + "'" for w in values.NA_EXACT)
    starts = " OR ".join(f"{s} LIKE '{w}%'" for w in values.NA_PREFIXES)
    return f"({c} IS NULL OR {s} = '' OR {s} IN ({exact}) OR {starts})"


def d_name(c: str, variant: str = "canonical") -> str:
    low = f"lower(coalesce({c}, ''))"
    words = "|".join(names.NAME_WORDS.get(variant, ()))
    if variant == "canonical":
        return (f"regexp_replace(regexp_replace(regexp_replace({low}, '^the\\s+', ''), '\\b({words})\\b', '', 'g'), "
                "'[^a-z0-9]', '', 'g')")
    if variant == "alphanumeric":
        return f"regexp_replace({low}, '[^a-z0-9]', '', 'g')"
    return (f"trim(regexp_replace(regexp_replace(regexp_replace({low}, '[^a-z0-9]', ' ', 'g'), '\\b({words})\\b', '', 'g'), "
            "'\\s+', ' ', 'g'))")


def d_gender(c: str) -> str:
    v = f"lower(trim(coalesce({c}, '')))"
    return (f"CASE WHEN {v} LIKE '%girl%' OR {v} = 'f' THEN 'Girls' WHEN {v} LIKE '%boy%' OR {v} = 'm' THEN 'Boys' ELSE 'Mixed' END")


def d_type(kind: str = "schoolType", name: str = "name", rating: str = "ofstedRating") -> str:
    t, n = f"lower(trim(coalesce({kind}, '')))", f"lower(coalesce({name}, ''))"
    sel = " OR ".join(f"{n} LIKE '%" + w.replace("'", "''") + "%'" for w in names.SELECTIVE_NAMES)
    return (f"CASE WHEN {t} LIKE '%independent%' OR {t} LIKE '%isi%' OR coalesce({rating}, '') LIKE '%ISI%' THEN 'Independent' "
            f"WHEN {t} LIKE '%grammar%' OR {sel} THEN 'Grammar' ELSE 'Comprehensive' END")


def d_grams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}), 1)), lambda i: substr({c}, i, 2)))"


def d_dice(a: str, b: str) -> str:
    x, y = d_grams(a), d_grams(b)
    return (f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE "
            f"2.0 * len(list_intersect({x}, {y})) / greatest(len({x}) + len({y}), 1) END")


def d_jaccard(a: str, b: str) -> str:
    x, y = d_grams(a), d_grams(b)
    return (f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 3 OR length({b}) < 3 THEN 0.0 ELSE "
            f"len(list_intersect({x}, {y})) * 1.0 / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END")


@query("scl01_postcode_shapes", f"""
WITH s AS (SELECT id, postcode, {d_unit('postcode')} AS unit, {d_unit('postcode', 3)} AS split_form,
  upper(regexp_replace(coalesce(postcode, ''), '\\s+', '', 'g')) AS compact FROM entity)
SELECT id, unit, split_form, compact,
  CASE WHEN postcode IS NULL OR postcode = '' THEN NULL WHEN length(compact) NOT BETWEEN 5 AND 8 THEN trim(postcode)
       ELSE left(compact, length(compact) - 3) || ' ' || right(compact, 3) END AS strict_form,
  split_part(unit, ' ', 1) AS outcode,
  regexp_matches(regexp_replace(upper(trim(coalesce(postcode, ''))), '\\s+', ' ', 'g'),
     '^[A-Z][A-Z]?[0-9][A-Z0-9]?( ?[0-9][A-Z][A-Z])?$') AS valid
FROM s""", uses=("entity",))
def postcode_shapes(spark, sf):
    return view(spark, sf, "entity").select(
        "id", names.postcode("postcode").alias("unit"), names.postcode("postcode", "split").alias("split_form"),
        names.postcode("postcode", "compact").alias("compact"), names.postcode("postcode", "strict").alias("strict_form"),
        names.outcode("postcode").alias("outcode"), names.is_postcode("postcode").alias("valid"),
    )


@query("scl04_phone_forms", f"""
SELECT id, {d_phone('phone')} AS digits,
  CASE WHEN length(d) = 11 AND d LIKE '020%' THEN left(d, 3) || ' ' || substr(d, 4, 4) || ' ' || substr(d, 8)
       WHEN length(d) = 11 THEN left(d, 5) || ' ' || substr(d, 6) ELSE trim(coalesce(phone, '')) END AS display
FROM (SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS d FROM entity)""", uses=("entity",))
def phone_forms(spark, sf):
    return view(spark, sf, "entity").select("id", names.phone("phone").alias("digits"), names.phone_display("phone").alias("display"))


@query("scl05_gender_forms", f"""
SELECT id, {d_gender('gender')} AS class,
  CASE WHEN gender = '' THEN NULL WHEN g LIKE '%boys (11-16)%' OR g LIKE '%boys / mixed%' OR g LIKE 'boy%' OR g = 'male' THEN 'Boys'
       WHEN g LIKE '%girls / mixed prep%' OR g LIKE 'girl%' OR g = 'female' THEN 'Girls' ELSE 'Mixed' END AS main_policy,
  CASE WHEN g LIKE '%boys (11-16)%' OR g LIKE '%boys / mixed%' THEN 'Co-educational / Mixed Sixth Form (16-18)' END AS sixth_form
FROM (SELECT *, lower(trim(gender)) AS g FROM entity)""", uses=("entity",))
def gender_forms(spark, sf):
    p = names.gender_policy("gender")
    return view(spark, sf, "entity").select(
        "id", names.gender("gender").alias("class"), p["gender"].alias("main_policy"), p["sixth_form"].alias("sixth_form"))


@query("scl06_type_classes", f"SELECT id, {d_type()} AS type_class FROM entity", uses=("entity",))
def type_classes(spark, sf):
    return view(spark, sf, "entity").select("id", names.org_type("schoolType", "name", "ofstedRating").alias("type_class"))


@query("scl06_register_type_classes", """
SELECT URN AS urn, CASE WHEN lower(SCHNAME) LIKE '%grammar%' OR lower(ADMPOL) = 'selective' THEN 'Grammar'
  WHEN lower(SCHOOLTYPE) LIKE '%independent%' OR lower(SCHOOLTYPE) LIKE '%public%'
    OR (lower(SCHNAME) LIKE '%college%' AND lower(SCHOOLTYPE) LIKE '%other%') THEN 'Independent'
  WHEN lower(SCHOOLTYPE) LIKE '%special%' OR lower(SCHOOLTYPE) LIKE '%pupil referral%' THEN 'Special'
  ELSE 'Comprehensive' END AS type_class FROM register""", uses=("register",))
def register_type_classes(spark, sf):
    return view(spark, sf, "register").select(
        F.col("URN").alias("urn"), names.register_type("SCHOOLTYPE", "SCHNAME", "ADMPOL").alias("type_class"))


@query("scl07_exam_kinds", """
SELECT id, CASE WHEN v = '' THEN 'Comprehensive'
  WHEN v LIKE '%iseb%' OR v LIKE '%common pre-test%' THEN 'ISEB Common Pre-Test'
  WHEN v LIKE '%gl assessment%' OR v LIKE '%gl %' OR v LIKE '%gl 11%' OR v LIKE '%kent test%' OR v LIKE '%bexley%' OR v LIKE '%sutton set%' THEN 'GL Assessment'
  WHEN v LIKE '%consortium%' OR v LIKE '%london 11+%' THEN 'London 11+ Consortium'
  WHEN v LIKE '%csse%' OR v LIKE '%essex%' THEN 'CSSE 11+ Exam' WHEN v LIKE '%cem%' THEN 'CEM Assessment'
  WHEN v LIKE '%school%' AND v LIKE '%own%' THEN 'School-Own Exam'
  WHEN v LIKE '%non-selective%' OR v LIKE '%comprehensive%' OR v LIKE '%distance%' OR v LIKE '%sibling%' OR v LIKE '%pan%' THEN 'Comprehensive'
  ELSE trim(entranceExamType) END AS exam_kind
FROM (SELECT *, lower(trim(coalesce(entranceExamType, ''))) AS v FROM entity)""", uses=("entity",))
def exam_kinds(spark, sf):
    return view(spark, sf, "entity").select("id", names.exam_kind("entranceExamType").alias("exam_kind"))


@query("scl08_name_keys", f"""
SELECT id, {d_name('name')} AS canonical, {d_name('name', 'dedup')} AS dedup, {d_name('name', 'ranking')} AS ranking,
  {d_name('name', 'register')} AS register_form, {d_name('name', 'alphanumeric')} AS alphanumeric FROM entity""", uses=("entity",))
def name_keys(spark, sf):
    return view(spark, sf, "entity").select(
        "id", *[names.name_key("name", v).alias(a) for v, a in (("canonical", "canonical"), ("dedup", "dedup"), ("ranking", "ranking"),
                                                                ("register", "register_form"), ("alphanumeric", "alphanumeric"))])


@query("scl09_clean_urls", """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND x NOT LIKE 'utm\\_%' ESCAPE '\\'
   AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'ref')), '&') AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path IN ('', '/') AND kept = '' AND frag = '' THEN ''
  ELSE CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || frag END AS clean_url, host
FROM k""")
def clean_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.clean_url("url").alias("clean_url"), markup.host_of("url").alias("host"))


@query("scl09_entity_urls", """
WITH b AS (SELECT id, trim(website) AS w FROM entity),
f AS (SELECT id, w, CASE WHEN w LIKE 'http://%' OR w LIKE 'https://%' THEN w ELSE 'https://' || w END AS full_url FROM b),
p AS (SELECT id, w, full_url, lower(regexp_extract(full_url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(full_url, '://([^/?#]*)', 1)) AS host,
  regexp_extract(full_url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(full_url, '\\?([^#]*)', 1) AS q, regexp_extract(full_url, '(#.*)$', 1) AS frag FROM f),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND x NOT LIKE 'utm\\_%' ESCAPE '\\'
   AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'ref')), '&') AS kept FROM p)
SELECT id, CASE WHEN w = '' OR w IS NULL THEN NULL ELSE scheme || '://' || host || CASE WHEN path IN ('', '/') AND kept = '' AND frag = '' THEN ''
  ELSE CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || frag END END AS clean_url
FROM k""", uses=("entity",))
def entity_urls(spark, sf):
    return view(spark, sf, "entity").select("id", names.clean_url("website").alias("clean_url"))


@query("scl10_fee_numbers", """
WITH f AS (SELECT id, try_cast(nullif(regexp_extract(replace(coalesce(feesTermly, ''), ',', ''), '[0-9]+'), '') AS BIGINT) AS n FROM entity)
SELECT id, CASE WHEN n > 100 AND n < 100000 THEN n END AS termly, CASE WHEN n BETWEEN 200 AND 50000 THEN n END AS termly_strict,
  CASE WHEN n BETWEEN 200 AND 50000 THEN n * 3 END AS annual_strict FROM f""", uses=("entity",))
def fee_numbers(spark, sf):
    strict = names.fee_number("feesTermly", 200, 50000)
    return view(spark, sf, "entity").select(
        "id", names.fee_number("feesTermly").alias("termly"), strict.alias("termly_strict"), (strict * 3).alias("annual_strict"))


_LONG = """(SELECT id, field, v FROM entity UNPIVOT INCLUDE NULLS (v FOR field IN
  (d_registrationOpen, d_registrationDeadline, d_examDate, d_resultsDate, d_offersAcceptance, d_acceptanceDeadline)))"""


def milestone_rows(spark, sf):
    e = view(spark, sf, "entity")
    cols = ["d_registrationOpen", "d_registrationDeadline", "d_examDate", "d_resultsDate", "d_offersAcceptance", "d_acceptanceDeadline"]
    return e.unpivot("id", cols, "field", "v")


@query("scl11_missing_values", f"SELECT id, field, {d_na('v')} AS missing FROM {_LONG}", uses=("entity",))
def missing_values(spark, sf):
    return milestone_rows(spark, sf).select("id", "field", values.is_na("v").alias("missing"))


def d_timeline(c: str) -> tuple[str, str, str, str]:
    """(usable, year, month, day) SQL of a timeline date."""
    s = f"trim({c})"
    low = f"lower({s})"
    rel = " OR ".join(f"{low} LIKE '{w}%'" for w in dates.RELATIVE_STARTS)
    ok = f"(NOT {d_na(c)} AND NOT ({rel} OR {low} LIKE '%non-selective%'))"
    num = "\\b([0-9]{1,2})[/-]([0-9]{1,2})[/-](202[0-9])\\b"
    n = [f"try_cast(nullif(regexp_extract({s}, '{num}', {i}), '') AS INT)" for i in (1, 2, 3)]
    isnum = f"coalesce({n[0]} BETWEEN 1 AND 31 AND {n[1]} BETWEEN 1 AND 12, false)"
    months = " ".join(f"WHEN regexp_matches({low}, '\\b({'|'.join(w)})\\b') THEN {i}" for i, w in enumerate(dates.MONTH_WORDS, 1))
    month = f"(CASE {months} WHEN {low} LIKE '%autumn%' THEN 10 WHEN {low} LIKE '%spring%' THEN 2 WHEN {low} LIKE '%summer%' THEN 6 END)"
    year = f"coalesce(try_cast(nullif(regexp_extract({s}, '\\b(202[0-9])\\b', 1), '') AS INT), CASE WHEN {month} <= 4 THEN 2027 ELSE 2026 END)"
    d = f"try_cast(nullif(regexp_extract({s}, '\\b([0-9]{{1,2}})(st|nd|rd|th)?\\b', 1), '') AS INT)"
    day = f"CASE WHEN {d} BETWEEN 1 AND 31 THEN {d} ELSE 15 END"
    return (ok, f"CASE WHEN {isnum} THEN {n[2]} ELSE {year} END", f"CASE WHEN {isnum} THEN {n[1]} ELSE coalesce({month}, 6) END",
            f"CASE WHEN {isnum} THEN {n[0]} ELSE {day} END")


_ok, _y, _m, _d = d_timeline("v")


@query("scl12_timeline_dates", f"""
SELECT id, field, y AS year, m AS month, d AS day, make_date(y, m, 1) + (d - 1) AS day_date FROM
 (SELECT id, field, CASE WHEN {_ok} THEN {_y} END AS y, CASE WHEN {_ok} THEN {_m} END AS m, CASE WHEN {_ok} THEN {_d} END AS d FROM {_LONG})""",
       uses=("entity",))
def timeline_dates(spark, sf):
    t = dates.timeline_date("v")
    return milestone_rows(spark, sf).select("id", "field", t.alias("t")).select(
        "id", "field", F.col("t.year").alias("year"), F.col("t.month").alias("month"), F.col("t.day").alias("day"),
        F.col("t.date").alias("day_date"))


def d_admissions(c: str) -> str:
    """SQL date of an admissions date text."""
    s = f"trim({c})"
    mon = dates.FULL_MONTHS
    num = "list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower({}))"
    lf, mf, iso = f"(?i)\\b([0-9]{{1,2}})\\s+({mon})\\s+([0-9]{{4}})\\b", f"(?i)\\b({mon})\\s+([0-9]{{4}})\\b", "\\b([0-9]{4})-([0-9]{2})-([0-9]{2})\\b"

    def x(p, i):
        return f"regexp_extract({s}, '{p}', {i})"

    def day(y, m, d):
        return (f"CASE WHEN try_cast({d} AS INT) BETWEEN 1 AND 31 AND ({m}) BETWEEN 1 AND 12 THEN "
                f"make_date(cast({y} AS INT), cast({m} AS INT), 1) + (cast({d} AS INT) - 1) END")

    return (f"CASE WHEN lower({s}) IN ('', 'null', 'tbd', 'autumn term') OR {c} IS NULL THEN NULL "
            f"WHEN regexp_matches({s}, '{lf}') THEN {day(x(lf, 3), num.format(x(lf, 2)), x(lf, 1))} "
            f"WHEN regexp_matches({s}, '{mf}') THEN {day(x(mf, 2), num.format(x(mf, 1)), '1')} "
            f"WHEN regexp_matches({s}, '{iso}') THEN {day(x(iso, 1), 'cast(' + x(iso, 2) + ' AS INT)', x(iso, 3))} END")


@query("scl13_admissions_dates", f"""
SELECT id, field, {d_admissions('v')} AS day_date, coalesce(regexp_matches(v, '\\b(2022|2023|2024|2025)\\b'), false) AS stale FROM {_LONG}""",
       uses=("entity",))
def admissions_dates(spark, sf):
    return milestone_rows(spark, sf).select(
        "id", "field", dates.admissions_date("v").alias("day_date"), dates.is_stale("v").alias("stale"))


def d_roll(c: str, keep: str = "") -> str:
    """Nested SELECTs that apply the rewrites one after the other."""
    cols = f"{keep}, " if keep else ""
    sql = f"SELECT {cols}v AS s0, 0 AS n0 FROM {c}"
    for i, (_, pat, kept, year) in enumerate(dates.ROLL_FORWARD):
        repl = kept.replace("$", "\\") + year
        sql = (f"SELECT {cols}regexp_replace(s{i}, '{pat}', '{repl}', 'g') AS s{i + 1}, "
               f"n{i} + len(regexp_extract_all(coalesce(s{i}, ''), '{pat}')) AS n{i + 1} FROM ({sql})")
    return sql


@query("scl15_rolled_dates", f"SELECT id, field, s6 AS value, n6 AS rewrites FROM ({d_roll(_LONG, 'id, field')})", uses=("entity",))
def rolled_dates(spark, sf):
    return milestone_rows(spark, sf).select("id", "field", dates.roll_forward("v").alias("r")).select(
        "id", "field", F.col("r.value").alias("value"), F.size("r.reasons").alias("rewrites"))


_okb, _yb, _mb, _db = d_timeline("b")


def with_previous(e, *cols):
    """Every row beside the row numbered just before it."""
    return e.join(e.select((F.col("k") + 1).alias("k"), *[F.col(c).alias(f"p_{c}") for c in cols]), "k")


@query("scl16_same_meaning", f"""
WITH nb AS (SELECT e.id, e.k, e.phone AS pa, p.phone AS pb, e.postcode AS ca, p.postcode AS cb, e.gender AS ga, p.gender AS gb,
  e.d_resultsDate AS v, p.d_resultsDate AS b FROM entity e JOIN entity p ON p.k = e.k - 1),
x AS (SELECT *, {d_phone('pa')} AS na, {d_phone('pb')} AS nbp FROM nb)
SELECT id,
 CASE WHEN coalesce(pa,'')='' OR coalesce(pb,'')='' THEN coalesce(pa,'')=coalesce(pb,'') ELSE lower(trim(pa))=lower(trim(pb)) OR (na<>'' AND nbp<>'' AND (na=nbp OR right(na,8)=right(nbp,8))) END AS phone_same,
 CASE WHEN coalesce(ca,'')='' OR coalesce(cb,'')='' THEN coalesce(ca,'')=coalesce(cb,'') ELSE lower(trim(ca))=lower(trim(cb)) OR {d_unit('ca', 3)} = {d_unit('cb', 3)} END AS postcode_same,
 CASE WHEN coalesce(ga,'')='' OR coalesce(gb,'')='' THEN coalesce(ga,'')=coalesce(gb,'') ELSE lower(trim(ga))=lower(trim(gb)) OR {d_gender('ga')} = {d_gender('gb')} END AS gender_same,
 CASE WHEN v='' OR b='' THEN v=b ELSE lower(trim(v))=lower(trim(b)) OR regexp_replace(lower(trim(v)),'[^a-z0-9_]','','g')=regexp_replace(lower(trim(b)),'[^a-z0-9_]','','g')
   OR ({_ok} AND {_okb} AND ({_y})=({_yb}) AND ({_m})=({_mb}) AND ({_d})=({_db})) END AS date_same
FROM x""", uses=("entity",))
def same_meaning(spark, sf):
    pairs = with_previous(view(spark, sf, "entity"), "phone", "postcode", "gender", "d_resultsDate")
    return pairs.select(
        "id", dates.same_meaning("phone", "phone", "p_phone").alias("phone_same"),
        dates.same_meaning("postcode", "postcode", "p_postcode").alias("postcode_same"),
        dates.same_meaning("gender", "gender", "p_gender").alias("gender_same"),
        dates.same_meaning("resultsDate", "d_resultsDate", "p_d_resultsDate").alias("date_same"))


@query("scl17_name_similarity", f"""
WITH nb AS (SELECT id, k, {d_name('name', 'alphanumeric')} AS a, {d_name('name', 'dedup')} AS c FROM entity),
x AS (SELECT nb.id, nb.a, p.a AS b, nb.c, p.c AS d FROM nb JOIN nb p ON p.k = nb.k - 1)
SELECT id, round({d_jaccard('a', 'b')}, 6) AS jaccard, round({d_dice('c', 'd')}, 6) AS dice FROM x""", uses=("entity",))
def name_similarity(spark, sf):
    e = view(spark, sf, "entity").select("id", "k", names.name_key("name", "alphanumeric").alias("a"), names.name_key("name", "dedup").alias("c"))
    return with_previous(e, "a", "c").select("id", F.round(sets.jaccard("a", "p_a"), 6).alias("jaccard"), F.round(sets.dice("c", "p_c"), 6).alias("dice"))


@query("scl19_distances", """
WITH p AS (SELECT id, easting e, northing n, 500000 + (k * 7) % 50000 AS e2, 160000 + (k * 5) % 30000 AS n2,
  50 + (k % 800) / 100.0 AS la1, -6 + (k % 700) / 100.0 AS lo1, 50 + (k * 3 % 800) / 100.0 AS la2, -6 + (k * 3 % 700) / 100.0 AS lo2 FROM entity),
h AS (SELECT *, pow(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo1) / 2), 2) AS a,
  sqrt(cast((e2 - e) * (e2 - e) + (n2 - n) * (n2 - n) AS DOUBLE)) AS m FROM p)
SELECT id, round(2 * 3958.7613 * atan2(sqrt(a), sqrt(1 - a)), 2) AS arc_miles, round(2 * 6371.0088 * atan2(sqrt(a), sqrt(1 - a)), 2) AS arc_km,
  round(m / 1609.344, 2) AS grid_miles, round(m / 1000, 2) AS grid_km FROM h""", uses=("entity",))
def distances(spark, sf):
    k = F.col("k")
    e = view(spark, sf, "entity").select(
        "id", "easting", "northing", (500000 + (k * 7) % 50000).alias("e2"), (160000 + (k * 5) % 30000).alias("n2"),
        (50 + (k % 800) / 100).alias("la1"), (-6 + (k % 700) / 100).alias("lo1"),
        (50 + (k * 3 % 800) / 100).alias("la2"), (-6 + (k * 3 % 700) / 100).alias("lo2"))
    return e.select(
        "id", geo.haversine("la1", "lo1", "la2", "lo2").alias("arc_miles"), geo.haversine("la1", "lo1", "la2", "lo2", geo.EARTH_KM).alias("arc_km"),
        geo.grid_miles("easting", "northing", "e2", "n2").alias("grid_miles"), geo.grid_km("easting", "northing", "e2", "n2").alias("grid_km"))


_A, _B, _F0 = geo.AIRY_A, geo.AIRY_B, geo.SCALE
_N1 = geo.THIRD


def d_arc(lat: str) -> str:
    n, n2, n3 = _N1, _N1**2, _N1**3
    d, s = f"({lat} - {geo.ORIGIN_LAT!r})", f"({lat} + {geo.ORIGIN_LAT!r})"
    return (f"({_B * _F0!r} * ({1 + n + 1.25 * n2 + 1.25 * n3!r} * {d} - {3 * n + 3 * n2 + 2.625 * n3!r} * sin({d}) * cos({s}) "
            f"+ {1.875 * n2 + 1.875 * n3!r} * sin(2 * {d}) * cos(2 * {s}) - {35 / 24 * n3!r} * sin(3 * {d}) * cos(3 * {s})))")


def _foot(rounds: int) -> str:
    sql = f"SELECT id, cast(easting AS DOUBLE) e, cast(northing AS DOUBLE) n, (northing + 100000.0) / {_A * _F0!r} + {geo.ORIGIN_LAT!r} AS lat FROM entity"
    for _ in range(rounds):
        sql = f"SELECT id, e, n, lat + (n + 100000.0 - {d_arc('lat')}) / {_A * _F0!r} AS lat FROM ({sql})"
    return sql


@query("scl21_grid_to_angles", f"""
WITH f AS ({_foot(8)}),
r AS (SELECT *, {_A * _F0!r} / sqrt(1 - {geo.E2!r} * sin(lat) * sin(lat)) AS nu, {_A * _F0 * (1 - geo.E2)!r} / pow(1 - {geo.E2!r} * sin(lat) * sin(lat), 1.5) AS rho,
  tan(lat) AS t, e - 400000.0 AS de FROM f),
s AS (SELECT *, nu / rho - 1 AS eta2 FROM r)
SELECT id, round(degrees(lat - t / (2 * rho * nu) * pow(de, 2) + t / (24 * rho * pow(nu, 3)) * (5 + 3*t*t + eta2 - 9*t*t*eta2) * pow(de, 4)
   - t / (720 * rho * pow(nu, 5)) * (61 + 90*t*t + 45*pow(t, 4)) * pow(de, 6)), 6) AS lat,
 round(degrees({geo.ORIGIN_LON!r} + de / (cos(lat) * nu) - pow(de, 3) / (6 * cos(lat) * pow(nu, 3)) * (nu / rho + 2*t*t)
   + pow(de, 5) / (120 * cos(lat) * pow(nu, 5)) * (5 + 28*t*t + 24*pow(t, 4))), 6) AS lon FROM s""", uses=("entity",))
def grid_to_angles(spark, sf):
    c = view(spark, sf, "entity").select("id", geo.grid_to_latlon("easting", "northing").alias("c"))
    return c.select("id", "c.lat", "c.lon")


@query("scl22_angles_to_grid", f"""
WITH p AS (SELECT id, radians(50 + (k % 800) / 100.0) AS lat, radians(-6 + (k % 700) / 100.0) - {geo.ORIGIN_LON!r} AS l FROM entity),
r AS (SELECT *, {_A * _F0!r} / sqrt(1 - {geo.E2!r} * sin(lat) * sin(lat)) AS nu, {_A * _F0 * (1 - geo.E2)!r} / pow(1 - {geo.E2!r} * sin(lat) * sin(lat), 1.5) AS rho,
  tan(lat) AS t FROM p),
s AS (SELECT *, nu / rho - 1 AS eta2 FROM r)
SELECT id, cast(floor(400000 + nu*cos(lat)*l + nu/6*pow(cos(lat),3)*(nu/rho - t*t)*pow(l,3)
    + nu/120*pow(cos(lat),5)*(5 - 18*t*t + pow(t,4) + 14*eta2 - 58*t*t*eta2)*pow(l,5) + 0.5) AS BIGINT) AS easting,
  cast(floor({d_arc('lat')} - 100000 + nu/2*sin(lat)*cos(lat)*l*l + nu/24*sin(lat)*pow(cos(lat),3)*(5 - t*t + 9*eta2)*pow(l,4)
    + nu/720*sin(lat)*pow(cos(lat),5)*(61 - 58*t*t + pow(t,4))*pow(l,6) + 0.5) AS BIGINT) AS northing FROM s""", uses=("entity",))
def angles_to_grid(spark, sf):
    k = F.col("k")
    e = view(spark, sf, "entity").select("id", (50 + (k % 800) / 100).alias("lat"), (-6 + (k % 700) / 100).alias("lon"))
    return e.select("id", geo.latlon_to_grid("lat", "lon").alias("g")).select("id", "g.easting", "g.northing")


@query("scl23_regions", f"""
SELECT id, CASE {' '.join(f"WHEN regexp_matches(lower(la), '{w}') THEN '{r}'" for r, w in names.REGION_DISTRICTS)} ELSE 'Greater London' END AS by_district,
  CASE {' '.join(f"WHEN lower(region) LIKE '%{w}%' THEN '{r}'" for w, r in names.REGION_TEXTS)} END AS by_text,
  CASE WHEN la IN ({', '.join("'" + d + "'" for d in names.LONDON_DISTRICTS)}) THEN 'Greater London' ELSE 'England' END AS capital,
  CASE WHEN lower(region) LIKE '%london%' OR lower(la) LIKE '%london%' THEN 'London' WHEN la <> '' AND la NOT IN ({', '.join("'" + d + "'" for d in names.COUNTIES)}) THEN la
    ELSE 'elsewhere' END AS city_rule
FROM entity""", uses=("entity",))
def regions(spark, sf):
    place = names.place_of("region", "la", F.lit(""), F.lit(""))
    return view(spark, sf, "entity").select(
        "id", names.region_of("la").alias("by_district"), names.region_of("la", "region").alias("by_text"),
        names.in_london("la").alias("capital"),
        F.when(place["city"] == names.UNKNOWN_PLACE, "elsewhere").otherwise(place["city"]).alias("city_rule"))


@query("scl24_register_addresses", """
SELECT URN AS urn, array_to_string(list_filter([STREET, LOCALITY, ADDRESS3, TOWN], lambda x: x IS NOT NULL AND trim(x) <> ''), ', ') AS address FROM register""",
       uses=("register",))
def register_addresses(spark, sf):
    return view(spark, sf, "register").select(F.col("URN").alias("urn"), names.join_address("STREET", "LOCALITY", "ADDRESS3", "TOWN").alias("address"))


def d_better(o: str, n: str) -> str:
    street = names.STREET
    empty = "('', 'N/A', 'null', 'undefined')"
    cur, nxt = f"trim(coalesce({o}, ''))", f"trim(coalesce({n}, ''))"

    def parts(a):
        return f"len(list_filter(regexp_split_to_array({a}, '[,;\\n]+'), lambda z: trim(z) <> ''))"

    return (f"CASE WHEN {nxt} IN {empty} THEN false WHEN {cur} IN {empty} THEN true WHEN lower({cur}) = lower({nxt}) THEN false "
            f"WHEN {parts(nxt)} = 1 AND ({parts(cur)} > 1 OR regexp_matches({cur}, '{street}')) THEN false "
            f"WHEN regexp_matches({cur}, '{street}') AND NOT regexp_matches({nxt}, '{street}') THEN false "
            f"WHEN contains(lower({cur}), lower({nxt})) AND length({cur}) > length({nxt}) + 4 THEN false "
            f"WHEN {parts(cur)} > {parts(nxt)} AND length({cur}) > length({nxt}) + 8 THEN false ELSE true END")


@query("scl25_address_upgrades", f"""
WITH nb AS (SELECT e.id, e.address AS new_a, p.address AS old_a FROM entity e JOIN entity p ON p.k = e.k - 1)
SELECT id, {d_better('old_a', 'new_a')} AS better FROM nb""", uses=("entity",))
def address_upgrades(spark, sf):
    return with_previous(view(spark, sf, "entity"), "address").select("id", names.better_address("p_address", "address").alias("better"))


@query("scl28_text_lists", """
SELECT id, array_to_string(list_filter(list_transform(string_split(tags_text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS plain,
  CASE WHEN tags_text = '' THEN 'x|y z' ELSE 'x|' || tags_text END AS from_json FROM entity""", uses=("entity",))
def text_lists(spark, sf):
    tail = F.when(F.col("tags_text") == "", "y z").otherwise(F.col("tags_text"))
    doc = F.concat(F.lit('["x","'), tail, F.lit('"]'))
    return view(spark, sf, "entity").select(
        "id", F.array_join(sets.text_list("tags_text"), "|").alias("plain"), F.array_join(sets.text_list(doc), "|").alias("from_json"))


@query("scl29_date_lists", """
WITH t AS (SELECT id, d_examDate || CASE k % 3 WHEN 0 THEN ' ; ' || d_resultsDate WHEN 1 THEN chr(10) || d_offersAcceptance ELSE '' END AS v FROM entity)
SELECT id, CASE WHEN trim(v) IN ('', 'N/A', 'null') THEN NULL WHEN contains(trim(v), chr(10)) OR (contains(trim(v), ';') AND regexp_matches(trim(v), '[0-9]'))
  THEN coalesce(nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(trim(v), '[\\n;]+'), lambda x: trim(x)), lambda x: x <> ''), '|'), ''), trim(v))
  ELSE trim(v) END AS parts FROM (SELECT id, regexp_replace(v, '^\\s+|\\s+$', '', 'g') AS v FROM t)""", uses=("entity",))
def date_lists(spark, sf):
    k = F.col("k")
    v = F.concat("d_examDate", F.when(k % 3 == 0, F.concat(F.lit(" ; "), "d_resultsDate")).when(k % 3 == 1, F.concat(F.lit("\n"), "d_offersAcceptance")).otherwise(""))
    return view(spark, sf, "entity").select("id", F.array_join(dates.many_dates(v), "|").alias("parts"))


@query("scl30_repaired_json", """
SELECT event_id, cast(props ->> 'k' AS BIGINT) AS k, event_id % 6 <> 5 AS readable FROM (SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE props END AS props FROM events)""")
def repaired_json(spark, sf):
    p, i = F.col("props"), F.col("event_id") % 6
    body = F.regexp_extract(p, r"(\d+)", 1)
    messy = (
        F.when(i == 0, p).when(i == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```\ndone")))
        .when(i == 2, F.concat(F.lit("Sure! {\"k\": "), body, F.lit(", \"x\": None, /* note */ }")))
        .when(i == 3, F.concat(F.lit("{'k': "), body, F.lit(", \"ok\": True,} // end")))
        .when(i == 4, F.concat(F.lit("{\"k\": "), body, F.lit(", \"s\": \"a\tb\"}")))
        .otherwise(F.concat(F.lit("{\"k\": "), body, F.lit(", broken")))
    )
    fixed = table(spark, sf, "events").select("event_id", payloads.repaired_json(messy).alias("j"))
    return fixed.select("event_id", F.try_variant_get(F.try_parse_json("j"), "$.k", "bigint").alias("k"), F.col("j").isNotNull().alias("readable"))


@query("scl31_decoded_titles", """
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1),
  '&amp;', '&'), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) AS title FROM pages""")
def decoded_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.decode_entities(markup.page_title("html")).alias("title"))


@query("scl33_tag_edits", """
SELECT id, array_to_string(CASE WHEN list_contains(kept, 'web_verified') THEN kept ELSE list_append(kept, 'web_verified') END, '|') AS tags
FROM (SELECT id, list_filter(string_split(tags_text, ','), lambda t: t <> '' AND t NOT IN ('dead_website', 'missing_website')) AS kept FROM entity)""", uses=("entity",))
def tag_edits(spark, sf):
    t = sets.edit_tags("verification_tags", add=["web_verified"], remove=["dead_website", "missing_website"])
    return entities(spark, sf).select("id", F.array_join(t, "|").alias("tags"))


@query("scl35_text_hashes", "SELECT doc_id, sha256(text) AS template FROM documents")
def text_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", payloads.template_hash("text").alias("template"))


@query("scl36_lenient_numbers", """
SELECT id, try_cast(nullif(regexp_extract(pupilCount, '^\\s*([-+]?[0-9]+)', 1), '') AS BIGINT) AS pupils,
  CASE WHEN confidence_score IS NOT NULL THEN cast(floor(greatest(least(confidence_score, 98), 15) * 0.75 + 0.5) AS BIGINT) END AS rounded FROM entity""", uses=("entity",))
def lenient_numbers(spark, sf):
    c = F.col("confidence_score")
    return view(spark, sf, "entity").select(
        "id", values.lenient_int("pupilCount").alias("pupils"),
        values.round_half_up(values.clamp(c, 15, 98) * 0.75).alias("rounded"))
