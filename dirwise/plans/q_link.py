"""Places and distances, linkage of lists and registers, import triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirwise.operators import aggregates as agg
from dirwise.operators import link, nearby
from dirwise.plans.fixtures import CTES, table, view
from dirwise.plans.q_scalars import d_dice, d_name, d_unit
from dirwise.plans.registry import query

D_MILES = "round(sqrt(cast((e1 - e2) * (e1 - e2) + (n1 - n2) * (n1 - n2) AS DOUBLE)) / 1609.344, 2)"

CENTROIDS = """SELECT outcode, cast(floor(sum(easting) / cast(count(*) AS DOUBLE) + 0.5) AS BIGINT) AS easting, cast(floor(sum(northing) / cast(count(*) AS DOUBLE) + 0.5) AS BIGINT) AS northing,
  arg_min(admin_district, ord) AS district, count(*) AS "sampleSize" FROM coords GROUP BY 1"""


@query("agg09_district_centroids", CENTROIDS, uses=("coords",))
def district_centroids(spark, sf):
    return nearby.centroids(view(spark, sf, "coords")).select("outcode", "easting", "northing", "district", "sampleSize")


def located(spark, sf):
    c = view(spark, sf, "coords")
    districts = nearby.centroids(c.filter("ord % 5 <> 2")).filter("sampleSize > 1")
    return nearby.locate(view(spark, sf, "entity").select("id", "postcode", "la"), "postcode", c, districts)


CTES["located"] = f"""
SELECT e.id, coalesce(u.easting, d.easting, s.easting) AS easting, coalesce(u.northing, d.northing, s.northing) AS northing,
  CASE WHEN u.postcode IS NOT NULL THEN 'exact_unit' WHEN d.outcode IS NOT NULL OR s.outcode IS NOT NULL THEN 'district_centroid' END AS precision
FROM (SELECT id, {d_unit('postcode')} AS pc FROM entity) e LEFT JOIN coords u ON u.postcode = e.pc
LEFT JOIN (SELECT outcode, cast(floor(avg(easting) + 0.5) AS BIGINT) AS easting, cast(floor(avg(northing) + 0.5) AS BIGINT) AS northing FROM coords WHERE ord % 5 <> 2 GROUP BY 1 HAVING count(*) > 1) d ON d.outcode = split_part(e.pc, ' ', 1)
LEFT JOIN (SELECT outcode, arg_min(easting, postcode) AS easting, arg_min(northing, postcode) AS northing FROM coords GROUP BY 1) s ON s.outcode = split_part(e.pc, ' ', 1)
"""
LOC = ("entity", "coords", "located")


@query("jn09_located_entities", "SELECT id, easting, northing, precision FROM located", uses=LOC)
def located_entities(spark, sf):
    return located(spark, sf).select("id", "easting", "northing", "precision")


@query("top01_nearest", f"""WITH d AS (SELECT id, least({D_MILES.replace('e2', '520000').replace('n2', '170000').replace('e1', 'easting').replace('n1', 'northing')},
   {D_MILES.replace('e2', '541000').replace('n2', '181000').replace('e1', 'easting').replace('n1', 'northing')}) AS "distanceMiles" FROM located WHERE easting IS NOT NULL)
SELECT id, "distanceMiles" FROM d WHERE "distanceMiles" <= 10 ORDER BY 2, 1 LIMIT 50""", uses=LOC)
def nearest(spark, sf):
    return nearby.near_place(located(spark, sf), [(520000, 170000), (541000, 181000)], 10).select("id", "distanceMiles")


ANCHORS = "SELECT vec_id AS anchor_id, 500000 + (vec_id * 977) % 60000 AS easting, 150000 + (vec_id * 613) % 50000 AS northing FROM embeddings"


@query("jn10_nearest_anchor", f"""WITH a AS ({ANCHORS}), p AS (SELECT l.id, a.anchor_id, l.easting AS e1, l.northing AS n1, a.easting AS e2, a.northing AS n2 FROM located l, a WHERE l.easting IS NOT NULL)
SELECT id, arg_min(anchor_id, ({D_MILES}, anchor_id)) AS anchor_id, min({D_MILES}) AS "distanceMiles" FROM p GROUP BY 1""", uses=LOC)
def nearest_anchor_rows(spark, sf):
    table(spark, sf, "embeddings").createOrReplaceTempView("embeddings")
    return nearby.nearest_of(located(spark, sf), spark.sql(ANCHORS), 0.25)


@query("jn10_within_radius", f"""WITH a AS ({ANCHORS}), p AS (SELECT l.id, a.anchor_id, l.easting AS e1, l.northing AS n1, a.easting AS e2, a.northing AS n2 FROM located l JOIN a ON l.easting BETWEEN a.easting - 2000 AND a.easting + 2000)
SELECT id, anchor_id, {D_MILES} AS "distanceMiles" FROM p WHERE {D_MILES} <= 1""", uses=LOC)
def within_radius(spark, sf):
    table(spark, sf, "embeddings").createOrReplaceTempView("embeddings")
    return nearby.within(located(spark, sf).filter("easting is not null"), spark.sql(ANCHORS), 1)


@query("agg12_selection_centroids", """SELECT cast(floor(avg(easting) + 0.5) AS BIGINT) AS easting, cast(floor(avg(northing) + 0.5) AS BIGINT) AS northing, count(*) AS n FROM located WHERE easting IS NOT NULL""", uses=LOC)
def selection_centroid(spark, sf):
    return nearby.selection_centroid(located(spark, sf))


@query("jn18_text_locations", """SELECT id, CASE WHEN contains(lower(coalesce(la, '')), 'kent') OR contains(lower(coalesce(postcode, '')), 'kent') OR contains(lower(coalesce(address, '')), 'kent') THEN 'Kent'
 WHEN contains(lower(coalesce(la, '')), 'en1') OR contains(lower(coalesce(postcode, '')), 'en1') OR contains(lower(coalesce(address, '')), 'en1') THEN 'EN1' END AS token FROM entity""", uses=("entity",))
def text_locations(spark, sf):
    return view(spark, sf, "entity").select("id", nearby.text_location("la", "postcode", "address", ["Kent", "EN1"]).alias("token"))


# A ranked list: every third supplier-sized slice of parts under changed names.
RANKED = """
SELECT s_suppkey AS entry, CASE s_suppkey % 6 WHEN 0 THEN concat('The ', e.name) WHEN 1 THEN e.name WHEN 2 THEN concat(e.name, ' Foundation') WHEN 3 THEN concat('x', e.name)
   WHEN 4 THEN 'Nowhere Hall' ELSE concat(e.name, ' Trust ', cast(s_suppkey AS STRING)) END AS name,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN coalesce(e.postcode, '') WHEN 2 THEN 'ZZ9 9ZZ' WHEN 3 THEN coalesce(e.postcode, '') ELSE concat('EN', cast(1 + s_suppkey % 97 AS STRING), ' 1AA') END AS postcode,
  CASE WHEN s_suppkey % 4 = 0 THEN coalesce(e.urn, '') WHEN s_suppkey % 4 = 1 THEN cast(800000 + s_suppkey AS STRING) ELSE '' END AS urn, CASE WHEN s_suppkey % 7 = 0 THEN e.name ELSE '' END AS alias,
  cast(1 + s_suppkey AS INT) AS gcseRank, cast(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 2 + s_suppkey END AS INT) AS aLevelRank, cast(CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 3 + s_suppkey END AS INT) AS nationalRank
FROM supplier JOIN entity e ON e.k = s_suppkey * 11
"""
CTES["ranked"] = RANKED


def ranked_list(spark, sf):
    view(spark, sf, "entity").createOrReplaceTempView("entity")
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    r = spark.sql(RANKED)
    none = F.lit("")
    return r.withColumns({"aliases": F.when(F.col("alias") == "", F.array().cast("array<string>")).otherwise(F.array("alias")),
                          "region": none, "town": none, "schoolType": none})


def _area(c):
    return f"CASE WHEN regexp_matches(upper(trim(coalesce({c}, ''))), '^[A-Z][A-Z]?[0-9][A-Z0-9]?') THEN regexp_extract(upper(trim({c})), '^([A-Z][A-Z]?[0-9][A-Z0-9]?)', 1) ELSE split_part(upper(trim(coalesce({c}, ''))), ' ', 1) END"


def _code(c):
    return f"upper(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g'))"


CTES["links"] = f"""
WITH r AS (SELECT entry, {d_name('name', 'ranking')} AS key, lower(trim(name)) AS raw, {_code('postcode')} AS code, {_area('postcode')} AS area, trim(coalesce(urn, '')) AS urn,
   {d_name('alias', 'ranking')} AS al FROM ranked),
e AS (SELECT id, {d_name('name', 'ranking')} AS key, lower(trim(name)) AS raw, {_code('postcode')} AS code, {_area('postcode')} AS area, trim(coalesce(urn, '')) AS urn FROM entity),
p AS (SELECT r.entry, e.id, r.raw = e.raw AS sraw, e.key <> '' AND e.key = r.key AS skey, r.code <> '' AND r.code = e.code AS scode, r.area <> '' AND r.area = e.area AS sarea,
   r.urn <> '' AND r.urn = e.urn AS surn, {d_dice('e.key', 'r.key')} AS sim, {d_dice('e.key', 'r.al')} AS asim FROM r CROSS JOIN e),
n AS (SELECT entry, count(*) FILTER (scode) AS ncode, count(*) FILTER (sraw) AS nraw, min(id) FILTER (surn) AS first_urn FROM p GROUP BY 1),
c AS (SELECT p.*, n.ncode, n.nraw, greatest(sim, asim) AS best, id = first_urn AS isfirst FROM p JOIN n USING (entry)),
t AS (
  SELECT entry, 1 AS tier, -best AS sub, id, CASE WHEN ncode = 1 THEN 'POSTCODE_EXACT_NAME_CONFIRMED' ELSE 'POSTCODE_BEST_NAME' END AS m, CASE WHEN ncode = 1 THEN 0.99 ELSE 0.95 END AS conf FROM c WHERE scode AND best >= 0.35
  UNION ALL SELECT entry, 2, 0, id, CASE WHEN nraw = 1 THEN 'NAME_EXACT_UNIQUE' ELSE 'NAME_EXACT_OUTCODE' END, CASE WHEN nraw = 1 THEN 0.95 ELSE 0.98 END FROM c WHERE sraw AND (nraw = 1 OR sarea)
  UNION ALL SELECT entry, 3, 0, id, 'URN_EXACT_CONFIRMED', 0.95 FROM c WHERE isfirst AND sim >= 0.40
  UNION ALL SELECT entry, 4, 0, id, CASE WHEN sim >= 0.65 THEN 'OUTCODE_NAME_MATCH' ELSE 'OUTCODE_ALIAS_MATCH' END, 0.85 FROM c WHERE sarea AND best >= 0.65
  UNION ALL SELECT entry, 5, 0, id, CASE WHEN sraw THEN 'NAME_EXACT' ELSE 'NORM_NAME_EXACT' END, CASE WHEN sraw THEN 0.95 ELSE 0.90 END FROM c WHERE sraw OR skey
  UNION ALL SELECT entry, 6, -best, id, 'FUZZY_NAME', best FROM c WHERE best >= 0.78),
o AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY tier, sub, id) AS rn FROM t)
SELECT entry, id, m AS matchType, round(cast(conf AS DOUBLE), 6) AS confidence FROM o WHERE rn = 1
"""


@query("jn11_linked_list", 'SELECT entry, id, matchType AS "matchType", confidence FROM links', uses=("entity", "ranked", "links"))
def linked_list(spark, sf):
    out = link.link_list(ranked_list(spark, sf), view(spark, sf, "entity"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("er10_list_ranks", """
WITH w AS (SELECT l.id, arg_max(r.gcseRank, r.entry) AS g, max(r.entry) AS last FROM ranked r JOIN links l USING (entry) GROUP BY 1),
h AS (SELECT w.id, r.gcseRank AS g, r.aLevelRank AS a, coalesce(r.nationalRank, r.gcseRank, r.aLevelRank) AS n FROM w JOIN ranked r ON r.entry = w.last)
SELECT e.id, h.g AS gcse_rank_england, h.a AS a_level_rank_england, h.n AS national_rank_england FROM entity e LEFT JOIN h USING (id)
UNION ALL SELECT 'sch-gov-' || urn, gcseRank, aLevelRank, coalesce(nationalRank, gcseRank, aLevelRank) FROM ranked WHERE urn <> '' AND entry NOT IN (SELECT entry FROM links)""", uses=("entity", "ranked", "links"))
def list_ranks(spark, sf):
    r, e = ranked_list(spark, sf), view(spark, sf, "entity")
    out = link.apply_list_ranks(e, r, link.link_list(r, e))
    return out.select("id", "gcse_rank_england", "a_level_rank_england", "national_rank_england")


@query("jn01_register_columns", """SELECT e.id, r.SCHNAME AS register_name, r.ADMPOL AS admissions FROM entity e LEFT JOIN register r ON r.URN = e.urn""", uses=("entity", "register"))
def register_columns(spark, sf):
    out = link.with_register(view(spark, sf, "entity"), view(spark, sf, "register"))
    return out.select("id", F.col("SCHNAME").alias("register_name"), F.col("ADMPOL").alias("admissions"))


_GAP = f"""
g AS (SELECT *, {_code('POSTCODE')} AS code, {d_name('SCHNAME', 'alphanumeric')} AS key FROM register WHERE ISSECONDARY = '1' AND SCHSTATUS = 'Open'),
e AS (SELECT *, {_code('postcode')} AS code, {d_name('name', 'alphanumeric')} AS key FROM entity),
nm AS (SELECT e.id, g.URN AS gurn FROM e JOIN g ON e.code <> '' AND e.code = g.code AND (contains(e.key, g.key) OR contains(g.key, e.key)))"""


@query("er11_reconciled_keys", f"""WITH {_GAP}, f AS (SELECT id, min(gurn) AS u FROM nm GROUP BY 1)
SELECT e.id, coalesce(f.u, e.urn) AS urn, f.u IS NOT NULL AND f.u IS DISTINCT FROM e.urn AS key_changed FROM e LEFT JOIN f USING (id)""", uses=("entity", "register"))
def reconciled_keys(spark, sf):
    return link.reconcile_keys(view(spark, sf, "entity"), view(spark, sf, "register")).select("id", "urn", "key_changed")


@query("er12_register_gap", f"""WITH {_GAP}
SELECT 'sch-gov-' || URN AS id, SCHNAME AS name, array_to_string(list_filter([STREET, LOCALITY, ADDRESS3, TOWN], lambda x: x IS NOT NULL AND trim(x) <> ''), ', ') AS address,
  CASE WHEN lower(SCHOOLTYPE) LIKE '%independent%' THEN 'Independent' WHEN lower(SCHNAME) LIKE '%grammar%' THEN 'Grammar' ELSE 'Comprehensive' END AS "schoolType",
  CASE WHEN AGELOW <> '' THEN AGELOW || '-' || AGEHIGH ELSE '' END AS "ageRange", CASE WHEN ADMPOL = 'Selective' OR lower(SCHNAME) LIKE '%grammar%' THEN '11+ / Entrance Exam' ELSE '' END AS "entranceExamType"
FROM g WHERE URN NOT IN (SELECT trim(urn) FROM entity WHERE urn IS NOT NULL) AND URN NOT IN (SELECT gurn FROM nm)""", uses=("entity", "register"))
def register_gap(spark, sf):
    return link.ingest_gap(view(spark, sf, "entity"), view(spark, sf, "register")).select("id", "name", "address", "schoolType", "ageRange", "entranceExamType")


# A curated source cut from the register.
CURATED = """SELECT URN AS urn, SCHNAME AS name, POSTCODE AS postcode, CASE WHEN AGELOW = '' THEN '' ELSE 'Outstanding' END AS ofsted, concat('https://c', URN, '.org') AS website,
  CASE WHEN TOWN IS NULL THEN '' ELSE '020 7946 0000' END AS phone, cast(URN AS BIGINT) AS ord FROM register"""


def curated(spark, sf):
    view(spark, sf, "register").createOrReplaceTempView("register")
    return spark.sql(CURATED)


@query("jn14_backfilled", f"""
WITH s AS (SELECT *, {d_name('name', 'register')} AS key, {_code('postcode')} AS code FROM ({CURATED})), e AS (SELECT *, {d_name('name', 'register')} AS key, {_code('postcode')} AS code FROM entity),
m AS (SELECT e.id, s.ord, s.urn, s.ofsted, s.website, s.phone FROM e JOIN s ON trim(coalesce(e.urn, '')) = s.urn OR (e.code <> '' AND e.code = s.code AND (contains(e.key, s.key) OR contains(s.key, e.key)))),
f AS (SELECT id, arg_min(urn, ord) AS u, arg_min(ofsted, ord) FILTER (ofsted <> '') AS o, arg_min(website, ord) AS w, arg_min(phone, ord) FILTER (phone <> '') AS p FROM m GROUP BY 1)
SELECT e.id, CASE WHEN coalesce(trim(e.urn), '') = '' THEN coalesce(f.u, e.urn) ELSE e.urn END AS urn, CASE WHEN coalesce(trim(e.ofstedRating), '') = '' THEN coalesce(f.o, e.ofstedRating) ELSE e.ofstedRating END AS "ofstedRating",
  CASE WHEN coalesce(trim(e.website), '') = '' THEN coalesce(f.w, e.website) ELSE e.website END AS website, CASE WHEN coalesce(trim(e.phone), '') = '' THEN coalesce(f.p, e.phone) ELSE e.phone END AS phone
FROM e LEFT JOIN f USING (id)""", uses=("entity", "register"))
def backfilled(spark, sf):
    return link.backfill(view(spark, sf, "entity"), curated(spark, sf)).select("id", "urn", "ofstedRating", "website", "phone")


@query("dq27_assembled_records", f"""
WITH s AS (SELECT urn, name, address, la, gender, ofstedRating, website, phone FROM entity WHERE coalesce(urn, '') <> ''),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY name, address) AS rn FROM s) WHERE rn = 1), c AS (SELECT * FROM ({CURATED}))
SELECT coalesce(s1.urn, r.URN, c.urn) AS urn, coalesce(nullif(s1.name, ''), c.name, r.SCHNAME) AS name, coalesce(nullif(s1.la, ''), r.LANAME, '') AS la,
 coalesce(nullif(s1.gender, ''), r.GENDER, 'Mixed') AS gender, coalesce(nullif(s1.ofstedRating, ''), nullif(c.ofsted, ''), '') AS "ofstedRating", coalesce(nullif(s1.website, ''), c.website, '') AS website, coalesce(r.SCHSTATUS, '') <> 'Closed' AS active
FROM s1 FULL JOIN register r ON r.URN = s1.urn FULL JOIN c ON c.urn = coalesce(s1.urn, r.URN)""", uses=("entity", "register"))
def assembled_records(spark, sf):
    s = view(spark, sf, "entity").filter("coalesce(urn, '') <> ''")
    s = s.groupBy("urn").agg(F.min(F.struct("name", "address", "la", "gender", "ofstedRating", "website", "phone")).alias("m")).select("urn", "m.*", F.lit("").alias("status"))
    out = link.assemble(s, view(spark, sf, "register"), curated(spark, sf))
    return out.select("urn", "name", "la", "gender", "ofstedRating", "website", "active")


# An import batch: events as rows, names and keys that repeat inside the batch and against the directory.
BATCH = """
SELECT cast(event_id AS BIGINT) AS rowNum, CASE WHEN event_id % 50 = 7 THEN '' WHEN event_id % 9 = 2 THEN concat(' ', coalesce(e.name, 'Nobody'), ' ') ELSE concat('Fresh ', cast(event_id % 4000 AS STRING)) END AS name,
  CASE WHEN event_id % 41 = 3 THEN '' ELSE 'Kent' END AS la, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN cast(700000 + event_id % 3100 AS STRING) ELSE cast(100000 + event_id % 6000 AS STRING) END AS urn,
  CASE WHEN event_id % 2 = 0 THEN ' Boys ' ELSE '' END AS gender
FROM events LEFT JOIN entity e ON e.k = event_id % 3000
"""


# The batch read row by row, as it is stated: every step carries the names and keys accepted so far.
TRIAGE = f"""RECURSIVE b AS (SELECT *, lower(trim(name)) AS nm, CASE WHEN trim(urn) NOT IN ('', 'N/A') THEN trim(urn) END AS ur, trim(name) <> '' AND trim(la) <> '' AS ok FROM ({BATCH})),
kn AS (SELECT lower(trim(name)) AS nm, max(id) AS by_name FROM entity WHERE trim(name) <> '' GROUP BY 1), ku AS (SELECT trim(urn) AS ur, max(id) AS by_urn FROM entity WHERE trim(coalesce(urn, '')) NOT IN ('', 'N/A') GROUP BY 1),
k AS (SELECT b.*, coalesce(by_name, by_urn) AS known FROM b LEFT JOIN kn USING (nm) LEFT JOIN ku USING (ur)),
o AS (SELECT row_number() OVER (ORDER BY rowNum) AS n, rowNum, dense_rank() OVER (ORDER BY nm) AS nm, CASE WHEN ur IS NOT NULL THEN dense_rank() OVER (ORDER BY ur) END AS ur FROM k WHERE ok AND known IS NULL),
step(n, rowNum, taken, names, urns) AS (
  SELECT cast(0 AS BIGINT), cast(NULL AS BIGINT), false, cast([] AS BIGINT[]), cast([] AS BIGINT[])
  UNION ALL SELECT n, rowNum, free, CASE WHEN free THEN list_append(names, nm) ELSE names END, CASE WHEN free AND ur IS NOT NULL THEN list_append(urns, ur) ELSE urns END
  FROM (SELECT o.n, o.rowNum, o.nm, o.ur, step.names, step.urns, NOT (list_contains(step.names, o.nm) OR (o.ur IS NOT NULL AND list_contains(step.urns, o.ur))) AS free FROM step JOIN o ON o.n = step.n + 1)),
a AS (SELECT rowNum FROM step WHERE taken),
an AS (SELECT nm, min(rowNum) AS first_name FROM k JOIN a USING (rowNum) GROUP BY 1), au AS (SELECT ur, min(rowNum) AS first_urn FROM k JOIN a USING (rowNum) WHERE ur IS NOT NULL GROUP BY 1),
t AS (SELECT k.rowNum, ok, known, a.rowNum IS NOT NULL AS acc, coalesce(first_name < k.rowNum, false) OR coalesce(first_urn < k.rowNum, false) AS again FROM k LEFT JOIN a USING (rowNum) LEFT JOIN an USING (nm) LEFT JOIN au USING (ur))
"""


@query("er13_import_triage", f"""WITH {TRIAGE} SELECT rowNum AS "rowNum", CASE WHEN NOT ok THEN 'invalid' WHEN acc THEN 'verified' ELSE 'duplicate' END AS state,
 CASE WHEN NOT ok THEN 'Missing school name or local authority' WHEN acc THEN NULL WHEN again THEN 'Duplicate entry within bulk batch' ELSE 'Matches existing record in database (' || known || ')' END AS reason, CASE WHEN ok THEN known END AS "existingId" FROM t""", uses=("entity",))
def import_triage(spark, sf):
    view(spark, sf, "entity").createOrReplaceTempView("entity")
    table(spark, sf, "events").createOrReplaceTempView("events")
    return link.triage(spark.sql(BATCH), view(spark, sf, "entity")).select("rowNum", "state", "reason", "existingId")


@query("set04_imported_directory", f"""WITH {TRIAGE} SELECT id, trim(name) AS name, la, gender FROM entity
 UNION ALL SELECT 'imp-' || k.rowNum, trim(name), trim(la), CASE WHEN trim(gender) = '' THEN 'Mixed' ELSE trim(gender) END FROM k JOIN a USING (rowNum)""", uses=("entity",))
def imported_directory(spark, sf):
    """Triage, cleaning and insertion as one path."""
    e = view(spark, sf, "entity")
    e.createOrReplaceTempView("entity")
    table(spark, sf, "events").createOrReplaceTempView("events")
    verified = link.triage(spark.sql(BATCH), e).filter("state = 'verified'")
    fresh = link.cleaned_import(verified).withColumn("id", F.concat(F.lit("imp-"), "rowNum"))
    from dirwise.operators import changes

    return changes.insert_new(e.select("id", F.trim("name").alias("name"), "la", "gender"), fresh.select("id", "name", "la", "gender"))


@query("agg18_copied_tables", """SELECT 'customer' AS "table", count(*) AS before, count(*) AS after, true AS same FROM customer
 UNION ALL SELECT 'events', count(*), count(*) FILTER (event_id % 5 <> 0), count(*) = count(*) FILTER (event_id % 5 <> 0) FROM events
 UNION ALL SELECT 'orders', count(*), 2 * count(*), false FROM orders""")
def copied_tables(spark, sf):
    from dirwise.session import saved

    t = {n: table(spark, sf, n) for n in ("customer", "events", "orders")}
    # a whole copy, one that lost rows, and one that was taken twice
    copies = {"customer": t["customer"], "events": t["events"].filter("event_id % 5 <> 0"), "orders": t["orders"].unionAll(t["orders"])}
    return agg.same_row_counts(t, {n: saved(df) for n, df in copies.items()})
