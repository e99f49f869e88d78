"""Linking external lists and registers to the directory, and import triage.

Every lookup runs against entities grouped by the looked-up key first, so a
key held by a third of all rows is one row of the lookup.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.names import in_london, join_address, name_key, org_type, postcode
from dirwise.functions.values import filled, first_filled, or_null, spread_blank, text, trim_all
from dirwise.operators.merge import survivors
from dirwise.operators.similarity import contained_names, similar_across
from dirwise.session import saved

# Name similarity asked for in each tier.
CODE_TIER, KEY_TIER, AREA_TIER, FUZZY_TIER = 0.35, 0.40, 0.65, 0.78


def area_code(c: Column | str) -> Column:
    s = F.upper(trim_all(text(c)))
    found = F.regexp_extract(s, r"^([A-Z]{1,2}\d[A-Z\d]?)", 1)
    return F.when(found != "", found).otherwise(F.split_part(s, F.lit(" "), F.lit(1)))


def link_list(ranked: DataFrame, entities: DataFrame) -> DataFrame:
    """(entry, id, matchType, confidence) for each list entry that finds its entity.

    ranked: entry (unique), name, postcode, urn, aliases array. Tiers, first
    one that answers: postcode and name, exact name, register key and name,
    district and name, same reduced name, fuzzy name. Ties go to the smallest id.
    """
    r = saved(ranked.select(
        "entry", "name", name_key("name", "ranking").alias("key"), F.lower(F.trim("name")).alias("raw"), postcode("postcode", "compact").alias("code"),
        area_code("postcode").alias("area"), trim_all(text("urn")).alias("urn"),
        F.coalesce(F.transform("aliases", lambda a: name_key(a, "ranking")), F.array().cast("array<string>")).alias("also")))
    e = saved(entities.select(
        "id", name_key("name", "ranking").alias("key"), F.lower(F.trim("name")).alias("raw"), postcode("postcode", "compact").alias("code"),
        area_code("postcode").alias("area"), trim_all(text("urn")).alias("urn")))
    forms = r.select("entry", "code", "area", F.col("key").alias("form"), F.lit(False).alias("alias")).unionByName(
        r.select("entry", "code", "area", F.explode("also").alias("form"), F.lit(True).alias("alias")))
    forms = saved(forms.withColumn("name", F.col("form")).filter("form <> ''"))

    def hit(rows: DataFrame, tier: int, sub: Column, match: Column, confidence: Column) -> DataFrame:
        best = F.struct(F.lit(tier).alias("tier"), sub.alias("sub"), "id", match.alias("matchType"), confidence.cast("double").alias("confidence"))
        return rows.groupBy("entry").agg(F.min(best).alias("best"))

    # 1: postcode; how many entities share it decides the match type
    by_code = e.filter("code <> ''").groupBy("code", "key").agg(F.min("id").alias("id"), F.count("*").alias("k"))
    totals = by_code.groupBy("code").agg(F.sum("k").alias("in_code"))
    s1 = _alike(forms.filter("code <> ''"), by_code, CODE_TIER, ["code"]).join(totals, "code")
    one = F.col("in_code") == 1
    t1 = hit(s1, 1, -F.col("dice"), F.when(one, "POSTCODE_EXACT_NAME_CONFIRMED").otherwise("POSTCODE_BEST_NAME"), F.when(one, 0.99).otherwise(0.95))

    # 2: the very same name, alone or in the same district
    by_raw = e.groupBy("raw").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    alone = r.join(by_raw.filter("k = 1"), "raw")
    t2 = hit(alone, 2, F.lit(0.0), F.lit("NAME_EXACT_UNIQUE"), F.lit(0.95))
    in_area = e.groupBy("raw", "area").agg(F.min("id").alias("id"))
    many = r.filter("area <> ''").join(by_raw.filter("k > 1").select("raw"), "raw").join(in_area, ["raw", "area"])
    t2b = hit(many, 2, F.lit(0.0), F.lit("NAME_EXACT_OUTCODE"), F.lit(0.98))

    # 3: the register key, if the names agree somewhat
    by_urn = e.filter("urn <> ''").groupBy("urn").agg(F.min(F.struct("id", F.col("key").alias("found"))).alias("f"))
    from dirwise.functions.sets import dice

    keyed = r.filter("urn <> ''").join(by_urn, "urn").select("entry", "key", F.col("f.id").alias("id"), F.col("f.found").alias("found"))
    t3 = hit(keyed.filter(dice("key", "found") >= KEY_TIER), 3, F.lit(0.0), F.lit("URN_EXACT_CONFIRMED"), F.lit(0.95))

    def first_tier(*tiers: DataFrame) -> DataFrame:
        every = tiers[0]
        for t in tiers[1:]:
            every = every.unionByName(t)
        return saved(every.groupBy("entry").agg(F.min("best").alias("best")))

    # the costly tiers only see entries that no earlier one has answered
    settled = first_tier(t1, t2, t2b, t3)

    # 4: the district; the first entity that is close enough
    by_area = e.filter("area <> ''").groupBy("area", "key").agg(F.min("id").alias("id"))
    s4 = _alike(forms.filter("area <> ''").join(settled, "entry", "left_anti"), by_area, AREA_TIER, ["area"])
    own = s4.groupBy("entry", "id").agg(F.min("alias").alias("alias"))
    t4 = hit(own, 4, F.lit(0.0), F.when(F.col("alias"), "OUTCODE_ALIAS_MATCH").otherwise("OUTCODE_NAME_MATCH"), F.lit(0.85))

    # 5: same raw or reduced name anywhere, first entity; then the most similar one
    by_key = e.filter("key <> ''").groupBy("key").agg(F.min(F.struct("id", "raw")).alias("f"))
    same = r.join(by_key, "key").select("entry", F.col("f.id").alias("id"), (F.col("f.raw") == F.col("raw")).alias("exact"))
    raw_any = r.join(by_raw, "raw").select("entry", "id", F.lit(True).alias("exact"))
    first = same.unionByName(raw_any)
    t5 = hit(first.withColumn("_x", ~F.col("exact")), 5, F.lit(0.0),
             F.when(F.col("exact"), "NAME_EXACT").otherwise("NORM_NAME_EXACT"), F.when(F.col("exact"), 0.95).otherwise(0.90))
    settled = first_tier(settled, t4, t5)
    any_name = e.filter("key <> ''").groupBy("key").agg(F.min("id").alias("id"))
    s6 = _alike(forms.join(settled, "entry", "left_anti"), any_name, FUZZY_TIER, [])
    t6 = hit(s6, 6, -F.col("dice"), F.lit("FUZZY_NAME"), F.col("dice"))

    best = first_tier(settled, t6)
    return best.select("entry", "best.id", "best.matchType", "best.confidence")


def _alike(forms: DataFrame, lookup: DataFrame, d: float, block: list[str]) -> DataFrame:
    """List entries with entities whose name reaches Dice ``d`` (within a block)."""
    right = lookup.filter("key <> ''")
    pairs = similar_across(forms, right.withColumn("name", F.col("key")), "name", d, block)
    # one-letter names have no pairs of letters; they match only themselves
    short = forms.filter(F.length("form") == 1).select(*block, F.col("form").alias("name_a"), F.col("form").alias("name_b"), F.lit(1.0).alias("dice")).distinct()
    pairs = pairs.select(*block, "name_a", "name_b", "dice").unionByName(short)
    out = forms.select("entry", "alias", *block, F.col("form").alias("name_a")).join(pairs, [*block, "name_a"])
    return out.join(right.select(*block, F.col("key").alias("name_b"), "id"), [*block, "name_b"])


def apply_list_ranks(entities: DataFrame, ranked: DataFrame, links: DataFrame) -> DataFrame:
    """Entities with the list's ranks, all other ranks cleared, and keyed newcomers added.

    ranked also holds gcseRank, aLevelRank, nationalRank, town, region, schoolType.
    Where several entries found one entity, the last entry counts; of several
    newcomers with one key the first. A newcomer whose id is there already is
    no newcomer.
    """
    national = F.coalesce("nationalRank", F.when(F.col("gcseRank") != 0, F.col("gcseRank")), F.when(F.col("aLevelRank") != 0, F.col("aLevelRank")))
    rows = ranked.withColumn("_nat", national).join(links, "entry", "left")
    held = rows.filter("id is not null").groupBy("id").agg(F.max_by(F.struct("gcseRank", "aLevelRank", "_nat"), "entry").alias("n"))
    cols = [c for c in entities.columns if c not in ("gcse_rank_england", "a_level_rank_england", "national_rank_england")]
    out = entities.select(*cols).join(held, "id", "left").select(
        *cols, F.col("n.gcseRank").cast("int").alias("gcse_rank_england"), F.col("n.aLevelRank").cast("int").alias("a_level_rank_england"),
        F.col("n._nat").cast("int").alias("national_rank_england"))
    new = rows.filter(F.col("id").isNull() & filled("urn")).drop("id").withColumn("id", F.concat(F.lit("sch-gov-"), "urn"))
    firsts = new.groupBy("id").agg(F.min("entry").alias("entry"))
    new = new.join(firsts, ["id", "entry"]).join(entities.select("id"), "id", "left_anti")
    fresh = new.select(
        "id", "name", "urn", "postcode", F.coalesce(or_null("region"), F.lit("Greater London / UK")).alias("region"),
        F.coalesce(or_null("town"), F.lit("London")).alias("la"), F.coalesce(or_null("schoolType"), F.lit("Grammar")).alias("schoolType"),
        F.col("gcseRank").cast("int").alias("gcse_rank_england"), F.col("aLevelRank").cast("int").alias("a_level_rank_england"),
        F.col("_nat").cast("int").alias("national_rank_england"), F.lit("official").alias("verification_status"))
    return out.unionByName(fresh.select(*[c for c in fresh.columns if c in out.columns]), allowMissingColumns=True)


# ---- register ----------------------------------------------------------------------------------


def open_secondary(register: DataFrame) -> DataFrame:
    return register.filter((F.col("ISSECONDARY").cast("string") == "1") & (F.col("SCHSTATUS") == "Open"))


def with_register(entities: DataFrame, register: DataFrame) -> DataFrame:
    """Entities with the columns of their register row, if the key finds one."""
    rows = entities.withColumn("_k", spread_blank(F.col("urn"), F.col("id")))
    return rows.join(register.withColumnRenamed("URN", "_k"), "_k", "left").drop("_k")


def _name_matches(entities: DataFrame, register: DataFrame) -> DataFrame:
    """(code, entity_name, register_name): equal or contained reduced names at one postcode."""
    e = entities.select("code", F.col("key").alias("name")).filter("code <> ''").distinct()
    g = register.select("code", F.col("key").alias("name")).filter("code <> ''").distinct()
    ins = contained_names(e, g, "name", ["code"]).select("code", F.col("inner_name").alias("e_name"), F.col("outer_name").alias("g_name"))
    outs = contained_names(g, e, "name", ["code"]).select("code", F.col("outer_name").alias("e_name"), F.col("inner_name").alias("g_name"))
    # an empty name is part of every name
    empty = e.join(g.select("code", F.col("name").alias("g_name")), "code").filter("name = ''").select("code", F.col("name").alias("e_name"), "g_name")
    empty_g = g.filter("name = ''").select("code", F.col("name").alias("g_name")).join(e, "code").select("code", F.col("name").alias("e_name"), "g_name")
    return ins.unionByName(outs).unionByName(empty).unionByName(empty_g).distinct()


def _keyed(df: DataFrame, name: str, code: str) -> DataFrame:
    return df.withColumns({"key": name_key(name, "alphanumeric"), "code": postcode(code, "compact")})


def reconcile_keys(entities: DataFrame, register: DataFrame) -> DataFrame:
    """Entities with the register key of the row at their postcode whose name fits; the smallest such key."""
    e, g = _keyed(entities, "name", "postcode"), _keyed(open_secondary(register), "SCHNAME", "POSTCODE")
    keys = g.groupBy("code", F.col("key").alias("g_name")).agg(F.min("URN").alias("_urn"))
    found = _name_matches(e, g).join(keys, ["code", "g_name"]).groupBy("code", F.col("e_name").alias("key")).agg(F.min("_urn").alias("_urn"))
    out = e.join(found, ["code", "key"], "left")
    changed = F.col("_urn").isNotNull() & ~F.col("urn").eqNullSafe(F.col("_urn"))
    return out.withColumns({"key_changed": changed, "urn": F.coalesce("_urn", "urn")}).select(*entities.columns, "key_changed")


def missing_rows(entities: DataFrame, register: DataFrame) -> DataFrame:
    """Open register rows no entity stands for, by key or by postcode and name."""
    g = _keyed(open_secondary(register), "SCHNAME", "POSTCODE")
    e = _keyed(entities, "name", "postcode")
    keys = e.select(trim_all(text("urn")).alias("_u")).filter("_u <> ''").distinct()
    left = g.withColumn("_u", trim_all(text("URN"))).join(keys, "_u", "left_anti")
    known = _name_matches(e, g).select("code", F.col("g_name").alias("key")).distinct()
    return left.join(known, ["code", "key"], "left_anti").select(*register.columns)


def as_entities(register: DataFrame) -> DataFrame:
    """Register rows in the entity schema."""
    kind = org_type("SCHOOLTYPE", "SCHNAME", F.lit(""))
    ages = F.when(filled("AGELOW") & filled("AGEHIGH"), F.concat_ws("-", "AGELOW", "AGEHIGH")).otherwise("")
    selective = (F.col("ADMPOL") == "Selective") | (kind == "Grammar")
    return register.select(
        F.concat(F.lit("sch-gov-"), "URN").alias("id"), text("SCHNAME").alias("name"), text("URN").alias("urn"), text("LANAME").alias("la"),
        in_london("LANAME").alias("region"), text("POSTCODE").alias("postcode"), join_address("STREET", "LOCALITY", "ADDRESS3", "TOWN").alias("address"),
        kind.alias("schoolType"), text("SCHOOLTYPE").alias("rawSchoolType"), F.coalesce(or_null("GENDER"), F.lit("Mixed")).alias("gender"),
        ages.alias("ageRange"), F.when(F.coalesce(selective, F.lit(False)), "11+ / Entrance Exam").otherwise("").alias("entranceExamType"),
        F.coalesce(or_null("ADMPOL"), F.lit("Non-selective")).alias("admissionsPolicy"))


def ingest_gap(entities: DataFrame, register: DataFrame) -> DataFrame:
    """New entities for the register rows that are missing; existing ids are left alone."""
    new = as_entities(missing_rows(entities, register))
    rest = [c for c in new.columns if c != "id"]
    fresh = new.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(c) if c == "id" else F.col(f"_r.{c}").alias(c) for c in new.columns])  # of equal keys the first by its values
    return fresh.join(entities.select("id"), "id", "left_anti")


BACKFILL = (("urn", "URN"), ("ofstedRating", "rating"), ("website", "web"), ("phone", "tel"))


def backfill(entities: DataFrame, source: DataFrame) -> DataFrame:
    """Blank register keys, ratings, links and phones filled from a curated source.

    source: urn, name, postcode, ofsted, website, phone, and ``ord``, its reading
    order. A source row serves every entity with its key, else those at its
    postcode whose reduced name contains or is contained in its own; the
    earliest source row that holds a value fills it. Adds ``filled_fields``.
    """
    e = entities.withColumns({"key": name_key("name", "register"), "code": postcode("postcode", "compact"), "_u": spread_blank(trim_all(text("urn")), F.col("id"))})
    e = e.withColumn("code", spread_blank(F.col("code"), F.col("id")))
    s = source.withColumns({"key": name_key("name", "register"), "code": postcode("postcode", "compact")})
    fields = {"urn": "urn", "ofstedRating": "ofsted", "website": "website", "phone": "phone"}
    first = [F.min_by(or_null(c), F.when(filled(c), F.col("ord"))).alias(f"_{f}") for f, c in fields.items()]
    first += [F.min(F.when(filled(c), F.col("ord"))).alias(f"_o_{f}") for f, c in fields.items()]
    by_key = s.filter(filled("urn")).groupBy(F.trim("urn").alias("_u")).agg(*first)
    names_at = _name_matches(e, s)
    by_name = names_at.join(s.withColumnRenamed("key", "g_name").select("code", "g_name", "ord", *set(fields.values())), ["code", "g_name"])
    by_name = by_name.groupBy("code", F.col("e_name").alias("key")).agg(*first)
    rename = {f"_{p}{f}": f"_n{p}{f}" for f in fields for p in ("", "o_")}
    out = e.join(by_key, "_u", "left").join(by_name.withColumnsRenamed(rename), ["code", "key"], "left")
    changes, done = {}, []
    for f in fields:
        a, b = F.struct(F.col(f"_o_{f}").alias("o"), F.col(f"_{f}").alias("v")), F.struct(F.col(f"_no_{f}").alias("o"), F.col(f"_n{f}").alias("v"))
        value = F.least(F.when(F.col(f"_{f}").isNotNull(), a), F.when(F.col(f"_n{f}").isNotNull(), b))["v"]
        blank = trim_all(text(f)) == ""
        changes[f] = F.when(blank, F.coalesce(value, F.col(f))).otherwise(F.col(f))
        done.append(F.when(blank & value.isNotNull(), F.lit(f)))
    marked = out.withColumn("filled_fields", F.array_compact(F.array(*done)))
    return marked.withColumns(changes).select(*entities.columns, "filled_fields")


def assemble(scraped: DataFrame, register: DataFrame, curated: DataFrame) -> DataFrame:
    """One record per key from three sources, best first: page, register, curated list.

    scraped: urn, name, address, la, gender, ofstedRating, website, phone,
    status. register: as read. curated: urn, name, postcode, ofsted, website, phone.
    """
    r = register.select(
        F.col("URN").alias("urn"), F.col("SCHNAME").alias("r_name"), F.col("LANAME").alias("r_la"), F.col("POSTCODE").alias("r_code"),
        F.col("GENDER").alias("r_gender"), F.col("SCHSTATUS").alias("r_status"))
    c = curated.select("urn", *[F.col(x).alias(f"c_{x}") for x in ("name", "postcode", "ofsted", "website", "phone")])
    s = scraped.select("urn", *[F.col(x).alias(f"s_{x}") for x in ("name", "address", "la", "gender", "ofstedRating", "website", "phone", "status")])
    out = s.join(r, "urn", "full").join(c, "urn", "full")
    name = F.coalesce(first_filled("s_name", "c_name", "r_name"), F.concat(F.lit("School URN "), "urn"))
    on_page = F.upper(F.regexp_extract(text("s_address"), r"(?i)[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}", 0))
    closed = F.lower(text("s_status")).contains("closed") | (text("r_status") == "Closed") | name.rlike(r"(?i)\(closed\)|\[closed\]")
    blank = F.lit("")
    return out.select(
        "urn", name.alias("name"), F.coalesce(first_filled(on_page, "c_postcode", "r_code"), blank).alias("postcode"),
        F.coalesce(first_filled("s_la", "r_la"), blank).alias("la"), F.coalesce(first_filled("s_gender", "r_gender"), F.lit("Mixed")).alias("gender"),
        F.coalesce(first_filled("s_ofstedRating", "c_ofsted"), blank).alias("ofstedRating"),
        F.coalesce(first_filled("s_website", "c_website"), blank).alias("website"), F.coalesce(first_filled("s_phone", "c_phone"), blank).alias("phone"),
        (~closed).alias("active"))


# ---- import triage -----------------------------------------------------------------------------

# What an imported row gets where it says nothing.
IMPORT_DEFAULTS = {
    "region": "Greater London", "schoolType": "Comprehensive", "gender": "Mixed", "ageRange": "11-18", "ofstedRating": "Good",
    "entranceExamType": "None / Standard", "admissionsPolicy": "Standard admissions policy.",
}


def triage(batch: DataFrame, entities: DataFrame, row: str = "rowNum") -> DataFrame:
    """Import rows marked invalid, duplicate or verified, with the reason and any existing id.

    A row repeats another one of its batch if an earlier *accepted* row has its
    name or its register key (``first_accepted``).
    """
    valid = filled("name") & filled("la")
    key = F.lower(trim_all("name"))
    urn = trim_all(text("urn"))
    b = batch.withColumns({"_name": key, "_urn": F.when((urn != "") & (urn != "N/A"), urn), "_ok": valid})
    names = entities.filter(filled("name")).groupBy(F.lower(trim_all("name")).alias("_name")).agg(F.max("id").alias("_by_name"))
    keys = entities.filter(filled("urn") & (F.col("urn") != "N/A")).groupBy(F.trim("urn").alias("_urn")).agg(F.max("id").alias("_by_urn"))
    b = saved(b.join(names, "_name", "left").join(keys, "_urn", "left"))
    known = F.coalesce("_by_name", "_by_urn")
    new = b.filter(F.col("_ok") & known.isNull()).select(row, "_name", "_urn")
    accepted = first_accepted(new, row, "_name", "_urn")
    out = b.join(accepted.select(row, F.lit(True).alias("_acc")), row, "left")
    # a known row is also a repeat if an accepted one came before it
    an = accepted.groupBy("_name").agg(F.min(row).alias("_an"))
    au = accepted.filter("_urn is not null").groupBy("_urn").agg(F.min(row).alias("_au"))
    out = out.join(an, "_name", "left").join(au, "_urn", "left")
    repeat = F.coalesce((F.col("_an") < F.col(row)) | F.coalesce(F.col("_au") < F.col(row), F.lit(False)), F.col("_au") < F.col(row), F.lit(False))
    state = F.when(~F.col("_ok"), "invalid").when(F.coalesce("_acc", F.lit(False)), "verified").otherwise("duplicate")
    reason = (
        F.when(~F.col("_ok"), "Missing school name or local authority").when(F.col("_acc"), F.lit(None))
        .when(repeat, "Duplicate entry within bulk batch").otherwise(F.concat(F.lit("Matches existing record in database ("), known, F.lit(")"))))
    helper = [c for c in out.columns if c.startswith("_")]
    return out.withColumns({"state": state, "reason": reason, "existingId": F.when(F.col("_ok"), known)}).drop(*helper)


def first_accepted(rows: DataFrame, row: str, *keys: str) -> DataFrame:
    """Rows accepted in ``row`` order (unique) when no earlier accepted row shares a key; null keys are never shared.

    Whole rounds settle at once the rows that come first in each of their groups,
    as long as that halves what is open, which rows in no particular order do. What
    is left hangs together in chains: its connected parts are labelled, and each is
    gone through in order.
    """
    todo, done, before = saved(rows), [], None
    while True:
        open_rows = todo.count()
        if before is not None and 2 * open_rows > before:
            done.append(_accepted_in_order(todo, row, keys))
            break
        if not open_rows:
            break
        before = open_rows
        firsts = todo
        for i, k in enumerate(keys):
            m = todo.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(row).alias(f"_m{i}"))
            firsts = firsts.join(m, k, "left")
        ok = F.lit(True)
        for i in range(len(keys)):
            ok = ok & F.coalesce(F.col(f"_m{i}") == F.col(row), F.lit(True))
        now = saved(firsts.filter(ok).select(*rows.columns))
        done.append(now)
        for k in keys:
            todo = todo.join(now.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
        todo = saved(todo.join(now.select(row), row, "left_anti").select(*rows.columns))
    out = todo.limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def _accepted_in_order(rows: DataFrame, row: str, keys: tuple[str, ...]) -> DataFrame:
    """``first_accepted`` part by part: rows that hang together over shared keys pass one task in order.

    A task remembers the taken keys that a later row of the part still holds, and
    nothing of the rows; sorting may spill.
    """
    groups = [rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(row).alias("primary"), F.max(row).alias(f"_last{i}")) for i, k in enumerate(keys)]
    ends = rows
    for k, g in zip(keys, groups, strict=True):
        ends = ends.join(g.drop("primary"), k, "left")
    ends = ends.select(F.col(row).alias("row"), *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], *[(F.col(f"_last{i}") == F.col(row)).alias(f"last{i}") for i in range(len(keys))])
    links = None
    for k, g in zip(keys, groups, strict=True):
        pairs = rows.join(g, k).select("primary", F.col(row).alias("secondary"))
        links = pairs if links is None else links.unionByName(pairs)
    parts = survivors(links)
    dealt = ends.join(parts, F.col("row") == F.col("secondary"), "left").withColumn("part", F.coalesce("primary", "row")).drop("primary", "secondary")
    n, kind = len(keys), rows.schema[row].dataType.simpleString()

    def run(batches):
        part, taken = None, [set() for _ in range(n)]
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            accepted = []
            for at, p in enumerate(cols[-1]):
                if p != part:
                    part, taken = p, [set() for _ in range(n)]
                held = [(t, c[at], last[at]) for t, c, last in zip(taken, cols[1 : 1 + n], cols[1 + n : 1 + 2 * n], strict=True) if c[at] is not None]
                free = not any(k in t for t, k, _ in held)
                if free:
                    accepted.append(at)
                for t, k, last in held:
                    if last:
                        t.discard(k)
                    elif free:
                        t.add(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(accepted, pa.int64()))], ["row"])

    found = dealt.repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, f"row {kind}")
    return saved(rows.join(found, rows[row] == found["row"], "left_semi"))


def cleaned_import(verified: DataFrame) -> DataFrame:
    """Verified rows trimmed and with the import defaults."""
    out = {}
    for c in verified.columns:
        if c in IMPORT_DEFAULTS:
            out[c] = F.when(filled(c), trim_all(c)).otherwise(IMPORT_DEFAULTS[c])
        elif dict(verified.dtypes)[c] == "string" and c not in ("id", "state", "reason", "existingId"):
            out[c] = trim_all(text(c))
    out["urn"] = F.coalesce(or_null(trim_all(text("urn"))), F.lit("N/A"))
    return verified.withColumns(out)
