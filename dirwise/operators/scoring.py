"""Completeness, confidence and fit scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirwise.functions import geo
from dirwise.functions.values import (
    any_of, bind, clamp, contains_any, filled, nonzero, present, round_half_up, text, trim_all)
from dirwise.operators import filters as flt
from dirwise.session import saved

# What each part of a record is worth, in points.
WEIGHTS = {
    "website": 20, "examDates": 25, "examFormat": 15, "schoolClassification": 10, "academicOfsted": 10, "contactChannels": 8,
    "addressGeography": 6, "leadershipCapacity": 6,
}
COUNTED_MILESTONES = ("registrationOpen", "registrationDeadline", "examDate", "resultsDate", "offersAcceptance")


def _known(c: str, columns, absent: str = "unknown") -> Column:
    if c not in columns:
        return F.lit(False)
    return present(c) & ~F.lower(text(c)).contains(absent)


def _share(*parts: tuple[Column, float]) -> Column:
    """Sum of the shares of the conditions that hold, at most 1; rounded off float dust."""
    total = sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def completeness_parts(columns: list[str], weights: dict | None = None, pupils: str | None = None, head: str = "headteacher") -> dict[str, tuple]:
    """part -> (weight, share of it earned).

    ``pupils`` names the column counted as the number of pupils; by default
    none is, as the scores people know were made without it.
    """
    w = {**WEIGHTS, **(weights or {})}
    have = set(columns)
    dates = F.col("entranceExamDates")
    low_case = lambda k: F.coalesce(F.try_element_at(dates, F.lit(k)), F.try_element_at(dates, F.lit(k.lower())), F.col(k) if k in have else F.lit(None))
    given = [present(v) & ~contains_any(F.lower(text(v)), ("tbc", "n/a")) for v in map(low_case, COUNTED_MILESTONES)]
    independent = F.lower(text("schoolType")).contains("independent")
    fees = any_of([nonzero(c) if c == "fees_termly_gbp" else filled(c) for c in ("fees_termly_gbp", "feesTermly") if c in have])
    digits = F.regexp_replace(text("phone"), "[^0-9]", "")
    count = sum((g.cast("int") for g in given), F.lit(0))
    shares = {
        "website": trim_all(text("website")).startswith("http").cast("double"),
        "examDates": count / len(COUNTED_MILESTONES),
        "examFormat": _share((_known("entranceExamType", have), 0.7), (filled("stage_one_format_and_subjects") | filled("second_stage_exam_required"), 0.3)),
        "schoolClassification": _share((present("schoolType"), 0.6), (present("gender"), 0.4)),
        "academicOfsted": _share((_known("ofstedRating", have), 0.5), (F.col("gcseAttainment8").isNotNull(), 0.3),
                                 (nonzero("national_rank_england") | nonzero("gcse_rank_england"), 0.2)),
        "contactChannels": _share((F.length(digits) >= 7, 0.5), (present("email") & text("email").contains("@"), 0.5)),
        "addressGeography": _share((present("address"), 0.4), (present("postcode"), 0.4), (present("la"), 0.2)),
        "leadershipCapacity": _share((_known(head, have), 0.5), (fees | ~independent, 0.3), (nonzero(pupils) if pupils else F.lit(False), 0.2)),
    }
    return {k: (max(0, float(w[k] or 0)), s) for k, s in shares.items()}


def completeness(df: DataFrame, weights: dict | None = None, **slots) -> DataFrame:
    """Rows with ``completeness`` (0-100) and ``breakdown``, the points earned per part.

    Every part is rounded before the parts are added up.
    """
    parts = completeness_parts(df.columns, weights, **slots)
    top = sum(w for w, _ in parts.values())
    earned = F.struct(*[round_half_up(s * w).alias(k) for k, (w, s) in parts.items()])
    out = df.withColumn("breakdown", earned)
    total = sum((F.col(f"breakdown.{k}") for k in parts), F.lit(0))
    score = clamp(round_half_up(total / top * 100), 0, 100) if top else F.lit(0)
    return out.withColumn("completeness", score.cast("int"))


def rescored(df: DataFrame, weights: dict | None = None, **slots) -> DataFrame:
    """Rows with ``completeness_score`` renewed."""
    out = completeness(df, weights, **slots)
    return out.withColumn("completeness_score", F.col("completeness")).select(*df.columns)


# ---- recommendation ----------------------------------------------------------------------------

# How much an importance level counts, and what an unknown level counts per question.
IMPORTANCE = {"NA": 0.50, "not_important": 0.25, "somewhat": 0.60, "very": 0.85, "top_priority": 1.00}
UNKNOWN = {"proximity": 0.60, "academicExcellence": 0.85, "pupilProgress": 0.60}
MIDDLING = 0.50
PROXIMITY_STEPS = ((3.0, 1.00), (6.0, 0.88), (10.0, 0.72), (15.0, 0.52), (25.0, 0.32))
FAR, NAMED_PLACE = 0.12, 0.85


def steps(x: Column, ladder, otherwise: float, below: bool = True) -> Column:
    """Value of the first rung x stays within (or reaches, with below=False)."""
    out = F.when(F.lit(False), 0.0)
    for limit, value in ladder:
        out = out.when(x <= limit if below else x >= limit, value)
    return out.otherwise(otherwise)


def format_key() -> Column:
    """Exam kind and consortium of a row as one comparable key."""
    kind = F.lower(trim_all(text("entranceExamType")))
    group = F.lower(trim_all(text("exam_consortium")))
    group = F.when(group.isin("", "none", "null", "na"), "none").otherwise(group)
    t = (F.when(F.col("primary_exam_type_id").isNotNull(), F.concat(F.lit("T:"), F.col("primary_exam_type_id").cast("string")))
         .when(kind != "", F.concat(F.lit("TN:"), kind)).otherwise("T:none"))
    c = (F.when(F.col("exam_consortium_id").isNotNull(), F.concat(F.lit("C:"), F.col("exam_consortium_id").cast("string")))
         .otherwise(F.concat(F.lit("CN:"), group)))
    return F.concat_ws("|", t, c)


def format_label() -> Column:
    group = trim_all(text("exam_consortium"))
    named = filled("exam_consortium") & ~F.lower(group).isin("", "none", "null", "na")
    return (F.when(named, F.col("exam_consortium")).when(filled("entranceExamType") & (F.lower("entranceExamType") != "none"), F.col("entranceExamType")).otherwise(""))


def profile_kind() -> Column:
    """Kind of a saved entity as a profile counts it."""
    t = F.lower(trim_all(text("schoolType")))
    return (F.when(t.contains("grammar"), "grammar").when(t.contains("independent"), "independent")
            .when(contains_any(t, ("comprehensive", "academy", "community")), "comprehensive").when(t != "", t))


def profile(saved_rows: DataFrame) -> DataFrame:
    """One row: the sexes, types, exam formats and mean attainment of a user's saved entities."""
    cls = flt.sex_class()
    sex = F.when(cls["girls"], "girls").when(cls["boys"], "boys").when(cls["mixed"], "mixed")
    return saved_rows.agg(
        F.sort_array(F.collect_set(sex)).alias("sexes"), F.sort_array(F.collect_set(profile_kind())).alias("types"),
        F.sort_array(F.collect_set(format_key())).alias("formats"), F.coalesce(F.avg("gcseAttainment8"), F.lit(65.0)).alias("attainment"),
        F.count("*").alias("n"))


# Academic ladders per ability level.
GROWTH_LADDER = ((0.50, 1.00), (0.20, 0.85), (0.0, 0.70))
PROGRESS_LADDER = ((0.70, 1.00), (0.40, 0.85), (0.00, 0.65))


def academic_score(ability: str) -> Column:
    nat, gcse, alevel = (F.col(c) for c in ("national_rank_england", "gcse_rank_england", "a_level_rank_england"))
    att, prog = F.col("gcseAttainment8"), F.col("gcseProgress8")
    held = lambda c, cond: nonzero(c) & F.coalesce(cond, F.lit(False))
    if ability == "top_class":
        top = any_of([held(c, c <= 100) for c in (nat, gcse, alevel)])
        return (F.when(top, 1.00).when(held(nat, nat <= 250), 0.94).when(held(att, att >= 70), 0.90).when(held(nat, nat <= 500), 0.85).otherwise(0.45))
    if ability == "above_average":
        return (F.when(held(att, att >= 60), 0.92).when(held(nat, nat <= 400), 0.85).when(held(prog, prog >= 0.35), 0.85).otherwise(0.60))
    if ability in ("average", "below_average"):
        return steps(prog, GROWTH_LADDER, 0.40, below=False)
    return (F.when(held(nat, nat <= 100), 0.95).when(held(att, att >= 65), 0.85).when(held(prog, prog >= 0.40), 0.80).otherwise(MIDDLING))


def academic_reason(ability: str) -> Column:
    nat, gcse, alevel = (F.col(c) for c in ("national_rank_england", "gcse_rank_england", "a_level_rank_england"))
    att, prog = F.col("gcseAttainment8"), F.col("gcseProgress8")
    held = lambda c, cond: nonzero(c) & F.coalesce(cond, F.lit(False))

    def say(pattern: str, value: Column) -> Column:
        shown = F.regexp_replace(value.cast("string"), r"\.0$", "")
        before, after = pattern.split("{}")
        return F.concat(F.lit(before), shown, F.lit(after))

    if ability == "top_class":
        top = any_of([held(c, c <= 100) for c in (nat, gcse, alevel)])
        first = F.coalesce(*[F.when(nonzero(c), c) for c in (nat, gcse, alevel)])
        return (F.when(top, say("Top 100 League Table School in England (#{})", first)).when(held(nat, nat <= 250), say("Top 250 School in England (#{} National)", nat))
                .when(held(att, att >= 70), say("Outstanding GCSE Attainment 8 ({})", att)).when(held(nat, nat <= 500), say("Top 500 School in England (#{} National)", nat)))
    if ability == "above_average":
        return (F.when(held(att, att >= 60), say("Strong GCSE Attainment 8 ({})", att)).when(held(nat, nat <= 400), say("Ranked #{} in England League Tables", nat))
                .when(held(prog, prog >= 0.35), say("High Pupil Progress (+{})", prog)))
    if ability in ("average", "below_average"):
        return (F.when(prog >= 0.50, say("Top 5% Student Growth in England (Progress 8: +{})", prog))
                .when(prog >= 0.20, say("Above Average Pupil Growth (Progress 8: +{})", prog)))
    return (F.when(held(nat, nat <= 100), say("Top 100 School in England (#{})", nat)).when(held(att, att >= 65), say("High Academic Attainment 8 ({})", att))
            .when(held(prog, prog >= 0.40), say("Strong Progress 8 Growth (+{})", prog)))


def rating_adjustment() -> Column:
    r = F.lower(text("ofstedRating"))
    return (F.when(contains_any(r, ("outstanding", "excellent")), 4).when(r.contains("good"), 2)
            .when(contains_any(r, ("requires improvement", "special measures", "inadequate")), -30).otherwise(0))


USER_COLUMNS = {
    "ability": "string", "rating": "string", "proximity": "string", "academicExcellence": "string", "pupilProgress": "string",
    "sexes": "array<string>", "types": "array<string>", "exam_formats": "array<string>", "places": "array<string>",
}
RATING_LEVELS = ("outstanding", "good")
#: Blocks that the classes of entities are dealt into; every user meets each block.
USER_BLOCKS = 64
#: Entities that a block holds, about, where every user meets all entities.
BLOCK_ENTITIES = 1000


def _sexes_fit(wanted: Column) -> Column:
    """``filters.accepts_sexes`` for an array column of wishes."""
    chosen = F.array_intersect(F.transform(wanted, lambda w: F.when(w == "co-ed", "mixed").otherwise(w)), F.array(*[F.lit(w) for w in ("boys", "girls", "mixed")]))
    cls = flt.sex_class()
    fits = any_of([F.array_contains(chosen, w) & cls[w] for w in ("boys", "girls", "mixed")])
    return any_of([F.size(wanted) == 0, F.array_contains(wanted, "NA"), F.array_contains(wanted, "all"), F.size(chosen).isin(0, 3)]) | fits


def _types_fit(wanted: Column) -> Column:
    """``filters.accepts_types`` for an array column of wishes."""
    t = F.lower(text("schoolType"))

    def fits(w: Column, t: Column) -> Column:
        w = F.lower(F.trim(w))
        return F.when(w == "comprehensive", contains_any(t, ("comprehensive", "academy", "community"))).otherwise(F.contains(t, w))

    # the type goes in as an array: a predicate whose lambda reads a column is pushed to the wrong side of a join by the optimizer
    each = F.zip_with(wanted, F.array_repeat(t, F.size(wanted)), fits)
    return any_of([F.size(wanted) == 0, F.array_contains(wanted, "NA"), F.array_contains(wanted, "all")]) | F.array_contains(each, True)


def _by_ability(of, ability: Column) -> Column:
    """A ladder or reason per level of ability; unknown levels take the general one."""
    out = F.when(ability == "top_class", of("top_class")).when(ability == "above_average", of("above_average"))
    return out.when(ability.isin("average", "below_average"), of("average")).otherwise(of("NA"))


def _profiles(df: DataFrame, users: DataFrame, saved_ids: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """One row per user: wishes (u_..), what the saved entities have in common (p_..) and the points that distances count from."""
    kept = saved_ids.select("user_id", "id").distinct().join(df, "id")
    cls = flt.sex_class()
    sex = F.when(cls["girls"], "girls").when(cls["boys"], "boys").when(cls["mixed"], "mixed")
    at = F.col("easting").isNotNull() & (F.col("easting") != 0) & F.col("northing").isNotNull() & (F.col("northing") != 0)
    mean = lambda c: round_half_up(F.avg(F.when(at, F.col(c)))).cast("double")
    own = kept.groupBy("user_id").agg(
        F.collect_set(sex).alias("p_sexes"), F.collect_set(profile_kind()).alias("p_types"), F.collect_set(format_key()).alias("p_formats"),
        F.struct(mean("easting").alias("e"), mean("northing").alias("n")).alias("middle"))
    spots = (anchors.select("user_id", F.struct(F.col("easting").cast("double").alias("e"), F.col("northing").cast("double").alias("n")).alias("p")).groupBy("user_id").agg(F.collect_list("p").alias("points"))
             if anchors is not None else own.limit(0).select("user_id", F.array("middle").alias("points")))
    none = F.array().cast("array<string>")
    asked = [(F.coalesce(F.col(c).cast(t), none) if t.startswith("array") else F.col(c).cast(t)).alias(f"u_{c}") if c in users.columns
             else (none if t.startswith("array") else F.lit(None).cast(t)).alias(f"u_{c}") for c, t in USER_COLUMNS.items()]
    u = users.select("user_id", *asked).join(own, "user_id", "left").join(spots, "user_id", "left")
    given = F.coalesce(F.filter("points", lambda p: p["e"].isNotNull()), F.filter(F.array("middle"), lambda p: p["e"].isNotNull()))
    return u.select("user_id", *[f"u_{c}" for c in USER_COLUMNS], *[F.coalesce(c, none).alias(c) for c in ("p_sexes", "p_types", "p_formats")], given.alias("points"))


def _admitted() -> Column:
    """Whether an entity passes a user's wishes for sexes, types and rating."""
    sexes, types = F.col("u_sexes"), F.col("u_types")
    floors = F.when(F.lit(False), F.lit(True))
    for level in RATING_LEVELS:
        floors = floors.when(F.lower(F.trim("u_rating")) == level, flt.rating_floor(level))
    sex_ok = (F.size(sexes) + F.size("p_sexes") == 0) | _sexes_fit(F.array_union(sexes, F.col("p_sexes")))
    type_ok = (F.size(types) == 0) | _types_fit(F.array_union(F.transform(types, lambda t: F.lower(F.trim(t))), F.col("p_types")))
    return sex_ok & type_ok & F.coalesce(floors, F.lit(True))


def _kind_fit() -> tuple[Column, ...]:
    """Whether types are asked for, known from saved entities, met as asked, met as saved (also if blank, and not), and what that counts."""
    types = F.col("u_types")
    fits_saved = _types_fit(F.col("p_types"))
    asks_type, has_type = F.size(types) > 0, F.size("p_types") > 0
    asked_type, fits = _types_fit(types), filled("schoolType") & fits_saved
    other = F.array_contains("p_types", "independent") & text("schoolType").contains("Grammar")
    kind = (F.when(asks_type, F.when(asked_type, 1.00).when(fits_saved, 0.70).otherwise(0.40))
            .when(has_type, F.when(fits, 0.90).when(other, 0.75).otherwise(MIDDLING)).otherwise(MIDDLING))
    return asks_type, has_type, asked_type, fits_saved, fits, kind


def _fit(proximity: Column, exam: Column, academic: Column, growth: Column, kind: Column, adjustment: Column, asked_sex: Column) -> Column:
    """The weighted score; it never falls when a part rises."""
    levels = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])
    mult = {k: F.coalesce(F.try_element_at(levels, F.coalesce(F.col(f"u_{k}"), F.lit(""))), F.lit(v)) for k, v in UNKNOWN.items()}
    w = {"near": mult["proximity"] * 20, "exam": F.lit(25.0), "academic": mult["academicExcellence"] * 25, "growth": mult["pupilProgress"] * 15, "kind": F.lit(15.0)}
    total = w["near"] + w["exam"] + w["academic"] + w["growth"] + w["kind"]
    fit = (proximity * w["near"] + exam * w["exam"] + academic * w["academic"] + growth * w["growth"] + kind * w["kind"]) / total * 100
    return clamp(round_half_up(fit + adjustment + F.when(asked_sex, 8).otherwise(0)), 15, 99)


def _growth() -> Column:
    prog = F.col("gcseProgress8")
    return F.when(prog.isNull(), MIDDLING).otherwise(steps(prog, PROGRESS_LADDER, 0.35, below=False))


def _advised(pool: DataFrame) -> DataFrame:
    """user_id, id, matchScore, distanceMiles, reasons for pairs of a user and an entity that passes the wishes."""
    sexes, types, formats = F.col("u_sexes"), F.col("u_types"), F.col("u_exam_formats")
    pool = pool.filter(_admitted())
    metres = F.array_min(F.transform("points", lambda p: geo.grid_metres("easting", "northing", p["e"], p["n"])))
    pool = pool.withColumn("distanceMiles", F.round(metres / geo.METRES_PER_MILE, 2))
    miles = F.col("distanceMiles")
    near = F.when(miles.isNull(), MIDDLING).otherwise(steps(miles, PROXIMITY_STEPS, FAR))
    where = [F.lower(text(c)) for c in ("la", "postcode", "address")]
    token = F.get(F.filter("u_places", lambda t: any_of([F.contains(p, F.lower(t)) for p in where])), F.lit(0))
    proximity = F.when(token.isNotNull(), F.greatest(near, F.lit(NAMED_PLACE))).otherwise(near)

    shared = F.array_contains("p_formats", format_key())
    exam_words = [F.lower(text("entranceExamType")), F.lower(text("exam_consortium"))]
    wanted = F.exists(formats, lambda f: any_of([F.contains(w, F.lower(F.trim(f))) for w in exam_words]))
    label = format_label()
    grouped = filled("exam_consortium") & (F.lower("exam_consortium") != "none")
    shown = F.when(label != "", label).otherwise(F.coalesce(F.nullif(text("exam_consortium"), F.lit("")), F.col("entranceExamType")))
    none_text = F.lit(None).cast("string")
    asks_exam, has_exam = F.size(formats) > 0, F.size("p_formats") > 0
    exam = (F.when(asks_exam, F.when(wanted, 1.00).when(shared, 0.80).otherwise(0.40)).when(has_exam, F.when(shared, 0.95).otherwise(0.40)).otherwise(MIDDLING))
    exam_reason = (
        F.when(asks_exam, F.when(wanted, F.concat(F.lit("Matches requested exam format: "), shown)).when(
            shared, F.concat(F.lit("Shares exam format with shortlisted schools ("), F.when(label != "", label).otherwise("Shortlist compatible admissions format"), F.lit(")"))))
        .when(has_exam, F.when(shared, F.when(grouped, F.concat(F.lit("Shares "), F.col("exam_consortium"), F.lit(" admissions format")))
                               .otherwise(F.concat(F.lit("Matches entrance exam format: "), F.when(label != "", label).otherwise(text("entranceExamType"))))))
        .otherwise(none_text))

    asks_type, has_type, asked_type, fits_saved, fits, kind = _kind_fit()
    kind_reason = (
        F.when(asks_type, F.when(asked_type, F.concat(F.lit("Matches requested school type: "), text("schoolType")))
               .when(fits_saved, F.concat(F.lit("Shares school type with shortlisted schools ("), text("schoolType"), F.lit(")"))))
        .when(has_type, F.when(fits, F.concat(F.lit("Matches school type of your shortlisted schools ("), text("schoolType"), F.lit(")")))).otherwise(none_text))

    prog = F.col("gcseProgress8")
    growth = F.when(prog.isNull(), MIDDLING).otherwise(steps(prog, PROGRESS_LADDER, 0.35, below=False))
    asked_sex = (F.size(sexes) > 0) & _sexes_fit(sexes)
    score = _fit(proximity, exam, _by_ability(academic_score, F.coalesce("u_ability", F.lit("NA"))), growth, kind, rating_adjustment(), asked_sex)
    ability = F.coalesce("u_ability", F.lit("NA"))

    shown_miles = F.format_string("%.1f", miles)
    near_reason = (F.when(miles <= 3.0, F.concat(shown_miles, F.lit(" miles away • Very close commute")))
                   .when(miles <= 6.0, F.concat(shown_miles, F.lit(" miles away • Within local radius"))).when(miles <= 10.0, F.concat(F.lit("~"), shown_miles, F.lit(" miles away"))))
    place_reason = F.when(near_reason.isNull() & token.isNotNull(), F.concat(F.lit("Located in "), F.coalesce(F.nullif(text("la"), F.lit("")), token)))
    top_rated = F.when(rating_adjustment() == 4, "Ofsted Outstanding")
    said = F.array_distinct(F.array_compact(F.array(exam_reason, near_reason, place_reason, _by_ability(academic_reason, ability), kind_reason, top_rated)))
    fallback = F.when(filled("schoolType"), F.concat(F.col("schoolType"), F.lit(" secondary school"))).otherwise("High school recommendation")
    reasons = F.when(F.size(said) > 0, F.slice(said, 1, 4)).otherwise(F.array(fallback))
    return pool.select("user_id", "id", score.cast("int").alias("matchScore"), "distanceMiles", reasons.alias("reasons"))


# ---- the best few, without scoring all pairs -----------------------------------------------------

#: Side of the squares that entities are grouped by, in metres.
SQUARE = 16_000
ABILITIES = ("top_class", "above_average", "average", "NA")
#: Entities looked at for a first k-th score, as a multiple of k.
FIRST_LOOK = 4


def _classed(df: DataFrame) -> DataFrame:
    """Entities with the class (_c1) and cell (_c2) they belong to.

    A class holds entities that agree in type, sexes, rating and growth; a cell those of
    a class that also agree in exam format and lie in one square.
    """
    rating = F.struct(rating_adjustment().alias("a"), *[flt.rating_floor(level).alias(level) for level in RATING_LEVELS])
    square = F.struct(F.floor(F.col("easting") / SQUARE).alias("x"), F.floor(F.col("northing") / SQUARE).alias("y"))
    df = df.withColumn("_c1", F.to_json(F.struct(text("schoolType").alias("t"), flt.sex_class().alias("s"), rating.alias("r"), _growth().alias("g"))))
    return df.withColumn("_c2", F.concat("_c1", F.to_json(F.struct(format_key().alias("f"), square.alias("q")))))


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Per class or cell: how many entities, one value of each column they agree in, the best academic scores, and the box they lie in."""
    whole = rows.withColumns({"_growth": _growth(), **{f"_ac_{a}": academic_score(a) for a in ABILITIES}, "_format": format_key()})
    at = F.col("easting").isNotNull() & F.col("northing").isNotNull()
    box = [f(F.when(at, F.col(c))).cast("double").alias(f"_{name}_{c}") for c in ("easting", "northing") for name, f in (("min", F.min), ("max", F.max))]
    return whole.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.min(c).alias(c) for c in ("schoolType", "gender", "ofstedRating")], F.max("_growth").alias("_growth"), F.min("_format").alias("_format"),
        *[F.max(f"_ac_{a}").alias(f"_ac_{a}") for a in ABILITIES], *box, F.bool_or(~at).alias("_unplaced"))


def _bound(formats: bool) -> Column:
    """The most that an entity of a class (or cell, whose entities share a format) can score for a user."""
    held = lambda p, c: F.least(F.greatest(p, F.col(f"_min_{c}")), F.col(f"_max_{c}"))
    metres = F.array_min(F.transform("points", lambda p: geo.grid_metres(held(p["e"], "easting"), held(p["n"], "northing"), p["e"], p["n"])))
    miles = F.round(metres / geo.METRES_PER_MILE, 2)
    near = F.when(miles.isNull(), MIDDLING).otherwise(steps(miles, PROXIMITY_STEPS, FAR))
    near = F.when(F.col("_unplaced"), F.greatest(near, F.lit(MIDDLING))).otherwise(near)
    near = F.when(F.size("u_places") > 0, F.greatest(near, F.lit(NAMED_PLACE))).otherwise(near)
    shared = F.array_contains("p_formats", F.col("_format")) if formats else F.lit(True)
    exam = F.when(F.size("u_exam_formats") > 0, 1.00).when(F.size("p_formats") > 0, F.when(shared, 0.95).otherwise(0.40)).otherwise(MIDDLING)
    academic = _by_ability(lambda a: F.col(f"_ac_{a}"), F.coalesce("u_ability", F.lit("NA")))
    asked_sex = (F.size("u_sexes") > 0) & _sexes_fit(F.col("u_sexes"))
    return _fit(near, exam, academic, F.col("_growth"), _kind_fit()[-1], rating_adjustment(), asked_sex)


def _first_few(groups: DataFrame, need: Column) -> DataFrame:
    """Of each user's groups the most promising ones, until they hold ``need`` entities."""
    order = Window.partitionBy("user_id").orderBy(F.desc("_most"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_before") < need).drop("_before")


def promising_pairs(df: DataFrame, u: DataFrame, gone: DataFrame, limit: int) -> DataFrame:
    """Pairs of a user and an entity (its own columns) among which the user's best ``limit`` are.

    Each user meets the classes of entities, few whatever the number of entities, with
    the most that each can score; the cells of the best classes and their best entities
    give a first k-th score, and from then on only classes and cells that may reach it
    are opened.
    """
    rows = saved(_classed(df))
    classes = _groups(rows, "_c1")
    cells = saved(_groups(rows, "_c1", "_c2"))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(USER_BLOCKS - 1).cast("bigint")))
    held = gone.groupBy("user_id").agg(F.count("*").alias("_gone"))
    u = saved(u.join(held, "user_id", "left").withColumn("_need", F.coalesce("_gone", F.lit(0)) + FIRST_LOOK * limit).drop("_gone"))
    met = u.withColumn("_block", F.pmod(F.xxhash64("user_id"), F.lit(USER_BLOCKS).cast("bigint"))).join(classes.withColumn("_block", blocks), "_block")
    met = saved(met.where(_admitted()).select("user_id", "_need", "_c1", F.col("_c1").alias("_key"), "_n", _bound(False).alias("_most")))

    def opened(chosen: DataFrame) -> DataFrame:
        """The cells of chosen classes with the most they can score."""
        inner = chosen.drop("_n", "_key", "_need").withColumnRenamed("_most", "_class_most").join(cells, "_c1").join(u, "user_id").where(_admitted())
        keep = [c for c in chosen.columns if c not in ("_n", "_key", "_need", "_most", "user_id", "_c1")]
        return inner.select("user_id", "_need", *keep, "_c2", F.col("_c2").alias("_key"), "_n", _bound(True).alias("_most"))

    def pairs(chosen: DataFrame) -> DataFrame:
        return chosen.select("user_id", "_c2").join(rows.drop("_c1"), "_c2").drop("_c2").join(gone, ["user_id", "id"], "left_anti")

    first = _advised(pairs(_first_few(opened(_first_few(met, F.col("_need"))), F.col("_need"))).join(u, "user_id"))
    kth = first.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("matchScore"), "id"))).where(F.col("_r") == limit)
    kth = saved(kth.select("user_id", F.col("matchScore").alias("_kth")))
    enough = F.col("_most") >= F.coalesce("_kth", F.lit(0))
    return pairs(opened(met.join(kth, "user_id", "left").where(enough)).where(enough)).join(u.drop("_need"), "user_id")


def recommend_many(df: DataFrame, users: DataFrame, saved_ids: DataFrame, removed: DataFrame | None = None, anchors: DataFrame | None = None, limit: int | None = 10) -> DataFrame:
    """Best-fitting entities for every user: user_id, id, matchScore, distanceMiles, reasons.

    df: located entities. users: user_id and any of ``USER_COLUMNS`` (a missing
    one is empty). saved_ids, removed: (user_id, id); saved entities shape a
    user's profile, neither is offered. anchors: (user_id, easting, northing)
    of the places a user named; without any, the middle of the saved ones.
    All is column work: profiles are grouped by user, and nothing is read to the
    driver. With a limit only pairs that may be among the best are scored
    (``promising_pairs``); without, entities are dealt into blocks that every
    user meets, with what the user is not offered of each: the pairs themselves,
    many times the input, are not exchanged.
    """
    u = _profiles(df, users, saved_ids, anchors)
    ids = saved_ids.select("user_id", "id").distinct()
    gone = ids if removed is None else ids.unionByName(removed.select("user_id", "id")).distinct()
    if limit is None:
        blocks = 1 + df.count() // BLOCK_ENTITIES
        block = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("bigint")).alias("_block")
        held = gone.groupBy("user_id", block).agg(F.collect_set("id").alias("_gone"))
        met = u.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        met = met.join(held.hint("merge"), ["user_id", "_block"], "left")
        pool = df.withColumn("_block", block).join(met.hint("merge"), "_block").where(~F.coalesce(F.array_contains("_gone", F.col("id")), F.lit(False)))
        return _advised(pool.drop("_block", "_gone"))
    out = _advised(promising_pairs(df, u, gone, limit))
    best = out.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("matchScore"), "id")))
    return best.filter(F.col("_n") <= limit).drop("_n")


def recommend(
    df: DataFrame, saved_ids: DataFrame, *, removed: DataFrame | None = None, sexes=(), types=(), rating: str | None = None,
    exam_formats=(), places=(), anchors=(), ability: str = "NA", importance: dict | None = None, limit: int | None = 10,
) -> DataFrame:
    """``recommend_many`` for one user, whose wishes are given as values: id, matchScore, distanceMiles, reasons, best first."""
    spark = df.sparkSession
    level = importance or {}
    wish = {"ability": ability, "rating": rating, **{k: level.get(k) for k in UNKNOWN}, "sexes": list(sexes), "types": list(types), "exam_formats": list(exam_formats), "places": list(places)}
    user = spark.createDataFrame([(0, *[wish[c] for c in USER_COLUMNS])], "user_id int, " + ", ".join(f"{c} {t}" for c, t in USER_COLUMNS.items()))
    mine = lambda ids: ids.select(F.lit(0).alias("user_id"), F.col(ids.columns[0]).alias("id"))
    spots = spark.createDataFrame([(0, float(e), float(n)) for e, n in anchors], "user_id int, easting double, northing double") if anchors else None
    out = recommend_many(df, user, mine(saved_ids), None if removed is None else mine(removed), spots, limit).drop("user_id")
    return out if limit is None else out.orderBy(F.desc("matchScore"), "id")


# ---- other scores ------------------------------------------------------------------------------


def place_score(query: str, near: list[dict]) -> Column:
    """struct(score, reason) of how close a row is to a typed place and to saved entities.

    near: a user's few saved entities as dicts with name, la, postcode,
    easting, northing; rows need easting and northing as well.
    """
    q = query.strip().upper()
    code, la, addr = F.upper(trim_all(text("postcode"))), F.lower(trim_all(text("la"))), F.lower(trim_all(text("address")))
    sector = F.split_part(code, F.lit(" "), F.lit(1))
    area = F.regexp_replace(code, r"[0-9\s]", "")
    best = lambda s, r: F.struct(F.lit(s).cast("double").alias("score"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    state = best(0.0, "")
    if q:
        q_area = "".join(ch for ch in q if not ch.isdigit() and not ch.isspace())
        state = (
            F.when(code == q, best(1.0, F.concat(F.lit("Exact postcode match ("), text("postcode"), F.lit(")"))))
            .when((sector != "") & (sector == q.split(" ")[0]), best(0.95, F.concat(F.lit("Same postcode sector ("), sector, F.lit(")"))))
            .when((area != "") & (area == q_area), best(0.75, F.concat(F.lit("Nearby postcode area ("), area, F.lit(")"))))
            .when(la.contains(q.lower()), best(0.85, F.concat(F.lit("Borough / LA match ("), text("la"), F.lit(")"))))
            .when(addr.contains(q.lower()), best(0.65, F.concat(F.lit("Address vicinity match ("), text("la"), F.lit(")"))))
            .otherwise(state))
    for u in near:
        u_la, u_sector = (u.get("la") or "").strip().lower(), (u.get("postcode") or "").strip().upper().split(" ")[0]
        if u_la:
            state = bind(state, _raise_to(la == u_la, 0.8, F.concat(F.lit("Same borough ("), text("la"), F.lit(") as saved school"))))
        if u_sector:
            state = bind(state, _raise_to(sector == u_sector, 0.9, F.concat(F.lit("Same postcode sector ("), sector, F.lit(") as saved school"))))
        if u.get("easting") and u.get("northing"):
            dx, dy = F.col("easting") - u["easting"], F.col("northing") - u["northing"]
            km = F.sqrt((dx * dx + dy * dy).cast("double")) / 1000
            value = F.when(F.col("easting").isNotNull(), steps(km, ((3.0, 1.0), (7.0, 0.85), (15.0, 0.65), (25.0, 0.40)), 0.0)).otherwise(0.0)
            state = bind(state, _raise_to(F.lit(True), value, F.concat(F.lit("~"), F.format_string("%.1f", km), F.lit(f" km from {u.get('name', '')}"))))
    return state


def _raise_to(cond: Column, value, reason: Column):
    v = value if isinstance(value, Column) else F.lit(value)

    def step(s: Column) -> Column:
        return F.when(cond & (s["score"] < v), F.struct(v.alias("score"), reason.alias("reason"))).otherwise(s)

    return step


def verification_confidence(status: Column, anomalies: Column) -> Column:
    """Confidence of a verification by its outcome and number of anomalies."""
    return (F.when(status == "dead_website", 45).when(status == "missing_website", 40).when(status == "crawl_stuck", 35)
            .when(anomalies == 0, 95).otherwise(F.greatest(F.lit(40), 90 - 15 * anomalies)))
