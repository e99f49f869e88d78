"""Rules over stored rows: chronology, stale cycles, sanity, canonical forms, payloads and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions import dates, names
from dirwise.functions.sets import edit_tags
from dirwise.functions.values import (
    any_of, filled, first_filled, lenient_int, or_null, text, trim_all)
from dirwise.operators import filters as flt
from dirwise.operators.records import canonical_milestones

# The dates a chronology looks at and the names they are stored under.
CHRONOLOGY = {
    "deadline": ("registrationDeadline", "registrationCloseDate"),
    "exam": ("stage_one_examDate", "examDate", "firstExamDate"),
    "exam2": ("stage_two_examDate", "secondExamDate"),
    "results": ("firstStageResult", "resultsDate"),
    "offers": ("offersDate", "offersAcceptance", "offerDate"),
    "accept": ("acceptanceDeadline", "offerAcceptByDate"),
}
IN_ORDER = (("deadline", "exam"), ("exam", "exam2"), ("exam", "results"), ("offers", "accept"))
ANOMALY_TAG, STALE_TAG = "has_anomalies", "stale_dates_pending_recrawl"


def _date_texts(d: str = "entranceExamDates") -> dict[str, Column]:
    return {k: first_filled(*[F.try_element_at(F.col(d), F.lit(a)) for a in keys]) for k, keys in CHRONOLOGY.items()}


def chronology(df: DataFrame) -> DataFrame:
    """Rows with ``out_of_order`` and ``stale``."""
    texts = _date_texts()
    parsed = df.withColumn("_t", F.struct(*[c.alias(k) for k, c in texts.items()]))
    parsed = parsed.withColumn("_d", F.struct(*[dates.admissions_date(F.col(f"_t.{k}")).alias(k) for k in texts]))
    wrong = any_of([F.coalesce(F.col(f"_d.{a}") > F.col(f"_d.{b}"), F.lit(False)) for a, b in IN_ORDER])
    stale = dates.is_stale(F.concat_ws(" ", *[F.col(f"_t.{k}") for k in texts]))
    return parsed.withColumns({"out_of_order": wrong, "stale": stale}).drop("_t", "_d")


def guard(df: DataFrame) -> DataFrame:
    """Rows after the guard rules, with the flags of what was done.

    Out-of-order and stale rows are tagged (both tags where both hold), stale
    ones go back into the queue, state rows lose fees, and comprehensive rows
    have no second stage. ``fixes`` counts the sanity rules that changed a row.
    """
    checked = chronology(df)
    tags = F.col(flt.TAGS)
    mark_wrong = F.col("out_of_order") & ~F.array_contains(tags, ANOMALY_TAG)
    mark_stale = F.col("stale") & ~F.array_contains(tags, STALE_TAG)
    state_fee = F.col("schoolType").isin("Grammar", "Comprehensive") & filled("feesTermly")
    second = (F.col("schoolType") == "Comprehensive") & ~F.col("second_stage_exam_required").eqNullSafe(F.lit("No"))
    new = {
        flt.TAGS: F.concat(tags, F.when(mark_wrong, F.array(F.lit(ANOMALY_TAG))).otherwise(F.array().cast("array<string>")),
                           F.when(mark_stale, F.array(F.lit(STALE_TAG))).otherwise(F.array().cast("array<string>"))),
        "verification_status": F.when(mark_stale, "unverified").otherwise(F.col("verification_status")),
        "verified_at": F.when(~mark_stale, F.col("verified_at")),
        "feesTermly": F.when(~state_fee, F.col("feesTermly")),
        "second_stage_exam_required": F.when(second, "No").otherwise(F.col("second_stage_exam_required")),
        "fixes": state_fee.cast("int") + second.cast("int"),
    }
    new |= {c: F.when(~state_fee, F.col(c)) for c in ("fees_termly_gbp", "fees_annual_gbp") if c in df.columns}
    return checked.withColumns(new)


def standardize(df: DataFrame) -> DataFrame:
    """Rows with canonical postcode, gender, website and fees, and which of them changed."""
    policy = names.gender_policy("gender")
    fee = names.fee_number("feesTermly", 200, 50000)
    new = {
        "postcode": F.coalesce(names.postcode("postcode", "strict"), F.col("postcode")),
        "gender": F.coalesce(policy["gender"], F.col("gender")),
        "website": F.coalesce(names.clean_url("website"), F.col("website")),
    }
    changed = [F.when(~v.eqNullSafe(F.col(c)), F.lit(c)) for c, v in new.items()] + [F.when(fee.isNotNull(), F.lit("fees"))]
    return df.withColumns({
        **new, "sixthFormGenderPolicy": policy["sixth_form"], "fees_termly_gbp": fee, "fees_annual_gbp": fee * 3,
        "changed": F.array_compact(F.array(*changed))})


def roll_dates(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with milestones of the last cycle moved on, (id, field, old, new) of every moved one)."""
    m = F.col("entranceExamDates")
    moved = df.withColumn("_r", F.transform_values(m, lambda _, v: dates.roll_forward(v)))
    rows = moved.withColumn("entranceExamDates", F.transform_values("_r", lambda _, r: r["value"]))
    long = moved.select(key, F.explode("_r").alias("field", "_v"), m.alias("_m")).filter(F.size("_v.reasons") > 0)
    long = long.select(key, "field", F.try_element_at("_m", F.col("field")).alias("old"), F.col("_v.value").alias("new"))
    return rows.drop("_r"), long


def touched_fields(moved: DataFrame, parent: str = "entranceExamDates", key: str = "id") -> DataFrame:
    """(id, fields): moved milestones of each row and the column they live in."""
    return moved.groupBy(key).agg(F.array_sort(F.array_union(F.collect_set("field"), F.array(F.lit(parent)))).alias("fields"))


def drop_reviews(reviews: DataFrame, touched: DataFrame) -> DataFrame:
    """Reviews of fields that were changed since do not hold any more."""
    t = touched.select(F.col("id").alias("schoolId"), F.explode("fields").alias("fieldName"))
    return reviews.join(t, ["schoolId", "fieldName"], "left_anti")


def clear_test_values(df: DataFrame) -> DataFrame:
    """Test texts emptied and their rows queued again; test rows dropped; placeholder keys cleared."""
    marks = {c: flt.is_test_text(c) for c in ("name", "address", "website")}
    hit = any_of(list(marks.values()))
    new = {c: F.when(m, "").otherwise(F.col(c)) for c, m in marks.items()}
    new |= {
        "verification_status": F.when(hit, "unverified").otherwise(F.col("verification_status")),
        "verified_at": F.when(~hit, F.col("verified_at")), "confidence_score": F.when(hit, 50).otherwise(F.col("confidence_score")),
        flt.TAGS: F.when(hit, F.array(F.lit("unscanned"))).otherwise(F.col(flt.TAGS)),
        "urn": F.when(flt.is_placeholder_key(), "").otherwise(F.col("urn")),
    }
    return df.filter(~flt.is_test_id()).withColumns(new)


# ---- website checks ----------------------------------------------------------------------------


def fetch_state(code: Column, redirect: Column, error: Column) -> Column:
    """redirect, healthy, not_found, active_with_warning, timeout or error."""
    return (
        F.when(text(error).rlike("(?i)time"), "timeout").when(filled(error), "error")
        .when(code.isin(301, 302, 307, 308) & filled(redirect), "redirect").when(code.between(200, 399), "healthy")
        .when(code.isin(404, 410), "not_found").otherwise("active_with_warning"))


def website_verdicts(df: DataFrame, fetched: DataFrame, as_of: str, newest: Column | None = None) -> DataFrame:
    """Entities with what a table of fetch results (id, status, redirectUrl) says about their site.

    Of several results for one entity the first counts, by ``newest`` (a number that is smallest for the newest) if given, then by status.
    """
    order = (F.lit(0) if newest is None else newest).alias("_o")
    once = fetched.groupBy("id").agg(F.min(F.struct(order, F.col("status").alias("_st"), F.col("redirectUrl").alias("_to"))).alias("_f"))
    out = df.join(once.select("id", "_f._st", "_f._to"), "id", "left")
    checked, st = F.col("_st").isNotNull() & filled("website"), F.col("_st")
    raw = trim_all(text("website"))
    up = (st == "redirect") & raw.startswith("http://") & text("_to").startswith("https://")
    dead = st.isin("not_found", "timeout", "error")
    action = (F.when(~checked, F.lit(None)).when(up, "Auto-Upgraded to HTTPS").when((st == "redirect") & filled("_to"), "Redirect Verified")
              .when(dead, "Tagged dead_website").otherwise("Verified Clean"))
    tags = edit_tags(flt.TAGS, add=[F.when(checked, F.lit("web_health_audited")), F.when(checked & dead, F.lit("dead_website"))])
    return out.withColumns({
        "website": F.when(checked & up, F.col("_to")).when(checked, raw).otherwise(F.col("website")), flt.TAGS: tags,
        "verified_at": F.when(checked, F.lit(as_of)).otherwise(F.col("verified_at")), "action": action}).drop("_st", "_to")


# ---- payloads ----------------------------------------------------------------------------------

# Longest milestone texts and what no milestone may say.
FORMAT_LENGTH, DATE_LENGTH = 300, 120
BROKEN_TEXT = r"(?i)^(undefined|null|error|404|NaN)$"


def validate(name: Column, milestones: Column, website: Column, email: Column) -> Column:
    """struct(valid, reason) of a payload."""
    is_format = lambda k: k.contains("format") | k.contains("subject")
    bad = F.map_filter(milestones, lambda k, v: F.coalesce(
        (F.length(v) > F.when(is_format(k), FORMAT_LENGTH).otherwise(DATE_LENGTH))
        | (~is_format(k) & (k != "second_stage_exam_required") & trim_all(v).rlike(BROKEN_TEXT)), F.lit(False)) & (v != ""))
    first_bad = F.array_min(F.map_keys(bad))
    site, mail = text(website), text(email)
    given = lambda c: ~trim_all(c).isin("", "N/A", "null")
    reason = (
        F.when(trim_all(text(name)) == "", "Missing name")
        .when(F.size(bad) > 0, F.concat(F.lit("Invalid date format for "), first_bad))
        .when(given(site) & ~site.startswith("http://") & ~site.startswith("https://") & ~site.contains("."), "Invalid website URL format")
        .when(given(mail) & ~(mail.contains("@") & mail.contains(".")), "Invalid email format"))
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


# Every name a payload may use for a field, best first.
PAYLOAD_ALIASES = {
    "schoolType": ("schoolType", "type"),
    "rawSchoolType": ("rawSchoolType", "raw_school_type", "schoolTypeDetail", "school_type_detail"),
    "ageRange": ("ageRange", "age_range"),
    "description": ("description", "summary", "overview"),
    "admissionsPolicy": ("admissionsOverview", "admissions_overview", "admissionsPolicy", "admissions_policy", "processOverview", "admissionsProcess"),
    "entranceExamType": ("entranceExamType", "examType", "examBoard"),
    "feesTermly": ("feesTermly", "fees_termly", "termlyFees", "feesPerTerm"),
    "registrationFee": ("registrationFee", "registration_fee", "examRegistrationFee", "applicationFee"),
    "sourceUrl": ("sourceUrl", "source_url", "source", "verificationSource", "sourceLink"),
}
RANKS = ("national_rank_england", "gcse_rank_england", "a_level_rank_england")


def read_payload(df: DataFrame, payload: str, key: str = "id") -> DataFrame:
    """One typed row per JSON payload: aliases resolved, values checked, blanks null.

    Missing texts stay null, so the result can be laid over stored rows.
    """
    v = F.try_parse_json(payload)
    j = df.select(key, v.alias("_v"))
    field = lambda *ks: first_filled(*[F.try_variant_get("_v", f"$.{k}", "string") for k in ks])
    clean = lambda c: F.when(~trim_all(c).isin("", "null"), trim_all(c))
    out = {k: clean(field(*a)) for k, a in PAYLOAD_ALIASES.items()}
    out["admissionsPolicy"] = trim_all(F.regexp_replace(F.regexp_replace(out["admissionsPolicy"], r"(?i)^```[a-z]*\s*", ""), r"\s*```$", ""))
    out["sourceUrl"] = F.when(out["sourceUrl"].startswith("http"), out["sourceUrl"])
    out["registrationFee"] = F.when(out["registrationFee"] != "N/A", out["registrationFee"])
    out["gender"] = F.when(field("gender").isin("Boys", "Girls", "Mixed"), field("gender"))
    out["website"] = F.when(field("website").startswith("http"), trim_all(field("website")))
    out["phone"] = clean(field("phone"))
    out["email"] = F.when(field("email").contains("@"), trim_all(field("email")))
    out["address"] = F.when(clean(field("address")) != "N/A", clean(field("address")))
    out["postcode"] = F.when(clean(field("postcode")) != "N/A", F.upper(clean(field("postcode"))))
    milestones = F.coalesce(F.try_variant_get("_v", "$.entranceExamDates", "map<string,string>"), F.create_map().cast("map<string,string>"))
    out["entranceExamDates"] = canonical_milestones(milestones)
    stage = field("second_stage_exam_required")
    out["second_stage_exam_required"] = F.when(stage.isNotNull(), F.when(F.lower(stage).startswith("y"), "Yes").otherwise("No"))
    for c in ("stage_one_format_and_subjects", "stage_two_format_and_subjects"):
        out[c] = clean(field(c))
    rank = lambda c: F.when(lenient_int(field(c)) > 0, lenient_int(field(c)).cast("int"))
    out |= {c: rank(c) for c in RANKS}
    score = lenient_int(field("confidenceScore"))
    out["confidenceScore"] = F.greatest(F.lit(70), F.least(F.lit(100), F.coalesce(F.when(score != 0, score), F.lit(95)))).cast("int")
    return j.select(key, F.col("_v").isNotNull().alias("readable"), *[c.alias(k) for k, c in out.items()])


PLAIN_FIELDS = (
    "admissionsPolicy", "description", "rawSchoolType", "schoolType", "ageRange", "website", "phone", "email", "entranceExamType", "feesTermly",
    "registrationFee", "sourceUrl", "second_stage_exam_required", "stage_one_format_and_subjects", "stage_two_format_and_subjects",
)
CRAWL_TAGS = ("llm_verified", "auto_verified", "p0_cycle_current", "dates_verified")


def confirmed(old: Column, new: Column, form=None) -> Column:
    f = form or (lambda c: c)
    return (text(new) != "") & (f(text(old)) == f(text(new)))


def apply_payload(base: DataFrame, payload: DataFrame, as_of: str, provider_tag: str = "gemini_crawl") -> DataFrame:
    """Stored rows with what a payload row of the same id adds, plus ``updated`` and ``verified`` field names.

    A single-sex entity becomes Mixed only at 95 or more with a website; an
    address is never replaced by a coarser one. Rows that gain something are
    marked enriched, rows that are only confirmed are marked verified, rows
    the payload says nothing about stay as they are.
    """
    types = dict(base.dtypes)
    plain = [c for c in PLAIN_FIELDS if c in base.columns and c in payload.columns]
    p = payload.select(F.col("id"), F.struct(*[c for c in payload.columns if c != "id"]).alias("_p"))
    out = base.join(p, "id", "left")
    n = lambda c: F.col(f"_p.{c}")
    take: dict[str, Column] = {c: n(c).isNotNull() & (trim_all(text(c)) != trim_all(n(c))) for c in plain}
    g = trim_all(text("gender"))
    proof = (n("confidenceScore") >= 95) & n("website").isNotNull()
    single = g.isin("Boys", "Girls") & (n("gender") == "Mixed")
    take["gender"] = n("gender").isNotNull() & (g.isin("", "N/A") | ((g != n("gender")) & (~single | proof)))
    take["address"] = n("address").isNotNull() & names.better_address("address", n("address"))
    take["postcode"] = n("postcode").isNotNull() & (F.upper(trim_all(text("postcode"))) != n("postcode"))
    take |= {c: n(c).isNotNull() & ~F.col(c).eqNullSafe(n(c)) for c in RANKS if c in base.columns}
    old_m, new_m = F.coalesce("entranceExamDates", F.create_map().cast("map<string,string>")), n("entranceExamDates")
    differs = F.map_filter(new_m, lambda k, v: ~trim_all(text(F.try_element_at(old_m, k))).eqNullSafe(trim_all(v)))
    take["entranceExamDates"] = F.coalesce(F.size(differs) > 0, F.lit(False))
    take = {c: F.coalesce(v, F.lit(False)) for c, v in take.items()}
    same = lambda c, form=None: F.coalesce(confirmed(F.col(c), n(c), form), F.lit(False))
    bare = lambda c: F.regexp_replace(c, r"[\s()-]", "")
    forms = {"website": lambda c: F.regexp_replace(F.lower(c), "/$", ""), "entranceExamType": F.lower, "gender": F.lower, "phone": bare, "email": F.lower,
             "postcode": lambda c: F.regexp_replace(F.upper(c), r"\s+", "")}
    agreed = F.array_compact(F.array(*[F.when(same(c, f), F.lit(c)) for c, f in forms.items()]))
    dates_same = F.map_filter(new_m, lambda k, v: (trim_all(text(F.try_element_at(old_m, k))) == trim_all(v)) & (trim_all(v) != "TBC"))
    agreed = F.concat(agreed, F.coalesce(F.transform(F.array_sort(F.map_keys(dates_same)), lambda k: F.concat(F.lit("entranceExamDates."), k)),
                                         F.array().cast("array<string>")))
    out = out.withColumns({"updated": F.array_compact(F.array(*[F.when(v, F.lit(c)) for c, v in take.items()])), "verified": agreed})
    gained, only_seen = F.size("updated") > 0, (F.size("updated") == 0) & (F.size("verified") > 0)
    new = {c: F.when(v, n(c).cast(types[c]) if c not in ("entranceExamDates",) else n(c)).otherwise(F.col(c)) for c, v in take.items()}
    seen = edit_tags(flt.TAGS, add=[provider_tag, *CRAWL_TAGS])
    new[flt.TAGS] = F.when(gained, edit_tags(flt.TAGS, add=[provider_tag, "llm_verified", "llm_enriched", *CRAWL_TAGS[1:]])).when(only_seen, seen).otherwise(F.col(flt.TAGS))
    new["verification_status"] = F.when(gained, "llm_enriched").when(only_seen, "auto_verified").otherwise(F.col("verification_status"))
    new["verified_at"] = F.when(gained | only_seen, F.lit(as_of)).otherwise(F.col("verified_at"))
    floor = F.greatest(F.coalesce(F.when(F.col("confidence_score") != 0, F.col("confidence_score")), F.lit(85)), F.lit(95))
    new["confidence_score"] = F.when(gained, n("confidenceScore")).when(only_seen, floor).otherwise(F.col("confidence_score"))
    return out.withColumns(new).drop("_p")


# ---- differences -------------------------------------------------------------------------------

# Milestones compared and their names, old and new.
DIFF_MILESTONES = {
    "registrationOpen": ("registrationOpen",), "registrationDeadline": ("registrationDeadline",),
    "stage_one_examDate": ("stage_one_examDate", "examDate", "stage1ExamDate"),
    "stage_one_format_and_subjects": ("stage_one_format_and_subjects", "stage1Format", "stage_one_format"),
    "stage_one_resultDate": ("stage_one_resultDate", "resultDate", "stage1ResultDate"),
    "second_stage_exam_required": ("second_stage_exam_required", "stage2Required", "secondStageRequired"),
    "stage_two_examDate": ("stage_two_examDate", "examDate2", "secondExamDate", "stage2ExamDate"),
    "stage_two_format_and_subjects": ("stage_two_format_and_subjects", "stage2Format", "stage_two_format"),
    "interviewDates": ("interviewDates", "interviewDate"), "offerDate": ("offerDate", "offersDate"),
    "acceptanceDeadline": ("acceptanceDeadline",),
}
DIFF_FIELDS = ("website", "entranceExamType", "gender", "phone", "email", "feesTermly", "registrationFee", "address", "postcode", "admissionsPolicy", "description")


def _long(df: DataFrame, key: str, out: str) -> DataFrame:
    """(id, field, value) of the compared fields and milestones of a table."""
    m = F.col("entranceExamDates")
    items = [F.struct(F.lit(f"entranceExamDates.{k}").alias("field"), trim_all(F.coalesce(*[F.try_element_at(m, F.lit(a)) for a in al])).alias("value"))
             for k, al in DIFF_MILESTONES.items()] if "entranceExamDates" in df.columns else []
    items += [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in DIFF_FIELDS if c in df.columns]
    return df.select(key, F.explode(F.array(*items)).alias("s")).select(key, "s.field", F.col("s.value").alias(out))


def field_differences(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, field, oldVal, newVal) of everything the new rows would change."""
    both = _long(new, key, "newVal").filter(filled("newVal") & ~F.col("newVal").isin("N/A", "null")).join(_long(old, key, "oldVal"), [key, "field"], "left")
    o, n, f = text("oldVal"), F.col("newVal"), F.col("field")
    changed = (
        F.when(f == "postcode", F.upper(o) != F.upper(n)).when(f.isin("admissionsPolicy", "description"), (trim_all(n) != "") & (trim_all(o) != trim_all(n)))
        .when(f == "address", (o != n) & names.better_address(o, n)).when(f == "entranceExamType", (n != "Unknown") & (o != n)).otherwise(o != n))
    return both.filter(changed).select(key, "field", or_null("oldVal").alias("oldVal"), "newVal")


def confirmed_fields(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, field, value) of everything the new rows confirm."""
    both = _long(old, key, "oldVal").join(_long(new, key, "newVal"), [key, "field"])
    f = F.col("field")

    def form(c: Column) -> Column:
        t = trim_all(text(c))
        return (F.when(f == "website", F.regexp_replace(F.lower(t), "/$", "")).when(f.isin("entranceExamType", "gender", "email"), F.lower(t))
                .when(f == "phone", F.regexp_replace(t, r"[\s()-]", "")).when(f.isin("feesTermly", "registrationFee"), F.regexp_replace(t, r"\s+", ""))
                .when(f == "postcode", F.regexp_replace(F.upper(t), r"\s+", "")).otherwise(t))

    o = form(F.col("oldVal"))
    empty = (
        F.when(f.startswith("entranceExamDates"), o.isin("", "TBC", "N/A", "null")).when(f == "entranceExamType", o.isin("", "unknown", "n/a"))
        .when(f == "postcode", o.isin("", "N/A")).when(f == "admissionsPolicy", F.length(o) <= 20).when(f == "gender", o == "").otherwise(o.isin("", "n/a")))
    use = ~f.isin("address", "description")
    return both.filter(use & ~empty & (o == form(F.col("newVal")))).select(key, "field", F.col("oldVal").alias("value"))


def saved_status(status: Column, tags: Column) -> Column:
    """Tags kept for a scan outcome: a failed scan proves nothing."""
    failed = status.isin("llm_error", "rate_limit_429") | status.contains("error") | status.contains("429")
    good = F.array(F.lit("llm_enriched"), F.lit("llm_verified"), F.lit("auto_verified"))
    return F.when(failed, F.filter(tags, lambda t: ~F.array_contains(good, t))).otherwise(tags)
