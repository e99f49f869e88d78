"""Shaping entity rows: typed reading, storing, overlays, milestones, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.names import fee_number, org_type, place_of
from dirwise.functions.sets import text_list
from dirwise.functions.values import col, filled, first_filled, lenient_float, lenient_int, or_null, text, trim_all

TEXT_COLUMNS = (
    "urn", "la", "region", "postcode", "address", "gender", "ageRange", "ofstedRating", "entranceExamType", "admissionsPolicy",
    "website", "phone", "email", "description", "feesTermly", "sixthFormGenderPolicy", "registrationFee", "sourceUrl",
    "second_stage_exam_required", "stage_one_format_and_subjects", "stage_two_format_and_subjects",
)
NUMBER_COLUMNS = ("fees_termly_gbp", "fees_annual_gbp", "national_rank_england", "gcse_rank_england", "a_level_rank_england")
PERFORMANCE_COLUMNS = ("gcseProgress8", "gcseAttainment8", "ebaccAveragePointScore")

# What a reader sees where nothing is stored, and public record pages.
DEFAULT_SOURCE = "DfE GIAS"
PERFORMANCE_PAGE = "https://www.compare-school-performance.service.gov.uk/school/"
REGISTER_PAGE = "https://get-information-schools.service.gov.uk/Establishments/Establishment/Details/"
DEFAULT_REGION = "Greater London"


def _set(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: v for k, v in changes.items()})


def performance_link(urn: Column | str = "urn") -> Column:
    u = trim_all(text(urn))
    return F.when(u != "", F.concat(F.lit(PERFORMANCE_PAGE), u))


def hydrate(df: DataFrame) -> DataFrame:
    """Stored rows as a reader wants them: no nulls in texts, numbers as numbers, three types."""
    have = set(df.columns)
    out: dict[str, Column] = {c: text(c) for c in TEXT_COLUMNS if c in have}
    out |= {c: lenient_int(c).cast("int") for c in NUMBER_COLUMNS if c in have}
    out |= {c: F.coalesce(F.col(c).cast("boolean"), F.lit(True)) for c in ("official", "active") if c in have}
    if "hot" in have:
        out["hot"] = F.coalesce(F.col("hot").cast("boolean"), F.lit(False))
    if "pupilCount" in have:
        out["pupilCount"] = F.coalesce(lenient_int("pupilCount").cast("int"), F.lit(0))
    if "schoolType" in have:
        out["schoolType"] = org_type("schoolType", "name", "ofstedRating")
        out["rawSchoolType"] = first_filled(*[c for c in ("rawSchoolType", "schoolType") if c in have], F.lit(""))
        out["rawSchoolType"] = F.coalesce(out["rawSchoolType"], F.lit(""))
    if "gcseSubjects" in have and dict(df.dtypes)["gcseSubjects"] == "string":
        out["gcseSubjects"] = text_list("gcseSubjects")
    if "verification_tags" in have:
        tags = F.col("verification_tags")
        if dict(df.dtypes)["verification_tags"] == "string":
            tags = F.from_json(tags, "array<string>")
        out["verification_tags"] = F.coalesce(tags, F.array().cast("array<string>"))
    out["officialDataSource"] = F.coalesce(or_null("officialDataSource"), F.lit(DEFAULT_SOURCE)) if "officialDataSource" in have else F.lit(DEFAULT_SOURCE)
    if "urn" in have:
        out["compareSchoolPerformanceUrl"] = performance_link()
    if "completeness_score" in have:
        out["completeness_score"] = F.coalesce("completeness_score", F.lit(0))
    return _set(df, out)


def dehydrate(df: DataFrame) -> DataFrame:
    """Rows as they are stored: empty texts null, ids and fees derived, defaults filled in."""
    have = set(df.columns)
    out: dict[str, Column] = {c: or_null(c) for c in TEXT_COLUMNS if c in have}
    out |= {c: lenient_int(c).cast("int") for c in NUMBER_COLUMNS if c in have}
    out |= {c: lenient_float(c) for c in PERFORMANCE_COLUMNS if c in have}
    out["region"] = F.coalesce(or_null("region"), F.lit(DEFAULT_REGION))
    own = trim_all(text("id"))
    out["id"] = F.when(own != "", own).when(filled("urn"), F.concat(F.lit("sch-gov-"), F.col("urn")))
    out["pupilCount"] = F.coalesce(lenient_int("pupilCount").cast("int"), F.lit(0))
    out["rawSchoolType"] = first_filled(*[c for c in ("rawSchoolType", "schoolType") if c in have])
    out["schoolType"] = org_type("schoolType", "name", "ofstedRating")
    stored = lenient_int("fees_termly_gbp") if "fees_termly_gbp" in have else F.lit(None).cast("bigint")
    yearly = lenient_int("fees_annual_gbp") if "fees_annual_gbp" in have else F.lit(None).cast("bigint")
    termly = F.coalesce(stored, fee_number("feesTermly"))
    out["fees_termly_gbp"] = termly.cast("int")
    out["fees_annual_gbp"] = F.coalesce(yearly, F.when(termly != 0, termly * 3)).cast("int")
    out["verification_status"] = F.coalesce(or_null("verification_status"), F.lit("unverified"))
    out["confidence_score"] = F.coalesce("confidence_score", F.lit(70))
    return _set(df, out)


def overlay(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Base rows with the non-null columns of the patch row of the same key laid over them."""
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = base.join(p, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns],
                      *[F.col(f"_new_{c}").alias(c) for c in cols if c not in base.columns])


def overlay_map(base: Column | str, patch: Column | str) -> Column:
    """Keys of both maps; the patch wins where it has a value."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(col(base), empty), F.coalesce(col(patch), empty), lambda k, a, b: F.coalesce(b, a))


def drilldown(df: DataFrame) -> DataFrame:
    """One row per linked website with its derived flags."""
    from dirwise.operators import filters as f

    site = text("website")
    return df.filter(f.has_link()).select(
        "id", "name", "website", text("postcode").alias("postcode"), text("la").alias("la"),
        F.coalesce(or_null("schoolType"), F.lit("Senior School")).alias("schoolType"),
        F.coalesce(or_null("gender"), F.lit("Mixed")).alias("gender"), site.startswith("https://").alias("isHttps"),
        f.tagged("dead_website").alias("isDead"), (filled("verified_at") | f.audited()).alias("isAudited"),
        F.col("verified_at").alias("verifiedAt"))


# The twelve milestones and every name they have been stored under, best first.
MILESTONE_ALIASES = {
    "registrationOpen": ("registrationOpen", "registrationOpens"),
    "registrationDeadline": ("registrationDeadline", "registrationCloses", "registrationCloseDate"),
    "stage_one_examDate": ("stage_one_examDate", "firstExamDate", "examDate", "firstStageExamDate"),
    "stage_one_resultDate": ("stage_one_resultDate", "firstExamResults", "firstStageResult"),
    "stage_two_examDate": ("stage_two_examDate", "secondExamDate", "secondStageExamDate"),
    "stage_two_resultDate": ("stage_two_resultDate", "secondExamResults", "secondStageResult"),
    "interviewDates": ("interviewDates", "interviewInfo", "interviewsDate", "interview"),
    "offerDate": ("offerDate", "offersDate", "offersAcceptance", "resultsDate"),
    "acceptanceDeadline": ("acceptanceDeadline", "offerAcceptByDate", "offerAcceptBy", "acceptByDate"),
    "openEvents": ("openEvents", "openDayEvening", "openDays"),
    "scholarshipsOffered": ("scholarshipsOffered", "scholarships"),
    "bursaryDeadline": ("bursaryDeadline", "scholarshipDeadline"),
}


def canonical_milestones(dates: Column | str) -> Column:
    """Map of the canonical milestones that hold something, whatever alias they came under."""
    m = col(dates)
    entries = []
    for key, aliases in MILESTONE_ALIASES.items():
        value = trim_all(first_filled(*[F.try_element_at(m, F.lit(a)) for a in aliases]))
        entries.append(F.struct(F.lit(key).alias("key"), value.alias("value")))
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "N/A", "null"))
    return F.map_from_entries(kept)


def compact(df: DataFrame, report: str, keys: list[str], lists: list[str] = []) -> DataFrame:
    """Keep only some keys of a JSON report; lists are replaced by their length."""
    r = F.col(report)
    parts = [F.get_json_object(r, f"$.{k}").alias(k) for k in keys]
    sizes = [F.coalesce(F.json_array_length(F.get_json_object(r, f"$.{k}")), F.lit(0)).alias(f"{k}Count") for k in lists]
    return df.withColumn(report, F.when(r.isNotNull(), F.to_json(F.struct(*parts, *sizes))))


def search_phrases(df: DataFrame) -> Column:
    """The five research queries of an entity."""
    place = place_of("region", "la", "address", "postcode")
    quoted = F.concat(F.lit('"'), text("name"), F.lit('"'))
    domain = site_domain()
    return F.array(
        F.trim(F.concat(quoted, F.lit(' admissions "11+" OR "Year 7" key dates 2026 2027 '), text("postcode"))),
        F.trim(F.concat(quoted, F.lit(" entrance exam format registration deadline "), place["city"])),
        F.concat(quoted, F.lit(" termly fees tuition 2025 2026 2027")),
        F.when(domain != "", F.concat(F.lit("site:"), domain, F.lit(' admissions OR "key dates" OR "entry 2026"')))
        .otherwise(F.concat(quoted, F.lit(" official prospectus admissions"))),
        F.when(filled("urn") & (F.col("urn") != "N/A"), F.concat(quoted, F.lit(" DfE GIAS URN "), F.col("urn"), F.lit(" gender age range")))
        .otherwise(F.concat(quoted, F.lit(" DfE GIAS school gender age range"))),
    )


def site_domain(website: str = "website") -> Column:
    """Host without www of a usable website, else ''."""
    w = text(website)
    host = F.regexp_extract(w, r"^(?i)(?:https?://)?(?:www\.)?([^/?#:]*)", 1)
    return F.when(w.isin("", "N/A", "null", "Unknown"), "").otherwise(F.lower(host))


def render(df: DataFrame, template: str) -> Column:
    """A text template filled in per row; its {{placeholders}} are matched in any case."""
    place = place_of("region", "la", "address", "postcode")
    site = F.when(text("website").isin("", "N/A", "null", "Unknown"), "Not available").otherwise(F.col("website"))
    phrases = F.transform(search_phrases(df), lambda p, i: F.concat(F.lit("   * Search Query "), (i + 1).cast("string"), F.lit(": "), p))
    domain = site_domain()
    values = {
        "school_name": text("name"), "city": place["city"], "county": place["county"],
        "region": F.coalesce(first_filled("region", "la"), place["county"]), "website": site,
        "website_domain": F.when(domain == "", "school-website.co.uk").otherwise(domain),
        "search_queries": F.array_join(phrases, "\n"),
        "urn": F.when(filled("urn"), F.col("urn")).otherwise("N/A"), "postcode": text("postcode"),
        "school_type": F.coalesce(or_null("schoolType"), F.lit("Independent")), "address": text("address"),
    }
    out = F.lit(template)
    for key, value in values.items():
        marked = F.regexp_replace(out, "(?i)" + r"\{\{" + key + r"\}\}", "{{" + key + "}}")
        out = F.replace(marked, F.lit("{{" + key + "}}"), value)
    return out
