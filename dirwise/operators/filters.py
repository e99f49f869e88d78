"""Named conditions over a directory, as columns to filter by."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.names import LONDON_DISTRICTS
from dirwise.functions.values import any_of, contains_any, filled, present, text, trim_all, up_to

SEARCH_FIELDS = (
    "name", "postcode", "la", "address", "urn", "region", "entranceExamType", "admissionsPolicy", "description", "website",
    "stage_one_format_and_subjects", "stage_two_format_and_subjects",
)
TAGS = "verification_tags"


def has_text(q: str, columns: list[str], tags: str | None = TAGS) -> Column:
    """Any search field, or the tags joined by blanks, contains the text; case ignored."""
    needle = q.lower().strip()
    hits = [F.lower(text(c)).contains(needle) for c in SEARCH_FIELDS if c in columns]
    if tags in columns:
        hits.append(F.coalesce(F.lower(F.array_join(tags, " ")).contains(needle), F.lit(False)))
    return any_of(hits)


def part_of(c: str, value: str) -> Column:
    return F.lower(text(c)).contains(value.lower()) & filled(c)


def equals(c: str, value: str) -> Column:
    return (F.lower(text(c)) == value.lower()) & filled(c)


def tagged(*tags: str) -> Column:
    low = F.transform(F.coalesce(F.col(TAGS), F.array().cast("array<string>")), F.lower)
    return F.arrays_overlap(low, F.array(*[F.lit(t) for t in tags]))


def _status(*values: str) -> Column:
    return text("verification_status").isin(*values)


# Tags and statuses behind the named tag families.
ENRICHED_TAGS = ("llm_enriched", "llm_verified", "gemini_crawl", "chatgpt_crawl")
VERIFIED_TAGS = ("auto_verified", "web_verified")
CURRENT_TAGS = ("dates_verified", "dates_current", "p0_cycle_current")
PROBLEM_TAGS = ("date_inversion", "historical_date_stale", "missing_website", "dead_website", "contact_mismatch",
                "domain_mismatch", "auto_verification_data_missing")
PROBLEM_STATUSES = ("has_anomalies", "crawl_stuck", "data_missing", "dead_website", "missing_website", "llm_error")


def is_enriched() -> Column:
    return tagged(*ENRICHED_TAGS) | _status("llm_enriched")


def is_verified() -> Column:
    return tagged(*VERIFIED_TAGS) | _status("auto_verified", "verified") | filled("verified_at")


def two_stage() -> Column:
    return text("entranceExamType").contains("Two-Stage") | text("entranceExamType").contains("Stage 2")


def by_tag(tag: str) -> Column:
    """A named tag family, else plain membership."""
    t = tag.lower().strip()
    families = {
        "llm_enriched": is_enriched,
        "auto_verified": is_verified, "web_verified": is_verified,
        "dates_verified": lambda: tagged(*CURRENT_TAGS),
        "dates_recorded": lambda: F.coalesce(F.size("entranceExamDates") > 0, F.lit(False)),
        "two_stage_exam": lambda: (text("second_stage_exam_required") == "Yes") | two_stage() | tagged("two_stage_exam"),
        "fees_recorded": lambda: filled("feesTermly") | filled("registrationFee"),
        "has_website": lambda: present("website") & (F.col("website") != "N/A"),
        "has_anomalies": lambda: _status(*PROBLEM_STATUSES) | tagged(*PROBLEM_TAGS),
        "unscanned": lambda: ~is_enriched() & ~is_verified(),
    }
    other_names = {"dates": "dates_recorded", "two_stage": "two_stage_exam", "fees": "fees_recorded", "website": "has_website",
                   "anomalies": "has_anomalies"}
    family = families.get(other_names.get(t, t))
    return family() if family else tagged(t)


def second_stage(answer: str) -> Column:
    flag, exam = text("second_stage_exam_required"), text("entranceExamType")
    if answer.lower().strip() == "yes":
        return (flag == "Yes") | two_stage() | exam.contains("SET")
    if answer.lower().strip() == "no":
        return (flag == "No") | ((flag == "") & ~exam.contains("Two-Stage"))
    return F.lit(True)


def confidence_band(band: str) -> Column:
    c = F.coalesce("confidence_score", F.lit(0))
    bands = {"high": c >= 80, "verified": c >= 80, "medium": (c >= 50) & (c < 80), "low": c < 50, "unverified": c < 50}
    return bands.get(band.lower().strip(), F.lit(True))


def fee_class(kind: str) -> Column:
    kinds = {"state": "state", "free": "state", "independent": "paid", "paying": "paid", "recorded": "recorded"}
    match kinds.get(kind.lower().strip()):
        case "state":
            return text("schoolType").isin("Comprehensive", "Grammar", "State")
        case "paid":
            return text("schoolType").contains("Independent")
        case "recorded":
            return filled("feesTermly") | filled("registrationFee")
    return F.lit(True)


def facets(
    columns: list[str], *, search=None, hot=False, official=False, type=None, gender=None, rating=None, exam=None, consortium=None,
    body=None, la=None, region=None, tag=None, stage=None, confidence=None, fee=None, min_pupils=None, max_pupils=None,
) -> Column:
    """All given facets at once; Spark combines them into one scan filter."""
    conds = []
    if search:
        conds.append(has_text(search, columns))
    if hot:
        conds.append(F.col("hot"))
    if official:
        conds.append(F.col("official"))
    for c, v in (("schoolType", type), ("gender", gender), ("entranceExamType", exam), ("exam_consortium", consortium), ("governing_body", body)):
        if v:
            conds.append(part_of(c, v))
    for c, v in (("ofstedRating", rating), ("la", la), ("region", region)):
        if v:
            conds.append(equals(c, v))
    conds += [by_tag(tag)] if tag else []
    conds += [second_stage(stage)] if stage else []
    conds += [confidence_band(confidence)] if confidence else []
    conds += [fee_class(fee)] if fee else []
    conds += [F.col("pupilCount") >= min_pupils] if min_pupils is not None else []
    conds += [F.col("pupilCount") <= max_pupils] if max_pupils is not None else []
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


# ---- work queue --------------------------------------------------------------------------------

# The queue's own list of capital districts has no City of London.
QUEUE_DISTRICTS = tuple(d for d in LONDON_DISTRICTS if d not in ("Barking and Dagenham", "City of London"))


def _tag_like(*words: str) -> Column:
    """Some tag contains one of the words."""
    return F.coalesce(F.exists(TAGS, lambda t: contains_any(F.lower(t), words)), F.lit(False))


def never_verified() -> Column:
    return ~present("verified_at")


def category(name: str) -> Column:
    """One of the named priority categories of the work queue; any other name selects all."""
    london = (F.col("region") == "Greater London") | text("la").isin(*QUEUE_DISTRICTS)
    london = F.coalesce(london, F.lit(False))
    independent = text("schoolType") == "Independent"
    table = {
        ("GREATER_LONDON", "GREATER_LONDON_REGION", "LONDON"): london,
        ("LONDON_INDEPENDENT",): independent & london,
        ("ALL_INDEPENDENT",): independent,
        ("GRAMMAR",): text("schoolType") == "Grammar",
        ("STATE_COMPREHENSIVE",): text("schoolType") == "Comprehensive",
        ("UNVERIFIED", "UNVERIFIED_QUEUE"): never_verified() | F.col("verification_status").isNull() | _status("unverified", "unscanned"),
        ("CRITICAL", "CRITICAL_INVERSIONS"): _status("has_anomalies") | _tag_like("date_inversion", "historical_date_stale"),
        ("SMART", "SMART_UPDATES"): _tag_like("historical_date_stale", "date_mismatch"),
        ("MISSING_INFO", "MISSING_WEBSITES"): ~present("website") | (F.col("website") == "N/A") | _tag_like(
            "missing_website", "dead_website", "auto_verification_data_missing"),
    }
    for names, cond in table.items():
        if name.upper() in names:
            return cond
    return F.lit(True)


SKIP_DAYS = 10


def due(as_of: dt.datetime, skip_days: int | None = SKIP_DAYS, force: bool = False) -> Column:
    """Not enriched yet and not verified within the last ``skip_days`` (0 is off).

    With ``force`` enriched rows stay, and only a window given explicitly counts.
    """
    days = skip_days if skip_days is not None else (0 if force else SKIP_DAYS)
    if days < 0:
        raise ValueError("a window of days cannot be negative")
    cutoff = (as_of - dt.timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    old = never_verified() | (F.col("verified_at") < cutoff) if days else F.lit(True)
    if force:
        return old
    fresh = F.col("verification_status").isNull() | (F.col("verification_status") != "llm_enriched")
    return fresh & ~_tag_like("llm_enriched", "llm_verified") & old


def queue_order() -> list[Column]:
    """Never seen first, then not enriched, then by problem, oldest first."""
    rank = (
        F.when(never_verified() & (F.col("verification_status").isNull() | _status("unverified", "unscanned")), 0)
        .when(~_tag_like(*ENRICHED_TAGS), 1)
        .when(never_verified(), 2)
        .when(_status("has_anomalies"), 3)
        .otherwise(4)
    )
    return [rank.asc(), F.col("verified_at").asc_nulls_first(), F.col("id").asc()]


def work_queue(df: DataFrame, name: str, as_of: dt.datetime, limit: int | None = 50, skip_days: int | None = SKIP_DAYS, force=False) -> DataFrame:
    return up_to(df.filter(category(name) & due(as_of, skip_days, force)).orderBy(*queue_order()), limit)


# ---- preferences -------------------------------------------------------------------------------


def sex_class(c: Column | str = "gender") -> Column:
    """boys, girls, mixed or '' as a preference filter sees it."""
    g = F.lower(trim_all(text(c)))
    boy, girl = g.contains("boy"), g.contains("girl")
    mixed = contains_any(g, ("mixed", "co-ed", "coeducational"))
    return F.struct((boy & ~girl).alias("boys"), (girl & ~boy).alias("girls"), mixed.alias("mixed"))


def accepts_sexes(wanted, c: Column | str = "gender") -> Column:
    """Whether a row fits the chosen set of boys, girls and mixed; no choice or all three fit all."""
    chosen = {"mixed" if w == "co-ed" else w for w in wanted} & {"boys", "girls", "mixed"}
    if not wanted or "NA" in wanted or "all" in wanted or len(chosen) in (0, 3):
        return F.lit(True)
    cls = sex_class(c)
    return any_of([cls[w] for w in sorted(chosen)])


def accepts_types(wanted, c: Column | str = "schoolType") -> Column:
    if not wanted or "NA" in wanted or "all" in wanted:
        return F.lit(True)
    t = F.lower(text(c))
    words = {"comprehensive": ("comprehensive", "academy", "community")}
    return any_of([contains_any(t, words.get(w.lower().strip(), (w.lower().strip(),))) for w in wanted])


def rating_floor(floor: str | None, c: Column | str = "ofstedRating") -> Column:
    r = F.lower(text(c))
    words = {"outstanding": ("outstanding", "excellent"), "good": ("outstanding", "excellent", "good")}
    chosen = words.get((floor or "").lower().strip())
    return contains_any(r, chosen) if chosen else F.lit(True)


# ---- test data ---------------------------------------------------------------------------------


def without_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def has_link() -> Column:
    return trim_all(text("website")).startswith("http")


def audited() -> Column:
    return tagged("web_health_audited", "auto_verified")


def website_state(name: str) -> Column:
    """registered, unscanned, https, http, healthy or dead."""
    site, dead = trim_all(text("website")), tagged("dead_website")
    states = {
        "registered": F.lit(True),
        "unscanned": ~filled("verified_at") & ~audited(),
        "https": site.startswith("https://"),
        "http": site.startswith("http://"),
        "healthy": ~dead,
        "dead": dead,
    }
    return has_link() & states[name]


def health_queue(df: DataFrame, limit: int | None = 50) -> DataFrame:
    """Linked websites to check next: never tested first, then the longest untested."""
    return up_to(df.filter(has_link()).orderBy((~website_state("unscanned")).cast("int"), F.col("verified_at").asc_nulls_first(), "id"), limit)


# Marks of test data, names that only look like it, and ids and keys test runs leave behind.
TEST_WORDS = r"(?i)\btest\b|\btests\b|testschool|test\.sch\.uk|proposal-rejection-test"
NOT_TEST = ("testbourne", "testwood", "ingatestone", "countesthorpe", "whitestitch", "selection-tests", "kent-test")
TEST_IDS = r"(?i)^(sch_reject_test_|primary_178|temp_test_school_|test_enrichment_diff_school|test_qcl_llm)"
PLACEHOLDER_KEYS = ("N/A", "100100", "999888", "999999", "999111222", "123456", "000000", "111111")


def is_test_text(c: Column | str) -> Column:
    s = F.lower(trim_all(text(c)))
    return s.rlike(TEST_WORDS) & ~contains_any(s, NOT_TEST)


def is_test_id(c: Column | str = "id") -> Column:
    return text(c).rlike(TEST_IDS)


def is_placeholder_key(c: Column | str = "urn") -> Column:
    return trim_all(text(c)).isin(*PLACEHOLDER_KEYS)
