"""Checking a fetched page against the entity it should belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions import dates, markup
from dirwise.functions.values import filled, round_half_up, text, trim_all

# Words that say nothing about which organisation a page belongs to, and marks of parked sites.
COMMON_WORDS = (
    "school", "for", "the", "and", "&", "high", "college", "academy", "girls", "boys", "grammar", "independent", "of", "st", "saint",
    "primary", "secondary", "cofe", "ce", "rc", "catholic", "church", "england", "senior", "junior", "infant", "infants", "nursery",
    "prep", "preparatory", "upper", "lower", "middle", "trust", "federation", "community", "free", "voluntary", "aided", "controlled",
)
PARKED = r"(?i)(domain is for sale|buy this domain|parked free|godaddy\.com|hugedomains|sedo\.com)"
PARKED_OR_LIST = r"(?i)(domain is for sale|buy this domain|parked free|godaddy\.com|hugedomains|sedo\.com|compare schools in|directory of schools)"
PARKED_TAG = "domain_mismatch"


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title, description, headings, readable text, and the contacts found in it."""
    p = pages.withColumns({
        "title": markup.page_title(html), "meta": markup.page_description(html), "headings": markup.page_headings(html), "body": markup.html_text(html)})
    return p.withColumns({"phones": markup.phones_in("body"), "emails": markup.emails_in("body"), "postcodes": markup.postcodes_in("body")})


def page_words() -> Column:
    """Lower-case title, description, headings and whole text."""
    return F.lower(F.concat_ws(" ", "title", "meta", F.array_join("headings", " "), "body"))


def key_words(c: Column | str, longer_than: int = 2) -> Column:
    """Telling words of a name; if all are common, its longer words."""
    low = F.regexp_replace(F.lower(text(c)), r"[^\w\s]", " ")
    long = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > longer_than)
    telling = F.filter(long, lambda w: ~w.isin(*COMMON_WORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(long)


def _ratio(words: Column, body: Column, empty: float) -> Column:
    hits = F.size(F.filter(words, lambda w: body.contains(w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(empty))


def identity(df: DataFrame) -> DataFrame:
    """Extracted pages joined to entities, with valid, tag and matchScore of the site's identity."""
    d = df.withColumns({"_b": page_words(), "_k": key_words("name")})
    d = d.withColumn("_r", _ratio(F.col("_k"), F.col("_b"), 1.0))
    named = F.col("_b").contains(F.lower(F.trim("name"))) | ((F.col("_r") >= 0.5) & (F.size("_k") > 0))
    parked = F.col("_b").rlike(PARKED)
    wrong = ~named & (F.size("_k") > 0)
    return d.withColumns({
        "valid": ~parked & ~wrong, "tag": F.when(parked | wrong, PARKED_TAG),
        "matchScore": F.when(parked, 0).when(wrong, round_half_up(F.col("_r") * 100)).otherwise(round_half_up(F.greatest(F.col("_r") * 100, F.lit(90.0)))),
    }).drop("_b", "_k", "_r")


def _digits(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"\D", "")


def _compact(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(text(c)), r"\s+", "")


def _phone_seen(mine: Column) -> Column:
    last = lambda x: F.right(x, F.lit(8))
    return F.exists("phones", lambda p: _digits(p).contains(mine) | mine.contains(_digits(p)) | (last(_digits(p)) == last(mine)))


def contact_mismatches(df: DataFrame) -> Column:
    """Kinds of contact the page gives, but not the stored one."""
    tel, mail, code = _digits("phone"), trim_all(F.lower(text("email"))), _compact("postcode")
    domain = F.coalesce(F.nullif(F.split_part(mail, F.lit("@"), F.lit(2)), F.lit("")), F.lit("---"))
    seen_mail = F.exists("emails", lambda e: (e == mail) | e.endswith(domain))
    seen_code = F.exists("postcodes", lambda p: _compact(p) == code)
    rules = (
        ("CONTACT_PHONE_MISMATCH", (F.size("phones") > 0) & (tel != "") & ~_phone_seen(tel)),
        ("CONTACT_EMAIL_MISMATCH", (F.size("emails") > 0) & (mail != "") & ~seen_mail),
        ("CONTACT_POSTCODE_MISMATCH", (F.size("postcodes") > 0) & (code != "") & ~seen_code),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(kind)) for kind, cond in rules]))


# What names an exam kind on a page, first match wins, and stored words that agree with it.
EXAM_MARKS = (
    ("GL Assessment", r"(gl assessment|gl 11\+|gl test|kent test|bexley 11\+|sutton set)", ("GL", "Kent", "SET", "Grammar")),
    ("ISEB Common Pre-Test", r"(iseb|independent schools examinations board|common pre-test|iseb pre-test)", ("ISEB", "Pre-Test", "Independent")),
    ("London 11+ Consortium", r"(london (?:11\+|eleven plus) consortium|consortium cognitive abilities test)", ("London", "Consortium")),
    ("CSSE 11+ Exam", r"(csse|consortium of selective schools in essex)", ("CSSE", "Essex")),
    ("CEM Assessment", r"(cem 11\+|centre for evaluation and monitoring|cem select)", ()),
    ("Non-Selective / Comprehensive (Distance & Sibling)",
     r"(non-selective|admissions criteria: distance|faith criteria|sibling criteria|pan criteria)", ("Non-Selective", "Distance", "Comprehensive", "PAN")),
)


def exam_seen(body: Column | str = "body") -> Column:
    low = F.lower(text(body))
    out = F.when(F.lit(False), "")
    for kind, mark, _ in EXAM_MARKS:
        out = out.when(low.rlike(mark), kind)
    return out


def exam_mismatch(seen: Column, stored: Column | str = "entranceExamType") -> Column:
    s = trim_all(text(stored))
    agrees = F.lit(False)
    for kind, _, words in EXAM_MARKS:
        for w in words:
            agrees = agrees | ((seen == kind) & s.contains(w))
    return F.coalesce(seen.isNotNull() & (s != "") & ~agrees, F.lit(False))


# How pages say whom they admit.
BOYS_ONLY, GIRLS_ONLY = r"\b(all-boys|boys' school|school for boys|boys only)\b", r"\b(all-girls|girls' school|school for girls|girls only)\b"
MIXED_SIXTH, BOTH = r"\bco-educational sixth form\b", r"\b(co-educational|co-ed|mixed school|for boys and girls|girls and boys)\b"


def sex_seen() -> Column:
    c = F.lower(F.concat_ws(" ", "title", "meta", "body"))
    both, sixth = c.rlike(BOTH), c.rlike(MIXED_SIXTH)
    return F.when(c.rlike(BOYS_ONLY) & ~sixth & ~both, "Boys").when(c.rlike(GIRLS_ONLY) & ~sixth & ~both, "Girls").when(both, "Mixed")


def sex_mismatch(seen: Column) -> Column:
    """A stored policy that differs while the name itself sides with the page."""
    stored, name = trim_all(text("gender")), F.lower(text("name"))
    named = ((seen == "Girls") & name.contains("girls")) | ((seen == "Boys") & name.contains("boys"))
    return F.coalesce(seen.isNotNull() & (stored != "") & (F.lower(stored) != F.lower(seen)) & named, F.lit(False))


# What makes a text an admissions text, and how each milestone is worded.
ADMISSIONS_TEXT = r"(11\+|admissions|year 7 (?:entry|admissions)|entrance examination|registration deadline|exam date|open morning|how to apply|application deadline)"
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
_DAY = r"(?:(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday),?\s*)?"
_DATE = rf"[0-9]{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTH})(?:\s+202[567])?"
_NUMERIC = r"\b[0-9]{1,2}[/\-\.][0-9]{1,2}[/\-\.]202[567]\b"
_EXAM = (r"(?:entrance (?:examination|exam|assessment|test)|11\+\s*(?:exam|test|assessment|examination)|first stage (?:test|exam|assessment)|"
         r"stage 1 (?:exam|test|assessment)|written (?:examination|papers?|assessments?)|examinations?|assessments?)")
MILESTONE_MARKS = {
    "registrationDeadline": (
        r"(?:(?:complete (?:your )?(?:online )?application(?:s)?|submit (?:your )?(?:online )?application(?:s)?|applications? (?:must be |should be )?"
        r"(?:received|submitted|completed)|apply|register) (?:by|before|no later than)|(?:registration|application) (?:deadline|closing date|closes?|due date)|"
        r"deadline for (?:registration|admissions|applications|11\+|year 7 (?:entry|admissions)?)|closing date (?:for (?:applications|registration|11\+|year 7))?|"
        r"last date for (?:registration|applications))", r"(?::|on|by|before|is)?", rf"{_DATE}|{_NUMERIC}|\b31(?:st)?\s+october(?:\s+202[567])?\b"),
    "registrationOpen": (
        r"(?:(?:registration|applications?|portal) (?:opens?|open from|available from|begins?)|accepting (?:applications|registrations) from|apply from)",
        r"(?::|on|from|is)?", rf"{_DATE}|{_NUMERIC}|\b1(?:st)?\s+september(?:\s+202[567])?\b|\b1(?:st)?\s+may(?:\s+202[567])?\b"),
    "examDate": (
        rf"(?:{_EXAM} (?:held|take place|on|takes place on|date|is|takes place)|{_EXAM}|cognitive abilities test|ISEB (?:common pre-test|test|assessment))",
        r"(?::|on|takes place|is|will be held|held on)?", rf"{_DATE}|{_NUMERIC}"),
    "resultsDate": (
        r"(?:(?:results|outcomes?|decision letters?) (?:will be |are )?(?:sent|emailed|published|issued|posted|communicated|released)|notification of outcome|admissions decisions?)",
        r"(?::|on|by|is)?", rf"{_DATE}|{_NUMERIC}|\b(?:early|mid|late\s+)?(?:october|december|january|february)\s+202[67]\b"),
    "secondExamDate": (
        r"(?:(?:stage 2|second stage|round 2|second examination|second entrance test|part 2 assessment|stage two) (?:held|take place|on|takes place on|date|is)|"
        r"second (?:stage|round) (?:exam|test|assessment))", r"(?::|on|is|held on)?", rf"{_DATE}|{_NUMERIC}"),
    "interviewInfo": (
        r"(?:interviews?(?:\s+(?:held|take place|period|scheduled|dates?))?|invited (?:for|to) (?:an )?interview|interview stage|group activity)",
        r"(?::|held|take place|on|between|is)?", rf"{_DATE}|\b(?:january|february|december)\s+202[67]\b"),
    "offersAcceptance": (
        r"(?:offers (?:posted|sent|emailed|made|released)|offer date|national offer day|acceptance deadline|accept (?:your |the )?place by|acceptances? due|offers and acceptances?)",
        r"(?::|on|by|is)?", rf"{_DATE}|\b1\s+march\s+2027\b|\bmid-feb(?:ruary)?\s+2027\b|\b(?:early|mid|late\s+)?march\s+2027\b"),
}
AUTUMN = r"(?i)september|october|november|december|sep|sept|oct|nov|dec"
SPRING = r"(?i)january|february|march|april|may|june|july|august|jan|feb|mar|apr|jun|jul|aug"


def milestone_pattern(key: str) -> str:
    lead, link, date = MILESTONE_MARKS[key]
    return rf"(?i){lead}[^\n.]{{0,60}}?{link}\s*{_DAY}({date})"


def milestones_seen(body: Column | str = "body") -> Column:
    """Map of the milestone dates a text gives, years completed by month."""
    b = text(body)
    entries = [F.struct(F.lit(key).alias("key"), trim_all(F.regexp_extract(b, milestone_pattern(key), 1)).alias("value")) for key in MILESTONE_MARKS]
    given = F.filter(F.array(*entries), lambda e: e["value"] != "")
    return F.map_from_entries(F.transform(given, lambda e: F.struct(e["key"].alias("key"), _with_year(e["value"]).alias("value"))))


def _with_year(v: Column) -> Column:
    return F.when(v.rlike(r"\b202[4567]\b"), v).when(v.rlike(AUTUMN), F.concat(v, F.lit(" 2026"))).when(v.rlike(SPRING), F.concat(v, F.lit(" 2027"))).otherwise(v)


def milestone_verdicts(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, field, dbValue, webValue, status): verified, discrepancy or enrichment per milestone a page gives.

    Pages without admissions text give one row with status ``data_missing``.
    """
    d = df.select(key, F.lower(text("body")).rlike(ADMISSIONS_TEXT).alias("_has"), "entranceExamDates", milestones_seen().alias("_w"))
    # one explode for both kinds of pages, so that each is read once
    seen = F.transform(F.map_entries("_w"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("webValue")))
    missing = F.array(F.struct(F.lit("entranceExamDates").alias("field"), F.lit(None).cast("string").alias("webValue")))
    rows = d.select(key, "entranceExamDates", "_has", F.explode(F.when(F.coalesce("_has", F.lit(False)), seen).otherwise(missing)).alias("_e")).select(key, "entranceExamDates", "_has", "_e.*")
    rows = rows.withColumn("dbValue", F.try_element_at("entranceExamDates", F.col("field")))
    has = ~trim_all(text("dbValue")).isin("", "N/A", "null")
    status = F.when(~F.col("_has"), "data_missing").when(has & dates.same_meaning("dates", "dbValue", "webValue"), "verified").when(has, "discrepancy").otherwise("enrichment")
    return rows.select(key, "field", F.when(F.col("_has"), F.when(has, F.col("dbValue")).otherwise("N/A")).alias("dbValue"), "webValue", status.alias("status"))


def verdict(df: DataFrame) -> DataFrame:
    """Status, tag and confidence of a page check from its number of anomalies."""
    clean = F.col("anomalies") == 0
    return df.withColumns({
        "verification_status": F.when(clean, "auto_verified").otherwise("has_anomalies"), "newTag": F.when(clean, "auto_verified").otherwise("inspected"),
        "confidence": F.when(clean, 95).otherwise(F.greatest(F.lit(40), 90 - 15 * F.col("anomalies")))})


def candidate_match(df: DataFrame) -> DataFrame:
    """Extracted candidate pages joined to entities, with isMatch, confidenceScore and the factors that agreed."""
    d = df.withColumns({"_b": page_words(), "_k": key_words("name"), "_a": F.filter(
        F.split(F.regexp_replace(F.lower(text("address")), r"[^\w\s]", " "), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*COMMON_WORDS))})
    b = F.col("_b")
    d = d.withColumns({"_r": _ratio(F.col("_k"), b, 0.0), "_x": b.contains(F.lower(text("name")))})
    code, out = _compact("postcode"), F.upper(F.split_part(trim_all(text("postcode")), F.lit(" "), F.lit(1)))
    place = filled("postcode") & (F.exists("postcodes", lambda p: _compact(p) == code) | b.contains(F.lower(code)) | ((out != "") & b.contains(F.lower(out))))
    district = filled("la") & b.contains(F.lower(text("la")))
    street = (F.size("_a") > 0) & (_ratio(F.col("_a"), b, 0.0) >= 0.5)
    tel = _digits("phone")
    phone = (F.length(tel) >= 7) & _phone_seen(tel)
    domain = F.lower(F.split_part(text("email"), F.lit("@"), F.lit(2)))
    mail = (domain != "") & ~domain.rlike("gmail|yahoo|hotmail") & F.exists("emails", lambda e: e.contains(domain))
    where, contact = place | district | street, phone | mail
    enough = F.col("_x") | (F.col("_r") >= 0.5)
    high = (F.col("_x") | (F.col("_r") >= 0.75)) & (where | contact)
    fair = (F.col("_x") | (F.col("_r") >= 0.6)) & where & contact
    match = ~b.rlike(PARKED_OR_LIST) & enough & (high | fair)
    factors = F.array_compact(F.array(F.when(place, F.lit("Postcode")), F.when(district, F.lit("District")), F.when(street, F.lit("Street Address match")),
                                      F.when(phone, F.lit("Phone")), F.when(mail, F.lit("Email domain"))))
    return d.withColumns({"isMatch": match, "confidenceScore": F.when(match, F.when(high, 92).otherwise(85)), "matchFactors": F.when(match, factors)}).drop("_b", "_k", "_a", "_r", "_x")


def choose_candidate(matched: DataFrame, key: str = "id", rank: str = "candidate", best: int | None = None) -> DataFrame:
    """The first candidate that matches, per entity; only the ``best`` leading ones, if given."""
    ok = matched.filter(F.col("isMatch") if best is None else F.col("isMatch") & (F.col(rank) <= best))
    return ok.groupBy(key).agg(F.min_by(F.struct(rank, "url", "confidenceScore"), rank).alias("c")).select(key, f"c.{rank}", F.col("c.url").alias("proposedWebsite"), "c.confidenceScore")


# Terms of a register page and the fields they fill.
REGISTER_TERMS = {
    "address": ("address",), "la": ("district", "local authority"), "gor": ("government office region (gor)",),
    "rawSchoolType": ("school type", "type of establishment"), "status": ("establishment status",), "admissionsPolicy": ("admissions policy",),
    "website": ("website",), "email": ("email",),
}


def register_page(html: Column | str) -> Column:
    """struct of the typed fields of a dt/dd register page."""
    low = F.transform_keys(markup.definition_list(html), lambda k, _: F.lower(k))

    def read(m: Column) -> Column:
        from dirwise.functions.names import phone_display
        from dirwise.functions.values import first_filled, lenient_int

        at = lambda *ks: first_filled(*[F.try_element_at(m, F.lit(k)) for k in ks])
        like = lambda *ws: F.get(F.map_values(F.map_filter(m, lambda k, _: k.rlike("|".join(ws)))), F.lit(0))
        sex, ages = like("gender of entry", "^gender$"), like("age range")
        span = F.regexp_extract(ages, r"(?i)(\d+)\s*(?:to|-)\s*(\d+)", 1), F.regexp_extract(ages, r"(?i)(\d+)\s*(?:to|-)\s*(\d+)", 2)
        closed = F.lower(text(at("establishment status"))).contains("closed")
        fields = {k: at(*t) for k, t in REGISTER_TERMS.items()}
        fields["la"] = trim_all(F.regexp_replace(fields["la"], r"\(\d+\)", ""))
        fields |= {
            "gender": F.when(sex.rlike("(?i)girls"), "Girls").when(sex.rlike("(?i)boys"), "Boys").when(sex.isNotNull(), "Mixed"),
            "ageRange": F.when(span[0] != "", F.concat_ws("-", *span)).otherwise(ages),
            "phone": F.when(at("telephone").isNotNull(), phone_display(at("telephone"))),
            "pupilCount": lenient_int(F.regexp_replace(at("number of pupils"), r"\D", "")), "isClosed": closed,
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    from dirwise.functions.values import bind

    return bind(low, read)
