"""Rule tables that propose values, their sources, stages and governing bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.values import contains_any, filled, lenient_int, or_null, present, spread_blank, text, trim_all
from dirwise.operators.similarity import contained_names
from dirwise.sources import seeds


def plain(c: Column | str) -> Column:
    """Lower case, everything but letters and digits a single blank."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def plain_word(w: str) -> str:
    return "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in w.lower()).strip()


def first_rule(rules: list[dict], name: Column, district: Column, selective: Column) -> Column:
    """Position of the first rule whose word the name contains, or, for a selective entity, whose district it lies in.

    Rules come from an edited file and become one expression. For rules in a
    table there is ``first_rule_table``.
    """
    out = F.when(F.lit(False), 0)
    for i, r in enumerate(rules):
        named = contains_any(name, [plain_word(k) for k in r["schoolKeywords"]])
        placed = contains_any(district, [d.lower() for d in r.get("laList") or []])
        out = out.when(named | (selective & placed), i)
    return out


def first_rule_table(df: DataFrame, words: DataFrame, name: str, key: str = "id", districts: DataFrame | None = None, district: str = "la", selective: Column | None = None) -> DataFrame:
    """(id, ordinal) of the first rule with a word inside the name or, for a selective entity, a district inside its own; for rule tables of any size.

    words: (ordinal, word); districts: (ordinal, word). Names and words meet on three-letter pieces.
    """
    if districts is not None:
        by_name = first_rule_table(df, words, name, key)
        low = df.filter(F.coalesce(selective, F.lit(False))).select(key, F.lower(text(district)).alias("_p"))
        # district names are few: each distinct one is compared with the rules' districts once
        listed = districts.groupBy(F.lower("word").alias("_w")).agg(F.min("ordinal").alias("ordinal"))
        names = low.select(F.col("_p").alias("name")).distinct()
        met = contained_names(listed.select(F.col("_w").alias("name")), names, "name").join(listed.withColumnRenamed("_w", "inner_name"), "inner_name")
        by_place = low.join(met.groupBy(F.col("outer_name").alias("_p")).agg(F.min("ordinal").alias("ordinal")), "_p").select(key, "ordinal")
        return by_name.unionByName(by_place).groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    w = words.groupBy("word").agg(F.min("ordinal").alias("ordinal"))
    names = df.select(plain(name).alias("name"))
    hit = contained_names(w.select(F.col("word").alias("name")), names, "name")
    best = hit.join(w.withColumnRenamed("word", "inner_name"), "inner_name").groupBy(F.col("outer_name").alias("_n")).agg(F.min("ordinal").alias("ordinal"))
    return df.select(key, plain(name).alias("_n")).join(best, "_n").select(key, "ordinal")


def _dates(d: dict) -> Column:
    """Milestones of a rule as a map; unset ones are left out."""
    flat = [x for k, v in d.items() if v is not None for x in (F.lit(k), F.lit(v))]
    return F.create_map(*flat)


# Milestones of the standard admission routes.
def _route(opens, closes, exam, results="1 March 2027", interview="None", offers="15 March 2027", exam2=None):
    return {"registrationOpen": opens, "registrationDeadline": closes, "examDate": exam, "secondExamDate": exam2, "resultsDate": results,
            "interviewInfo": interview, "offersAcceptance": offers}


_CAF = "CAF 31 October 2026; National Offer Day 1 March 2027; Accept by 15 March 2027"
ROUTES = {
    "standard": _route("1 September 2026", "31 October 2026", "N/A (Non-selective Admissions)"),
    "faith": _route("1 September 2026", "31 October 2026", "N/A (Faith Priority Criteria)", interview="None (Supplementary Information Form [SIF] Required)"),
    "banding": _route("1 September 2026", "31 October 2026", "14 November 2026"),
    "aptitude": _route("1 September 2026", "11 September 2026", "3 October 2026", interview="Audition / Practical Assessment (if applicable)"),
    "senior": _route("1 June 2026", "13 November 2026", "9 January 2027", "12 February 2027", "16 January 2027", "5 March 2027"),
    "prep": _route("1 June 2026", "20 November 2026", "9 January 2027", "12 February 2027", "16 January 2027", "5 March 2027"),
    "send": _route("1 September 2026", "31 October 2026", "11 January 2027", "12 February 2027", "18 January 2027", "5 March 2027"),
    "herts": _route("11 May 2026", "19 June 2026", "5 September 2026", "16 October 2026", "None", _CAF, "7 September 2026"),
    "selective": _route("1 May 2026", "3 July 2026", "12 September 2026", "16 October 2026", "None", _CAF),
}
HERTS_NAMES = ("watford grammar", "parmiter", "rickmansworth", "st clement danes", "queens")
SEND_NAMES, PREP_NAMES = ("special", "autism", "dyslexia", "centre"), ("prep", "junior", "pre-prep", "primary")
BANDING_NAMES = ("city", "harris", "ark", "oasis", "mossbourne")
APTITUDE_NAMES = ("performing arts", "music", "technology", "sports", "maths and science", "bilingual")
NO_FAITH = ("", "None", "Does not apply", "Not applicable")


def propose(df: DataFrame, state_rules: list[dict], independent_rules: list[dict]) -> DataFrame:
    """Rows (with register columns) plus proposed type, raw type, exam and milestones, and the route they follow.

    Order: local consortium, independent rules (consortium, special needs,
    preparatory, all-through, senior), state consortium, register-selective,
    then aptitude, faith, banding and plain comprehensive admission.
    """
    name, place = plain("name"), F.lower(trim_all(text("la")))
    selective = F.coalesce(F.col("ADMPOL") == "Selective", F.lit(False))
    herts = contains_any(name, HERTS_NAMES)
    independent = (text("schoolType") == "Independent") | text("MINORGROUP").contains("Independent")
    low, high = lenient_int("AGELOW"), lenient_int("AGEHIGH")
    send = contains_any(name, SEND_NAMES) | F.lower(text("SCHOOLTYPE_REG")).contains("special")
    through = F.coalesce((low <= 5) & (high >= 18), F.lit(False)) | name.contains("all-through")
    prep = F.coalesce(high <= 13, F.lit(False)) | contains_any(name, PREP_NAMES)
    faith = trim_all(text("RELCHAR"))
    d = df.withColumns({
        "_si": first_rule(state_rules, name, place, selective), "_ii": first_rule(independent_rules, name, place, F.lit(False))})
    banding = name.contains("academy") & contains_any(name, BANDING_NAMES)
    route = (
        F.when(herts, "herts")
        .when(independent, F.when(F.col("_ii").isNotNull(), "independent rule").when(send, "send").when(prep & ~through, "prep").when(through, "all-through").otherwise("senior"))
        .when(F.col("_si").isNotNull(), "state rule").when(selective, "selective")
        .when(contains_any(name, APTITUDE_NAMES), "aptitude").when(~faith.isin(*NO_FAITH), "faith").when(banding, "banding").otherwise("standard"))
    d = d.withColumn("route", route)
    r = F.col("route")
    group = F.coalesce(or_null("MINORGROUP"), F.when(filled("rawSchoolType") & ~text("rawSchoolType").contains("Comprehensive"), F.col("rawSchoolType")), F.lit("Academy Converter"))
    regional = F.coalesce(or_null("la"), F.lit("Regional"))

    def of_rule(rules, pos, field):
        out = F.when(F.lit(False), "")
        for i, rule in enumerate(rules):
            out = out.when(F.col(pos) == i, rule[field])
        return out

    def dates_of(rules, pos):
        out = F.when(F.lit(False), F.create_map().cast("map<string,string>"))
        for i, rule in enumerate(rules):
            out = out.when(F.col(pos) == i, _dates(rule["dates"]))
        return out

    academy = text("rawSchoolType").contains("Academy")
    exam = (
        F.when(r == "herts", "11+ SW Herts Consortium (GL Assessment & Music Aptitude Test)").when(r == "independent rule", of_rule(independent_rules, "_ii", "examType"))
        .when(r == "send", "11+ Specialist Assessment & EHCP Review").when(r == "prep", "11+ Senior School Transfer & Common Entrance Assessment")
        .when(r == "all-through", "11+ Senior School Entrance Examination (English & Mathematics)")
        .when(r == "senior", "11+ School Entrance Examination (English, Mathematics & Reasoning)").when(r == "state rule", of_rule(state_rules, "_si", "examType"))
        .when(r == "selective", F.concat(F.lit("11+ GL Assessment ("), regional, F.lit(" Selective)")))
        .when(r == "aptitude", "Specialist Aptitude Assessment (Aptitude test up to 10% under School Admissions Code)")
        .when(r == "faith", F.concat(F.lit("Faith-based Admissions ("), faith, F.lit(" - Supplementary Information Form [SIF] Required)")))
        .when(r == "banding", "Fair Banding Assessment (Non-selective NFER/GL Banding Test)")
        .otherwise("Non-selective (Distance & Sibling Criteria - Local Authority CAF)"))
    raw = (
        F.when(r == "herts", "Grammar (Partially Selective Academy Converter)").when(r.isin("independent rule", "senior"), "Independent Senior School (11–18)")
        .when(r == "send", "Independent Special Educational Needs (SEND) School").when(r == "prep", "Independent Preparatory & Junior School (Age 3–13)")
        .when(r == "all-through", "Independent All-Through School (3–18)")
        .when(r.isin("state rule", "selective"), F.when(academy, "Grammar (Academy Converter)").otherwise("Grammar (State Selective)"))
        .when(r == "aptitude", F.concat(group, F.lit(" (Specialist Aptitude Stream)"))).when(r == "faith", F.concat(group, F.lit(" ("), faith, F.lit(")")))
        .when(r == "banding", F.concat(group, F.lit(" (Fair Banding)"))).otherwise(group))
    kind = F.when(r.isin("herts", "state rule", "selective"), "Grammar").when(r.isin("independent rule", "send", "prep", "all-through", "senior"), "Independent").otherwise("Comprehensive")
    milestones = F.when(r == "independent rule", dates_of(independent_rules, "_ii")).when(r == "state rule", dates_of(state_rules, "_si"))
    for route_name, values in ROUTES.items():
        milestones = milestones.when(r == route_name, _dates(values))
    milestones = milestones.when(r == "all-through", _dates(ROUTES["senior"]))
    return d.withColumns({"proposedType": kind, "proposedRawType": raw, "proposedExam": exam, "proposedDates": milestones}).drop("_si", "_ii")


def _entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(F.map_filter(m, lambda _, v: v.isNotNull())))


def changed_fields() -> Column:
    """Names of the columns a proposal would change."""
    m = F.coalesce("entranceExamDates", F.create_map().cast("map<string,string>"))
    rules = {
        "schoolType": ~F.col("proposedType").eqNullSafe(F.col("schoolType")), "rawSchoolType": filled("proposedRawType") & ~F.col("proposedRawType").eqNullSafe(F.col("rawSchoolType")),
        "entranceExamType": filled("proposedExam") & ~F.col("proposedExam").eqNullSafe(F.col("entranceExamType")),
        "entranceExamDates": F.coalesce(_entries(F.col("proposedDates")) != _entries(m), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


# Public sources behind a proposal, by what its exam text names.
INDEPENDENT_SOURCES = (
    ("London 11+ Consortium", "The London 11+ Girls' Consortium Official Schedule", "https://www.london11plusconsortium.co.uk", "consortium"),
    ("ISEB", "Independent Schools Examinations Board (ISEB CPT)", "https://www.iseb.co.uk/assessments/common-pre-test/", "consortium"),
    ("GDST", "Girls' Day School Trust (GDST) Admissions", "https://www.gdst.net", "consortium"),
    ("", "Independent Schools Council (ISC) Admissions Standards", "https://www.isc.co.uk", "statutory"),
)
GRAMMAR_SOURCES = (
    ("Kent Test", "Kent County Council 11+ Secondary Transfer (PESE)", "https://www.kent.gov.uk/education-and-children/schools/school-places/kent-test", "consortium"),
    ("Sutton SET", "Sutton Selective Eligibility Test (SET) Authority", "https://www.sutton.gov.uk/w/transfer-to-secondary-school", "consortium"),
    ("CSSE", "Consortium of Selective Schools in Essex (CSSE)", "https://csse.org.uk", "consortium"),
    ("Bexley", "Bexley 11+ Selection Test Portal", "https://www.bexley.gov.uk/services/schools-and-education/secondary-schools/bexley-selection-test", "consortium"),
    ("Tiffin", "Kingston Selective Admissions (Tiffin Stage 1 & 2)", "https://www.tiffingirls.org/admissions/", "consortium"),
    ("Buckinghamshire", "The Buckinghamshire Grammar Schools (TBGS)", "https://www.thebucksgrammarschools.org", "consortium"),
    ("Birmingham", "King Edward VI Foundation Grammar Admissions", "https://www.schoolsofkingedwardvi.co.uk/admissions/", "consortium"),
    ("Trafford", "Trafford Grammar Schools Consortium Testing",
     "https://www.trafford.gov.uk/residents/schools/school-admissions/secondary-school-admissions.aspx", "consortium"),
    ("Redbridge", "London Borough of Redbridge 11+ Admissions", "https://www.redbridge.gov.uk/schools/redbridge-11-plus/", "consortium"),
    ("", "National Grammar Schools Association & Statutory Code", "https://www.gov.uk/government/publications/school-admissions-code--2", "statutory"),
)
STATE_SOURCES = (
    ("Pan-London eAdmissions & Statutory LA CAF Timetable", "https://www.eadmissions.org.uk", "statutory"),
    ("Department for Education - School Admissions Code", "https://www.gov.uk/government/publications/school-admissions-code--2", "statutory"),
)
HERTS_SOURCE = ("SW Herts Schools Consortium Official Admissions", "https://www.swhertsschools.org.uk", "consortium")


def sources() -> Column:
    """Array of (title, url, type) a proposal rests on."""
    from dirwise.operators.records import PERFORMANCE_PAGE, REGISTER_PAGE

    def src(title, url, kind) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(title).alias("title"), lit(url).alias("url"), lit(kind).alias("type"))

    def pick(table) -> Column:
        out = F.when(F.lit(False), src("", "", ""))
        for word, *s in table:
            out = out.when(text("proposedExam").contains(word), src(*s))
        return out

    keyed, site = filled("urn"), trim_all(text("website"))
    link = F.when(site.startswith("http://") | site.startswith("https://"), site).otherwise(F.concat(F.lit("https://"), site))
    own = F.col("proposedType")
    policy = (F.when(F.col("route") == "herts", src(*HERTS_SOURCE)).when(own == "Independent", pick(INDEPENDENT_SOURCES)).when(own == "Grammar", pick(GRAMMAR_SOURCES)))
    return F.array_compact(F.array(
        F.when(keyed, src(F.concat(F.lit("DfE Get Information About Schools (URN "), F.col("urn"), F.lit(")")), F.concat(F.lit(REGISTER_PAGE), F.col("urn")), "dfe")),
        F.when(keyed, src("DfE School Performance & Admissions Table", F.concat(F.lit(PERFORMANCE_PAGE), F.col("urn")), "dfe")), policy,
        *[F.when(own == "Comprehensive", src(*s)) for s in STATE_SOURCES],
        F.when(present("website") & (F.col("website") != "N/A"), src(F.concat(text("name"), F.lit(" Official Website")), link, "school"))))


def preview(df: DataFrame, register: DataFrame, state_rules: list[dict], independent_rules: list[dict]) -> DataFrame:
    """Every row a proposal would change, with current and proposed values, changed fields and sources."""
    r = register.select(F.col("URN").alias("_k"), "ADMPOL", "MINORGROUP", "RELCHAR", F.col("SCHOOLTYPE").alias("SCHOOLTYPE_REG"), "AGELOW", "AGEHIGH")
    p = propose(df.withColumn("_k", spread_blank(F.col("urn"), F.col("id"))).join(r, "_k", "left").drop("_k"), state_rules, independent_rules).withColumn("changedFields", changed_fields())
    # chosen inside the row: a filter would be moved below and repeat the whole rule expression per use
    row = F.array(F.struct(*p.columns))
    rows = p.select(F.inline(F.filter(row, lambda r: F.size(r["changedFields"]) > 0)))
    return rows.withColumn("sources", sources())


def preview_statistics(rows: DataFrame) -> DataFrame:
    has = lambda f: F.count_if(F.array_contains("changedFields", f))
    return rows.agg(F.count("*").alias("rows"), has("schoolType").alias("types"), has("entranceExamType").alias("exams"), has("entranceExamDates").alias("dates"))


def refine_blanks(df: DataFrame) -> DataFrame:
    """Rows still without an exam: the local consortium, else an historic grammar that is not selective any more."""
    blank = ~present("entranceExamType")
    herts = contains_any(plain("name"), HERTS_NAMES)
    historic = F.concat(F.coalesce(or_null("rawSchoolType"), F.lit("Academy Converter")), F.lit(" (Historic Grammar Academy - Non-selective)"))
    new = {
        "schoolType": F.when(herts, "Grammar").otherwise("Comprehensive"),
        "rawSchoolType": F.when(herts, "Grammar (Partially Selective Academy Converter)").otherwise(historic),
        "entranceExamType": F.when(herts, "11+ SW Herts Consortium (GL Assessment & Music Aptitude Test)").otherwise("Non-selective (Distance & Sibling Criteria - Local Authority CAF)"),
        "entranceExamDates": F.when(herts, _dates(ROUTES["herts"])).otherwise(_dates(ROUTES["standard"])),
    }
    hit = blank & text("schoolType").contains("Grammar")
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


# ---- consortium, body, stages ------------------------------------------------------------------


def consortium_code() -> Column:
    """Code of the exam consortium an entity belongs to, by exam, name and district."""
    name, exam, la = F.lower(text("name")), F.lower(text("entranceExamType")), F.lower(text("la"))
    grammar = text("schoolType") == "Grammar"
    sutton = contains_any(exam, ("sutton", "set")) | contains_any(name, ("wallington", "wilson's", "nonsuch")) | (name.contains("sutton grammar") & ~name.contains("coldfield"))

    def local(word: str, *exam_words: str) -> Column:
        return contains_any(exam, exam_words or (word,)) | ((la == word) & grammar)

    rules = (
        ("SUTTON_SET", sutton), ("KENT_PESE", local("kent", "kent test")), ("SLOUGH_11PLUS", local("slough")),
        ("CSSE_ESSEX", exam.contains("csse") | (exam.contains("essex") & grammar)), ("BEXLEY_TEST", local("bexley")), ("TRAFFORD_CONSORTIUM", local("trafford")),
        ("BIRMINGHAM_CONSORTIUM", local("birmingham")), ("LONDON_11PLUS_CONSORTIUM", contains_any(exam, ("london 11+", "london consortium"))),
        ("BUCKINGHAMSHIRE_STT", local("buckinghamshire")), ("MEDWAY_TEST", local("medway")), ("KINGSTON_TIFFIN", name.contains("tiffin")),
        ("BARNET_SELECTIVE", name.contains("henrietta barnett") | (name.contains("queen elizabeth's school") & la.isin("barnet", ""))),
        ("REDBRIDGE_11PLUS", contains_any(name, ("ilford county", "woodford county")) | ((la == "redbridge") & grammar)), ("WIRRAL_11PLUS", local("wirral")),
    )
    out = F.when(F.lit(False), "")
    for code, cond in rules:
        out = out.when(cond, code)
    return out


def body_code(columns: list[str]) -> Column:
    """Code of the governing body, by name, description and policy; local authority if nothing says otherwise."""
    name, desc, policy, la = (F.lower(text(c)) if c in columns else F.lit("") for c in ("name", "description", "admissionsPolicy", "la"))
    kevi = contains_any(desc, ("birmingham",)) | contains_any(name, ("birmingham", "aston", "camp hill", "five ways", "handsworth"))
    rules = (
        ("HARRIS_FEDERATION", name.contains("harris ") | desc.contains("harris federation")),
        ("ARK_SCHOOLS", name.startswith("ark ") | name.contains(" ark ") | desc.contains("ark schools")),
        ("OASIS_COMMUNITY_LEARNING", name.contains("oasis academy") | desc.contains("oasis community learning")),
        ("FOLIO_EDUCATION_TRUST", name.contains("wallington county grammar") | desc.contains("folio education trust")),
        ("KEVI_FOUNDATION", name.contains("king edward vi") & kevi), ("GDST", contains_any(desc, ("girls' day school trust", "gdst")) | name.contains("gdst")),
        ("HABERDASHERS_TRUST", name.contains("haberdashers") | desc.contains("haberdashers")), ("UNITED_LEARNING", desc.contains("united learning") | name.contains("united learning")),
        ("GLF_SCHOOLS", desc.contains("glf schools")), ("LEIGH_ACADEMIES_TRUST", desc.contains("leigh academies trust")), ("OUTWOOD_GRANGE_ACADEMIES", desc.contains("outwood grange")),
        ("TIFFIN_ACADEMY_TRUST", name.contains("tiffin girls")), ("WILSONS_ACADEMY_TRUST", name.contains("wilson's school")),
        ("QE_BARNET_TRUST", name.contains("queen elizabeth's school") & la.isin("barnet", "")),
        ("DIOCESE_OF_WESTMINSTER", policy.contains("roman catholic") | name.contains("rc ") | desc.contains("westminster")),
        ("LDBS_LONDON", policy.contains("church of england") | name.contains("c of e") | desc.contains("ldbs")),
    )
    out = F.when(F.lit(False), "")
    for code, cond in rules:
        out = out.when(cond, code)
    return out.otherwise("LOCAL_AUTHORITY_MAINTAINED")


# Exam types by consortium, and by phrases in the exam text, first match wins.
CONSORTIUM_EXAM = {"SUTTON_SET": "SUTTON_SET", "CSSE_ESSEX": "CSSE", "LONDON_11PLUS_CONSORTIUM": "LONDON_CONSORTIUM"}
EXAM_PHRASES = (
    ("GL_ASSESSMENT", ("gl assessment", "kent test", "bexley")), ("CEM", ("cem",)), ("ISEB_CPT", ()), ("ISEB_CE", ("iseb", "common entrance")),
    ("LONDON_CONSORTIUM", ("london 11+",)), ("SUTTON_SET", ("sutton set", "selective eligibility")), ("CSSE", ("csse",)),
    ("SCHOOL_OWN", ("school's own", "school own", "internal")), ("FAIR_BANDING", ("banding", "nfer")), ("SPECIALIST_APTITUDE", ("aptitude",)),
    ("AUDITION", ("audition",)), ("FAITH_SIF", ("faith", "sif")), ("SEN_EHCP", ("ehcp", "sen", "specialist placement", "special education")),
)


def exam_code(consortium: Column) -> Column:
    exam, kind = F.lower(text("entranceExamType")), F.lower(text("schoolType"))
    out = F.when(F.lit(False), "")
    for code, e in CONSORTIUM_EXAM.items():
        out = out.when(consortium == code, e)
    out = out.when(consortium.isNotNull(), "GL_ASSESSMENT")
    for e, phrases in EXAM_PHRASES:
        out = out.when(exam.contains("iseb") & exam.contains("pre-test") if e == "ISEB_CPT" else contains_any(exam, phrases), e)
    return out.when(kind == "grammar", "GL_ASSESSMENT").when(kind == "independent", "SCHOOL_OWN").otherwise("NON_SELECTIVE")


def classify(df: DataFrame) -> DataFrame:
    """Rows with consortium, governing body, primary exam and whether there is a second stage."""
    d = df.withColumns({"consortiumCode": consortium_code(), "bodyCode": body_code(df.columns)})
    d = d.withColumn("examCode", exam_code(F.col("consortiumCode")))
    exam, two = F.lower(text("entranceExamType")), text("stage_two_format_and_subjects")
    second = (
        (text("second_stage_exam_required") == "Yes") | contains_any(exam, ("two-stage", "stage 2")) | ((two != "") & (two != "N/A"))
        | text("consortiumCode").isin("SUTTON_SET", "KINGSTON_TIFFIN"))
    return d.withColumn("second_stage_exam_required", F.when(second, "Yes").otherwise("No"))


# Subjects and the phrases that name them, and each route's first-stage form.
SUBJECTS = (
    ("Mathematics", ("math", "numerical")), ("English", ("english", "comprehension")), ("Creative Writing", ("creative writing", "extended writing", "essay")),
    ("Verbal Reasoning", ("verbal reasoning", " vr ", "verbal ability")), ("Non-Verbal Reasoning", ("non-verbal", " nvr ", "spatial")), ("Science", ("science",)),
    ("Music Aptitude", ("music",)), ("Sport Aptitude", ("sport",)), ("Audition", ("audition",)), ("Interview", ("interview",)),
)
_FOUR = ("English", "Mathematics", "Verbal Reasoning", "Non-Verbal Reasoning")
STAGE_ONE = (
    ("consortiumCode", "SUTTON_SET", "Multiple Choice", ("Mathematics", "English")), ("consortiumCode", "KENT_PESE", "Multiple Choice", _FOUR),
    ("examCode", "ISEB_CPT", "Online Adaptive", _FOUR),
    ("examCode", "LONDON_CONSORTIUM", "Online Adaptive", ("Verbal Reasoning", "Non-Verbal Reasoning", "Mathematics", "English")),
    ("examCode", "NON_SELECTIVE", "Distance & Sibling Allocation", ("Non-academic Criteria",)),
    ("examCode", "FAITH_SIF", "Supplementary Information Form (SIF)", ("Faith Practice Criteria",)),
    ("examCode", "SPECIALIST_APTITUDE", "Aptitude Assessment", ("Music Aptitude", "Sport Aptitude")),
)


def subjects(c: Column | str, fallback: Column) -> Column:
    """Subjects a format text names; the fallback where it names none."""
    low = F.lower(text(c))
    found = F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(s)) for s, words in SUBJECTS]))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def stages(classified: DataFrame) -> DataFrame:
    """One row per entity and exam stage, from classified rows."""
    two = F.col("second_stage_exam_required") == "Yes"
    form, basics = F.when(F.lit(False), ""), F.when(F.lit(False), _strings([""]))
    for c, code, f, s in STAGE_ONE:
        form, basics = form.when(text(c) == code, f), basics.when(text(c) == code, _strings(s))
    form, basics = form.otherwise("Standard Written"), basics.otherwise(_strings(("Mathematics", "English")))
    label = F.when(F.lit(False), "")
    for c in seeds.CONSORTIA:
        label = label.when(F.col("consortiumCode") == c[0], f"{c[1]} (Stage 1)")
    name, sutton = F.lower(text("name")), text("consortiumCode") == "SUTTON_SET"
    tiffin, barnett = name.contains("tiffin"), name.contains("henrietta barnett")
    second_name = (F.when(sutton, "Sutton Selective Schools Second Stage Examination").when(tiffin, "Tiffin Stage 2 Written Test")
                   .when(barnett, "Henrietta Barnett Second Stage").otherwise("Stage 2 Examination"))
    second_basics = (F.when(sutton | tiffin, _strings(("Mathematics", "English"))).when(barnett, _strings(("English", "Mathematics", "Creative Writing")))
                     .otherwise(_strings(("Mathematics", "English", "Creative Writing"))))

    def stage(number, title, exam, form, subs, sifting, notes) -> Column:
        return F.struct(F.lit(number).alias("stage_number"), title.alias("stage_name"), exam.alias("exam_type"), form.alias("paper_format"),
                        subs.alias("subjects"), sifting.alias("is_sifting"), notes.alias("qualifying_notes"))

    first = stage(1, F.coalesce(label, F.when(two, "Stage 1 Entrance Examination").otherwise("Entrance Assessment")), F.col("examCode"), form,
                  subjects("stage_one_format_and_subjects", basics), two, F.when(two, "Qualifying cutoff score required to proceed to Stage 2"))
    last = stage(2, second_name, F.lit("SCHOOL_OWN"), F.lit("Standard Written Papers"), subjects("stage_two_format_and_subjects", second_basics),
                 F.lit(False), F.lit("Final ranking based on Stage 2 performance"))
    rows = F.array_compact(F.array(first, F.when(two, last)))
    return classified.select(F.col("id").alias("school_id"), F.col("consortiumCode").alias("consortium"), F.explode(rows).alias("s")).select("school_id", "consortium", "s.*")
