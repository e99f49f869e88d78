"""Free-text dates: timeline dates, admissions dates, stale cycles, roll-forward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirwise.functions.names import exam_kind, gender, phone, postcode
from dirwise.functions.values import any_of, bind, col, contains_any, is_na, text, trim_all

# Month names as they occur in free text.
MONTH_WORDS = (
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"),
    ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"),
    ("dec", "december"),
)
SEASON_MONTHS = (("autumn", 10), ("spring", 2), ("summer", 6))
RELATIVE_STARTS = (
    "open year-round", "rolling", "bespoke", "after assessment", "after exam", "following", "same day", "same date",
    "concurrent", "with interview", "with exam",
)
DEFAULT_DAY, DEFAULT_MONTH = 15, 6
FULL_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """Calendar date where day 31 of a short month runs on into the next one."""
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, (day - 1).cast("int"))


def timeline_date(c: Column | str) -> Column:
    """struct(year, month, day, date) of a milestone text; null if it names none."""
    return bind(trim_all(c), _timeline)


def _timeline(s: Column) -> Column:
    low = F.lower(s)
    relative = any_of([low.startswith(w) for w in RELATIVE_STARTS]) | low.contains("non-selective")
    main = trim_all(F.regexp_replace(s, r"(?i)—\s*for\s+Sept\w*\s+202\d\s+entry", ""))
    return F.when(~is_na(s) & ~relative, bind(main, lambda m: bind(_date_parts(m), _date_of_parts)))


def _date_parts(main: Column) -> Column:
    """Everything the text says: a numeric date, a year, a month, a day."""
    low = F.lower(main)
    numeric = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](202\d)\b"
    nd, nm, ny = [F.regexp_extract(main, numeric, i).try_cast("int") for i in (1, 2, 3)]
    month = F.when(F.lit(False), F.lit(0))
    for number, words in enumerate(MONTH_WORDS, start=1):
        month = month.when(low.rlike(rf"\b({'|'.join(words)})\b"), number)
    for word, number in SEASON_MONTHS:
        month = month.when(low.contains(word), number)
    return F.struct(
        nd.alias("nd"), nm.alias("nm"), ny.alias("ny"), month.alias("month"),
        F.regexp_extract(main, r"\b(202\d)\b", 1).try_cast("int").alias("year"),
        F.regexp_extract(main, r"\b(\d{1,2})(?:st|nd|rd|th)?\b", 1).try_cast("int").alias("day"),
    )


def _date_of_parts(p: Column) -> Column:
    numeric = F.coalesce(p["nm"].between(1, 12) & p["nd"].between(1, 31), F.lit(False))
    y = F.when(numeric, p["ny"]).otherwise(F.coalesce(p["year"], F.when(p["month"] <= 4, 2027).otherwise(2026)))
    m = F.when(numeric, p["nm"]).otherwise(F.coalesce(p["month"], F.lit(DEFAULT_MONTH)))
    d = F.when(numeric, p["nd"]).otherwise(F.when(p["day"].between(1, 31), p["day"]).otherwise(DEFAULT_DAY))
    return F.struct(y.alias("year"), m.alias("month"), d.alias("day"), rolled_date(y, m, d).alias("date"))


LONG_DATE = rf"(?i)\b(\d{{1,2}})\s+({FULL_MONTHS})\s+(\d{{4}})\b"
MONTH_DATE = rf"(?i)\b({FULL_MONTHS})\s+(\d{{4}})\b"
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"


def admissions_date(c: Column | str) -> Column:
    """Date of 'D Month YYYY', 'Month YYYY' or ISO text; the first form found decides."""
    return bind(trim_all(c), _admissions)


def _admissions(s: Column) -> Column:
    names = F.array(*[F.lit(n.lower()) for n in FULL_MONTHS.split("|")])

    def whole(form: str, i: int) -> Column:
        return F.regexp_extract(s, form, i).try_cast("int")

    def month(form: str, i: int) -> Column:
        return F.array_position(names, F.lower(F.regexp_extract(s, form, i))).cast("int")

    def ymd(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    parts = (
        F.when(F.lower(s).isin("", "null", "tbd", "autumn term"), F.lit(None))
        .when(s.rlike(LONG_DATE), ymd(whole(LONG_DATE, 3), month(LONG_DATE, 2), whole(LONG_DATE, 1)))
        .when(s.rlike(MONTH_DATE), ymd(whole(MONTH_DATE, 2), month(MONTH_DATE, 1), F.lit(1)))
        .when(s.rlike(ISO_DATE), ymd(whole(ISO_DATE, 1), whole(ISO_DATE, 2), whole(ISO_DATE, 3)))
    )
    return bind(parts, lambda p: F.when(
        p["m"].between(1, 12) & p["d"].between(1, 31), rolled_date(p["y"], F.when(p["m"].between(1, 12), p["m"]), p["d"])))


STALE_YEARS = (2022, 2023, 2024, 2025)


def is_stale(c: Column | str, years=STALE_YEARS) -> Column:
    """The text names a past cycle year."""
    return text(c).rlike(rf"\b({'|'.join(str(y) for y in years)})\b")


# Rewrites of last cycle's dates, applied in this order.
_LATE = "July|August|September|October|November|December|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
_EARLY = "January|February|March|April|Jan|Feb|Mar|Apr"
ROLL_FORWARD = (
    ("Jul-Dec 2025 -> 2026",
     rf"(?i)\b({_LATE}|Autumn)(\b[^\d]*\b|\s*[/\-&,]\s*(?:{_LATE}|Autumn)?\s*)2025\b", "$1$2", "2026"),
    ("Day Month 2025 -> 2026", rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_LATE})\w*)\s+2025\b", "$1 ", "2026"),
    ("Month/Month 2025 -> 2026",
     r"(?i)\b(November/December|Nov/Dec|Oct/Nov|September/October|Sep/Oct)\s+2025\b", "$1 ", "2026"),
    ("Jan-Apr 2026 -> 2027",
     rf"(?i)\b({_EARLY})(\b[^\d]*\b|\s*[/\-&,]\s*(?:{_EARLY})?\s*)2026\b", "$1$2", "2027"),
    ("Day Month 2026 -> 2027", rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_EARLY})\w*)\s+2026\b", "$1 ", "2027"),
    ("Month/Month 2026 -> 2027",
     r"(?i)\b(January/February|Jan/Feb|Feb/Mar|February/March|March/April|Mar/Apr)\s+2026\b", "$1 ", "2027"),
)


def roll_forward(c: Column | str) -> Column:
    """struct(value, reasons): the text moved to the next cycle, one reason per rewrite."""
    state = F.struct(col(c).alias("value"), F.array().cast("array<string>").alias("reasons"))
    for label, pattern, keep, year in ROLL_FORWARD:
        state = bind(state, _rewrite(label, pattern, keep + year))
    return state


def _rewrite(label: str, pattern: str, replacement: str):
    def step(s: Column) -> Column:
        hits = F.coalesce(F.regexp_count(s["value"], F.lit(pattern)), F.lit(0))
        return F.struct(
            F.regexp_replace(s["value"], pattern, replacement).alias("value"),
            F.concat(s["reasons"], F.array_repeat(F.lit(label), hits)).alias("reasons"),
        )

    return step


# Fields compared as dates.
DATE_FIELDS = ("registrationOpen", "registrationDeadline", "examDate", "secondExamDate", "resultsDate", "interviewInfo",
               "offersAcceptance")


def same_meaning(field: str, a: Column | str, b: Column | str) -> Column:
    """Whether two values of a field say the same thing."""
    both = F.struct(trim_all(text(a)).alias("x"), trim_all(text(b)).alias("y"))
    empty_a, empty_b = text(a) == "", text(b) == ""
    return F.when(empty_a | empty_b, empty_a & empty_b).otherwise(bind(both, lambda p: _same(field, p["x"], p["y"])))


def _same(field: str, x: Column, y: Column) -> Column:
    same = F.lower(x) == F.lower(y)
    if field == "phone":
        return same | bind(
            F.struct(phone(x).alias("p"), phone(y).alias("q")),
            lambda n: (n["p"] != "") & (n["q"] != "") & ((n["p"] == n["q"]) | (F.right(n["p"], F.lit(8)) == F.right(n["q"], F.lit(8)))),
        )
    if field == "postcode":
        return same | (postcode(x, "split") == postcode(y, "split"))
    if field == "gender":
        return same | (gender(x) == gender(y))
    if field == "entranceExamType":
        return same | (exam_kind(x) == exam_kind(y))
    if "date" in field.lower() or field in DATE_FIELDS:
        bare = F.regexp_replace(F.lower(x), r"[^\w]", "") == F.regexp_replace(F.lower(y), r"[^\w]", "")
        day = bind(
            F.struct(timeline_date(x).alias("p"), timeline_date(y).alias("q")),
            lambda n: F.coalesce(n["p"]["date"].isNotNull() & (n["p"] == n["q"]), F.lit(False)),
        )
        return same | bare | day
    return same


def many_dates(c: Column | str) -> Column:
    """Text with several dates as an array: split on line breaks, or on ';' if it holds digits."""
    s = trim_all(c)
    pieces = F.filter(F.transform(F.split(s, r"[\n;]+"), trim_all), lambda p: p != "")
    several = s.contains("\n") | (s.contains(";") & s.rlike(r"\d"))
    return F.when(
        ~s.isin("", "N/A", "null"), F.when(several & (F.size(pieces) > 0), pieces).otherwise(F.array(s))
    )


def one_date(c: Column | str) -> Column:
    s = trim_all(c)
    return F.when(~s.isin("", "N/A", "null"), s)


def first_date(c: Column | str) -> Column:
    """First usable element of an array of dates."""
    clean = F.transform(col(c), trim_all)
    return F.get(F.filter(clean, lambda x: ~x.isin("", "N/A", "null")), F.lit(0))


def mentions_any(c: Column | str, words) -> Column:
    return contains_any(F.lower(text(c)), words)
