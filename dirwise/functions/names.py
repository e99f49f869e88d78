"""Names, postcodes, phones, genders, types, exam kinds and links as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirwise.functions.values import col, contains_any, text, trim_all

# Words left out of a name before it is compared, per use.
NAME_WORDS = {
    "canonical": ("limited", "ltd", "trust", "academy trust", "mat", "federation", "high school", "grammar school",
                  "school", "academy", "college"),
    "dedup": ("the", "school", "academy", "college", "high", "grammar", "community", "secondary", "for", "of", "in", "gdst"),
    "ranking": ("the", "school", "college", "grammar", "high", "girls", "boys", "academy", "gdst", "independent",
                "secondary", "preparatory", "prep"),
    "register": ("the", "school", "academy", "college", "high", "grammar", "community", "secondary", "boys", "girls",
                 "mixed", "for"),
}


def name_key(c: Column | str, variant: str = "canonical") -> Column:
    """Name without stop words; each use of it has its own word list and shape."""
    low = F.lower(text(c))
    words = "|".join(NAME_WORDS.get(variant, ()))
    if variant == "canonical":
        s = F.regexp_replace(low, r"^the\s+", "")
        return F.regexp_replace(F.regexp_replace(s, rf"\b({words})\b", ""), "[^a-z0-9]", "")
    if variant == "alphanumeric":
        return F.regexp_replace(low, "[^a-z0-9]", "")
    s = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]", " "), rf"\b({words})\b", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def postcode(c: Column | str, variant: str = "unit") -> Column:
    """Postcode in one of four shapes.

    unit: 'EN5 4DQ', short codes stay an outcode. split: as unit from four
    characters on. strict: only five to eight characters are rewritten, others
    come back trimmed. compact: upper case without blanks.
    """
    if variant == "compact":
        return F.regexp_replace(F.upper(text(c)), r"\s+", "")
    if variant == "strict":
        clean = F.regexp_replace(F.upper(trim_all(c)), r"\s+", "")
        n = F.length(clean)
        return F.when(col(c) == "", F.lit(None)).when((n < 5) | (n > 8), trim_all(c)).otherwise(_split(clean))
    clean = F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", "")
    least = {"unit": 4, "split": 3}[variant]
    return F.when(F.length(clean) <= least, clean).otherwise(_split(clean))


def _split(clean: Column) -> Column:
    n = F.length(clean)
    return F.concat(F.substring(clean, F.lit(1), n - 3), F.lit(" "), F.substring(clean, n - 2, F.lit(3)))


def outcode(c: Column | str) -> Column:
    return F.split_part(postcode(c), F.lit(" "), F.lit(1))


def is_postcode(c: Column | str) -> Column:
    s = F.regexp_replace(F.upper(trim_all(text(c))), r"\s+", " ")
    return s.rlike(r"^[A-Z]{1,2}[0-9][A-Z0-9]?(\s?[0-9][A-Z]{2})?$")


def phone(c: Column | str) -> Column:
    """Digits of a phone number in its national form."""
    s = F.regexp_replace(F.regexp_replace(text(c), r"\(0\)", ""), r"[^\d+]", "")
    national = (
        F.when(s.startswith("+44"), F.concat(F.lit("0"), s.substr(F.lit(4), F.length(s))))
        .when(s.startswith("44") & (F.length(s) > 10), F.concat(F.lit("0"), s.substr(F.lit(3), F.length(s))))
        .when(s.startswith("0044"), F.concat(F.lit("0"), s.substr(F.lit(5), F.length(s))))
        .otherwise(s)
    )
    return F.regexp_replace(national, r"\D", "")


def phone_display(c: Column | str) -> Column:
    d = F.regexp_replace(text(c), r"\D", "")
    return (
        F.when((F.length(d) == 11) & d.startswith("020"),
               F.concat_ws(" ", d.substr(1, 3), d.substr(4, 4), d.substr(8, 4)))
        .when(F.length(d) == 11, F.concat_ws(" ", d.substr(1, 5), d.substr(6, 6)))
        .otherwise(trim_all(text(c)))
    )


def gender(c: Column | str) -> Column:
    v = trim_all(F.lower(text(c)))
    return (
        F.when(v.contains("girl") | (v == "f"), "Girls").when(v.contains("boy") | (v == "m"), "Boys").otherwise("Mixed")
    )


def gender_policy(c: Column | str) -> Column:
    """struct(gender, sixth_form): main policy and any separate sixth-form one."""
    g = F.lower(trim_all(c))
    sixth_mixed = contains_any(g, ("boys (11-16)", "boys / mixed"))
    main = (
        F.when(sixth_mixed, "Boys")
        .when(g.contains("girls / mixed prep"), "Girls")
        .when(g.startswith("girl") | (g == "female"), "Girls")
        .when(g.startswith("boy") | (g == "male"), "Boys")
        .otherwise("Mixed")
    )
    return F.struct(
        F.when(col(c) != "", main).alias("gender"),
        F.when((col(c) != "") & sixth_mixed, "Co-educational / Mixed Sixth Form (16-18)").alias("sixth_form"),
    )


# Names that mark a selective organisation.
SELECTIVE_NAMES = ("grammar", "tiffin", "latymer school", "henrietta barnett", "queen elizabeth's school, barnet")


def org_type(kind: Column | str, name: Column | str, rating: Column | str) -> Column:
    """Independent, Grammar or Comprehensive."""
    t = F.lower(trim_all(text(kind)))
    return (
        F.when(contains_any(t, ("independent", "isi")) | text(rating).contains("ISI"), "Independent")
        .when(t.contains("grammar") | contains_any(F.lower(text(name)), SELECTIVE_NAMES), "Grammar")
        .otherwise("Comprehensive")
    )


def register_type(kind: Column | str, name: Column | str, admissions: Column | str) -> Column:
    raw, low = F.lower(text(kind)), F.lower(text(name))
    return (
        F.when(low.contains("grammar") | (F.lower(text(admissions)) == "selective"), "Grammar")
        .when(contains_any(raw, ("independent", "public")) | (low.contains("college") & raw.contains("other")), "Independent")
        .when(contains_any(raw, ("special", "pupil referral")), "Special")
        .otherwise("Comprehensive")
    )


# Exam kinds and the phrases that name them, first match wins.
EXAM_KINDS = (
    ("ISEB Common Pre-Test", ("iseb", "common pre-test")),
    ("GL Assessment", ("gl assessment", "gl ", "gl 11", "kent test", "bexley", "sutton set")),
    ("London 11+ Consortium", ("london 11+", "london consortium", "consortium")),
    ("CSSE 11+ Exam", ("csse", "essex")),
    ("CEM Assessment", ("cem",)),
)
OPEN_ADMISSION = ("non-selective", "comprehensive", "distance", "sibling", "pan")


def exam_kind(c: Column | str) -> Column:
    v = trim_all(F.lower(text(c)))
    out = F.when(text(c) == "", "Comprehensive")
    for label, words in EXAM_KINDS:
        out = out.when(contains_any(v, words), label)
    out = out.when(v.contains("school-own") | (v.contains("school") & v.contains("own")), "School-Own Exam")
    return out.when(contains_any(v, OPEN_ADMISSION), "Comprehensive").otherwise(trim_all(c))


# Query keys that only track a visitor.
TRACKING_KEYS = ("fbclid", "gclid", "ref")


def clean_url(c: Column | str) -> Column:
    """Link with a scheme, lower-case host, no tracking keys, no bare slash."""
    raw = trim_all(c)
    full = F.when(raw.startswith("http://") | raw.startswith("https://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    pattern = r"^(?i:(https?)://)([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?$"
    part = [F.regexp_extract(full, pattern, i) for i in range(1, 6)]
    scheme, host, path, search, frag = F.lower(part[0]), F.lower(part[1]), part[2], part[3], part[4]
    path = F.when(path == "", "/").otherwise(path)
    kept = F.filter(
        F.split(search, "&"),
        lambda p: (p != "") & ~p.startswith("utm_") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING_KEYS),
    )
    kept_query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    tail = F.concat(path, kept_query, frag)
    built = F.concat(scheme, F.lit("://"), host, F.when(tail == "/", "").otherwise(tail))
    return F.when(raw == "", F.lit(None)).when(host == "", full).otherwise(built)


def fee_number(c: Column | str, low: int = 101, high: int = 99999) -> Column:
    """First whole number of a fee text, kept only within the given bounds."""
    n = F.regexp_extract(F.regexp_replace(text(c), ",", ""), r"\d+", 0).try_cast("bigint")
    return F.when(n.between(low, high), n)


# Districts of the capital.
LONDON_DISTRICTS = (
    "Barking and Dagenham", "Barnet", "Bexley", "Brent", "Bromley", "Camden", "City of London", "Croydon", "Ealing",
    "Enfield", "Greenwich", "Hackney", "Hammersmith and Fulham", "Haringey", "Harrow", "Havering", "Hillingdon",
    "Hounslow", "Islington", "Kensington and Chelsea", "Kingston upon Thames", "Lambeth", "Lewisham", "Merton",
    "Newham", "Redbridge", "Richmond upon Thames", "Southwark", "Sutton", "Tower Hamlets", "Waltham Forest",
    "Wandsworth", "Westminster",
)

# Region names as they appear in an official region text.
REGION_TEXTS = (
    ("london", "Greater London"), ("west midlands", "West Midlands"), ("north west", "North West"),
    ("south east", "South East"), ("east of england", "East of England"), ("eastern", "East of England"),
    ("yorkshire", "Yorkshire and the Humber"), ("south west", "South West"), ("north east", "North East"),
    ("east midlands", "East Midlands"),
)

# District names per region, first match wins.
REGION_DISTRICTS = (
    ("West Midlands", "birmingham|coventry|dudley|sandwell|solihull|walsall|wolverhampton|staffordshire|warwickshire|"
     "worcestershire|herefordshire|shropshire|telford"),
    ("North West", r"manchester|bolton|bury|oldham|rochdale|salford|stockport|tameside|trafford|wigan|liverpool|wirral|"
     r"sefton|st\.? helens|knowsley|lancashire|blackpool|blackburn|cheshire|cumbria"),
    ("South East", "kent|surrey|sussex|oxfordshire|berkshire|buckinghamshire|hampshire|isle of wight|portsmouth|"
     "southampton|milton keynes|slough|windsor|bracknell|reading|wokingham|west berkshire"),
    ("East of England", "hertfordshire|essex|cambridgeshire|norfolk|suffolk|bedfordshire|luton|peterborough|southend|thurrock"),
    ("Yorkshire and the Humber", "yorkshire|leeds|sheffield|bradford|wakefield|kirklees|calderdale|barnsley|doncaster|"
     "rotherham|hull|york"),
    ("South West", "bristol|gloucestershire|somerset|devon|cornwall|dorset|wiltshire|plymouth|torbay|bournemouth|poole|"
     "swindon|bath"),
    ("North East", "newcastle|sunderland|durham|northumberland|gateshead|north tyneside|south tyneside|hartlepool|"
     "middlesbrough|redcar|stockton"),
    ("East Midlands", "derbyshire|nottinghamshire|leicestershire|northamptonshire|lincolnshire|derby|nottingham|leicester|rutland"),
)


def region_of(district: Column | str, region_text: Column | str | None = None) -> Column:
    """Region by its official text if given, else by district name."""
    out = F.when(F.lit(False), "")
    if region_text is not None:
        r = F.lower(text(region_text))
        for word, label in REGION_TEXTS:
            out = out.when(r.contains(word), label)
    d = F.lower(text(district))
    for label, words in REGION_DISTRICTS:
        out = out.when(d.rlike(words), label)
    return out.otherwise("Greater London")


def in_london(district: Column | str) -> Column:
    return F.when(text(district).isin(*LONDON_DISTRICTS), "Greater London").otherwise("England")


def join_address(*parts: Column | str) -> Column:
    """Non-empty parts joined by a comma."""
    return F.array_join(F.filter(F.array(*[col(p) for p in parts]), lambda p: F.trim(p) != ""), ", ")


# What makes an address a street address, and its empty texts.
STREET = (
    r"(?i)\b(\d+[a-z]?|road|rd|street|st|avenue|ave|lane|ln|close|cl|drive|dr|way|crescent|cres|court|ct|gardens|gdns|"
    r"terrace|terr|hill|walk|place|pl|grove|grv|park|pk|house|hall|square|sq|row|quay|wharf|boulevard|blvd|mews|rise|"
    r"vale|yard|broadway|bypass|embankment)\b"
)
EMPTY_ADDRESS = ("", "N/A", "null", "undefined")


def better_address(old: Column | str, new: Column | str) -> Column:
    """True where ``new`` may replace ``old``: never a coarse one for a detailed one."""
    cur, nxt = trim_all(text(old)), trim_all(text(new))

    def parts(a: Column) -> Column:
        return F.size(F.filter(F.transform(F.split(a, r"[,;\n]+"), trim_all), lambda p: p != ""))

    cur_street, new_street = cur.rlike(STREET), nxt.rlike(STREET)
    coarser = (
        (F.lower(cur) == F.lower(nxt))
        | ((parts(nxt) == 1) & ((parts(cur) > 1) | cur_street))
        | (cur_street & ~new_street)
        | (F.lower(cur).contains(F.lower(nxt)) & (F.length(cur) > F.length(nxt) + 4))
        | ((parts(cur) > parts(nxt)) & (F.length(cur) > F.length(nxt) + 8))
    )
    return F.when(nxt.isin(*EMPTY_ADDRESS), F.lit(False)).when(cur.isin(*EMPTY_ADDRESS), F.lit(True)).otherwise(~coarser)


# Counties that may name a place by themselves.
COUNTIES = (
    "Bedfordshire", "Berkshire", "Bristol", "Buckinghamshire", "Cambridgeshire", "Cheshire", "Cornwall", "Cumbria",
    "Derbyshire", "Devon", "Dorset", "Durham", "East Riding of Yorkshire", "East Sussex", "Essex", "Gloucestershire",
    "Greater London", "Greater Manchester", "Hampshire", "Herefordshire", "Hertfordshire", "Isle of Wight", "Kent",
    "Lancashire", "Leicestershire", "Lincolnshire", "Merseyside", "Norfolk", "North Somerset", "North Yorkshire",
    "Northamptonshire", "Northumberland", "Nottinghamshire", "Oxfordshire", "Rutland", "Shropshire", "Somerset",
    "South Gloucestershire", "South Yorkshire", "Staffordshire", "Suffolk", "Surrey", "Tyne and Wear", "Warwickshire",
    "West Midlands", "West Sussex", "West Yorkshire", "Wiltshire", "Worcestershire",
)
LONDON_POSTCODE = r"(?i)^(E|EC|N|NW|SE|SW|W|WC)\d"
UNKNOWN_PLACE = "Not specified"


def place_of(region: Column | str, district: Column | str, address: Column | str, code: Column | str) -> Column:
    """struct(city, county) read from region, district, address and postcode."""
    r, d = text(region), text(district)
    london = F.lower(r).contains("london") | F.lower(d).contains("london")
    county = (
        F.when(r.isin(*COUNTIES), r).when(d.isin(*COUNTIES), d).when(london, "Greater London")
        .when(r != "", r).when(d != "", d).otherwise(UNKNOWN_PLACE)
    )
    parts = F.filter(F.transform(F.split(text(address), ","), trim_all), lambda p: p != "")
    n = F.size(parts)
    last = trim_all(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?i)[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}", ""))
    before = F.try_element_at(parts, F.lit(-2))
    city = (
        F.when(london | text(code).rlike(LONDON_POSTCODE), "London")
        .when((d != "") & ~d.isin(*COUNTIES), d)
        .when((n >= 2) & (last != "") & ~last.isin(*COUNTIES), last)
        .when((n >= 3) & ~before.isin(*COUNTIES), before)
        .otherwise(UNKNOWN_PLACE)
    )
    return F.struct(city.alias("city"), county.alias("county"))
