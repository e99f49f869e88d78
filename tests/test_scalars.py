import datetime as dt

import pytest
from pyspark.sql import functions as F

from dirwise.functions import dates, geo, markup, names, payloads, sets, values


@pytest.mark.parametrize("raw,unit", [("en54dq", "EN5 4DQ"), ("  w6  7bs ", "W6 7BS"), ("SW1A1AA", "SW1A 1AA"), ("sw19", "SW19"), ("", "")])
def test_postcode_unit(one, raw, unit):
    assert one(names.postcode(F.lit(raw))) == unit


@pytest.mark.parametrize("raw,out", [("EN5 4DQ", "EN5"), ("SW1A 1AA", "SW1A")])
def test_outcode(one, raw, out):
    assert one(names.outcode(F.lit(raw))) == out


@pytest.mark.parametrize("raw,ok", [("EN5 4DQ", True), ("w6 7bs", True), ("SW19", True), ("invalid-123", False), ("", False)])
def test_postcode_validity(one, raw, ok):
    assert one(names.is_postcode(F.lit(raw))) is ok


@pytest.mark.parametrize("raw,out", [("+44 (0)20 8441 4646", "02084414646"), ("0044 20 8441 4646", "02084414646"), ("442084414646", "02084414646"), ("020 8441 4646", "02084414646"), (None, "")])
def test_phone(one, raw, out):
    assert one(names.phone(F.lit(raw))) == out


def test_phone_display(one):
    assert one(names.phone_display(F.lit("02084414646"))) == "020 8441 4646"
    assert one(names.phone_display(F.lit("01689820101"))) == "01689 820101"
    assert one(names.phone_display(F.lit(" 123 "))) == "123"


@pytest.mark.parametrize("raw,main,sixth", [
    ("Boys (11-16), Co-ed Sixth Form", "Boys", "Co-educational / Mixed Sixth Form (16-18)"), ("girls only", "Girls", None), ("Male", "Boys", None),
    ("Co-educational", "Mixed", None), ("", None, None)])
def test_gender_policy(one, raw, main, sixth):
    p = one(names.gender_policy(F.lit(raw)))
    assert (p["gender"], p["sixth_form"]) == (main, sixth)


@pytest.mark.parametrize("raw,out", [
    ("WWW.Example.org/", "https://www.example.org"), ("http://a.org/x?utm_source=1&b=2", "http://a.org/x?b=2"), ("https://a.org/?ref=1#top", "https://a.org/#top"),
    ("https://a.org/p/", "https://a.org/p/"), ("", None)])
def test_clean_url(one, raw, out):
    assert one(names.clean_url(F.lit(raw))) == out


@pytest.mark.parametrize("old,new,better", [
    ("10 Church Road, Wimbledon, London SW19 5DQ", "London", False), ("Queen Elizabeth Road, Kingston upon Thames", "Kingston upon Thames", False),
    ("Broadfield Road, Catford, London, SE6 1TJ", "Catford", False), ("London", "10 High Street, Barnet, EN5 5XG", True), ("", "10 High Street, Barnet, EN5 5XG", True),
    ("N/A", "10 High Street, Barnet, EN5 5XG", True), ("10 High Street, Barnet", "10 High Street, Barnet, Hertfordshire, EN5 5XG", True), ("x", None, False)])
def test_better_address(one, old, new, better):
    assert one(names.better_address(F.lit(old), F.lit(new))) is better


@pytest.mark.parametrize("raw,ymd", [
    ("13 November 2026", (2026, 11, 13)), ("mid-Feb 2027", (2027, 2, 15)), ("12/09/2026", (2026, 9, 12)), ("Autumn", (2026, 10, 15)), ("Spring", (2027, 2, 15)),
    ("Sat 3rd Oct 2026 — for Sept 2029 entry", (2026, 10, 3)), ("Rolling", None), ("TBC", None), ("31 February 2026", (2026, 2, 31))])
def test_timeline_date(one, raw, ymd):
    t = one(dates.timeline_date(F.lit(raw)))
    assert (t and (t["year"], t["month"], t["day"])) == ymd
    if raw.startswith("31 Feb"):
        assert t["date"] == dt.date(2026, 3, 3)


@pytest.mark.parametrize("raw,day", [
    ("Saturday 12 September 2026", dt.date(2026, 9, 12)), ("October 2026", dt.date(2026, 10, 1)), ("by 2026-08-31", dt.date(2026, 8, 31)), ("TBD", None), ("32 May 2026", None)])
def test_admissions_date(one, raw, day):
    assert one(dates.admissions_date(F.lit(raw))) == day


@pytest.mark.parametrize("raw,out", [
    ("12 September 2025", "12 September 2026"), ("November/December 2025", "November/December 2026"), ("January 2026", "January 2027"), ("5th Feb 2026", "5th Feb 2027"),
    ("June 2025", "June 2025"), ("12 September 2026", "12 September 2026")])
def test_roll_forward(one, raw, out):
    r = one(dates.roll_forward(F.lit(raw)))
    assert r["value"] == out and bool(r["reasons"]) == (raw != out)


@pytest.mark.parametrize("field,a,b,same", [
    ("phone", "020 8441 4646", "+44 20 8441 4646", True), ("postcode", "en54dq", "EN5 4DQ", True), ("gender", "Girls only", "f", True), ("website", "a", "b", False),
    ("examDate", "12 Sept 2026", "12/09/2026", True), ("examDate", "13 Sept 2026", "12/09/2026", False), ("phone", "", None, True), ("phone", "1", None, False)])
def test_same_meaning(one, field, a, b, same):
    assert one(dates.same_meaning(field, F.lit(a), F.lit(b))) is same


def test_many_and_one_date(one):
    assert one(dates.many_dates(F.lit("1 May; 2 May\n3 May"))) == ["1 May", "2 May", "3 May"]
    assert one(dates.many_dates(F.lit("May; or June"))) == ["May; or June"]
    assert one(dates.one_date(F.lit(" N/A "))) is None
    assert one(dates.first_date(F.array(F.lit(""), F.lit("null"), F.lit(" 1 May ")))) == "1 May"


def test_similarity_bounds(one):
    a, b = F.lit("stpaulsgirls"), F.lit("stpaulsgirlschool")
    x, y = one(sets.jaccard(a, b)), one(sets.jaccard(b, a))
    assert x == y and 0 < x < 1
    assert one(sets.jaccard(F.lit("ab"), F.lit("ac"))) == 0.0 and one(sets.jaccard(F.lit("ab"), F.lit("ab"))) == 1.0
    assert one(sets.dice(F.lit(""), F.lit(""))) == 0.0


def test_distances(one):
    assert one(geo.haversine(F.lit(51.5), F.lit(-0.1), F.lit(51.5), F.lit(-0.1))) == 0.0
    assert one(geo.grid_miles(F.lit(0), F.lit(0), F.lit(1609), F.lit(0))) == 1.0


def test_grid_round_trip(spark):
    rows = spark.range(0, 200).select((F.lit(200000) + F.col("id") * 2000).alias("e"), (F.lit(100000) + F.col("id") * 2500).alias("n"))
    back = rows.select("e", "n", geo.grid_to_latlon("e", "n").alias("c")).select("e", "n", geo.latlon_to_grid("c.lat", "c.lon").alias("g"))
    worst = back.select(F.max(F.abs(F.col("e") - F.col("g.easting"))).alias("a"), F.max(F.abs(F.col("n") - F.col("g.northing"))).alias("b")).first()
    assert worst["a"] <= 1 and worst["b"] <= 1


@pytest.mark.parametrize("raw,ok", [
    ('{"a": 1, "b": [1, 2,],}', True), ('```json\n{"a": 1}\n```', True), ('{"a": None, "b": True}', True), ("{'a': 1}", True), ('{"a": 1 /* x */}', True),
    ("note {\"a\": 1} end", True), ("no json", False), ('{"a": ', False)])
def test_repaired_json(one, raw, ok):
    assert (one(payloads.repaired_json(F.lit(raw))) is not None) is ok


def test_markup(one):
    html = "<title> A &amp; B </title><script>var x='<p>';</script><style>p{}</style><h1>Hi <b>you</b></h1><p>Call&nbsp;020 8123 4567</p>"
    assert one(markup.html_text(F.lit(html))) == "A & B Hi you Call 020 8123 4567"
    assert one(markup.page_title(F.lit(html))) == "A &amp; B"
    assert one(markup.page_headings(F.lit(html))) == ["Hi you"]
    assert one(markup.phones_in(F.lit("020 8123 4567 and 020 8123 4567"))) == ["020 8123 4567"]
    assert one(markup.decode_entities(F.lit("Tom&#39;s &#8211; x"))) == "Tom's – x"
    for tag in ('<meta name="description" content="D">', "<meta content='D' name='description'>"):
        assert one(markup.page_description(F.lit(tag))) == "D"


@pytest.mark.parametrize("url,foreign", [
    ("https://en.wikipedia.org/wiki/X", True), ("https://www.get-information-schools.service.gov.uk/x", True), ("https://www.snobe.co.uk", True), ("https://facebook.com/x", True),
    ("https://www.qebarnet.co.uk", False), ("wilsons.school", False), ("", True)])
def test_foreign_hosts(one, url, foreign):
    assert one(markup.is_foreign_host(F.lit(url))) is foreign


def test_result_links(one):
    html = ('<a href="/url?q=https://www.one.org/&sa=U">1</a><a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Ftwo.org%2Fabout%3Fx%3D1&rut=2">2</a>'
            '<a href="/url?q=https://en.wikipedia.org/wiki/A&sa=U">3</a><a class="x" href="https://www.facebook.com/p">4</a><a href="https://www.one.org/b">5</a>')
    assert one(markup.result_links(F.lit(html))) == ["https://www.one.org", "https://two.org/about"]


def test_missing_and_numbers(one):
    assert one(values.is_na(F.lit("N/A (anything)"))) and one(values.is_na(F.lit(None).cast("string"))) and not one(values.is_na(F.lit("12 May")))
    assert one(values.lenient_int(F.lit(" 12 pupils"))) == 12 and one(values.lenient_int(F.lit("x1"))) is None
    assert one(values.round_half_up(F.lit(2.5))) == 3 and one(values.round_half_up(F.lit(-2.5))) == -2
