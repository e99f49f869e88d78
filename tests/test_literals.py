"""Contacts, milestones and regions against literal expectations, apart from the operators' own patterns."""
import pytest
from pyspark.sql import functions as F

from dirwise.functions import markup, names
from dirwise.operators import verify


@pytest.mark.parametrize("given,want", [
    ("Call 020 8441 4646 or +44 (0)20 8441 4646.", ["020 8441 4646", "+44 (0)20 8441 4646"]), ("Fax 01623 555123; year 2026, id 123456", ["01623 555123"]), ("+44 1234 567890", ["+44 1234 567890"]),
    ("12345", []), ("", []), (None, [])])
def test_phones(one, given, want):
    assert (one(markup.phones_in(F.lit(given).cast("string"))) or []) == want


@pytest.mark.parametrize("given,want", [
    ("Office@School.sch.uk, office@school.sch.uk", ["office@school.sch.uk"]), ("a@example.com b@sentry.wixpress.com c.d+e@x-y.org.uk", ["c.d+e@x-y.org.uk"]), ("not@here", []), (None, [])])
def test_emails(one, given, want):
    assert (one(markup.emails_in(F.lit(given).cast("string"))) or []) == want


@pytest.mark.parametrize("given,want", [
    ("EN5 4DQ and en5 4dq, SW1A 1AA", ["EN5 4DQ", "SW1A 1AA"]), ("GIR 0AA M1 1AE B33 8TH CR2 6XH DN55 1PT W1A 1HQ EC1A 1BB", ["GIR 0AA", "M1 1AE", "B33 8TH", "CR2 6XH", "DN55 1PT", "W1A 1HQ", "EC1A 1BB"]),
    ("YEAR7 2026 X99", [])])
def test_postcodes(one, given, want):
    assert one(markup.postcodes_in(F.lit(given))) == want


@pytest.mark.parametrize("given,want", [
    ("Registration opens on 1 May 2026.", {"registrationOpen": "1 May 2026"}), ("Registration closes: Friday 10 July 2026", {"registrationDeadline": "10 July 2026"}),
    ("National Offer Day 1 March 2027", {"offersAcceptance": "1 March 2027"}), ("Our canteen opens daily. The 5 May 2026 fair.", {})])
def test_milestones(one, given, want):
    got = one(verify.milestones_seen(F.lit(given))) or {}
    assert {k: v for k, v in got.items() if k in want} == want and (want or not got)


@pytest.mark.parametrize("district,region", [
    ("Birmingham", "West Midlands"), ("Trafford", "North West"), ("Kent", "South East"), ("Slough", "South East"), ("Essex", "East of England"), ("Leeds", "Yorkshire and the Humber"),
    ("Kingston upon Hull", "Yorkshire and the Humber"), ("Devon", "South West"), ("Gateshead", "North East"), ("Rutland", "East Midlands"), ("Barnet", "Greater London"), ("", "Greater London"), (None, "Greater London")])
def test_regions(one, district, region):
    assert one(names.region_of(F.lit(district).cast("string"))) == region


def test_tags_in_any_order_and_case(one):
    page = """<TITLE lang='en'>A <b>B</b></TITLE><meta content='first "x"' NAME="Description"><META name='description' content="second">
      <a title="t" HREF='/one'>One</a><a data-href="/no">No</a><abbr href="/not">x</abbr><h1 class=x>Head <i>two</i></h1><h1></h1>"""
    assert one(markup.page_description(F.lit(page))) == 'first "x"'
    assert one(markup.page_headings(F.lit(page))) == ["Head two"]
    assert one(F.transform(markup.opening_tags(F.lit(page), "a"), lambda t: markup.attribute(t, "href"))) == ["/one", ""]
    assert one(markup.page_title(F.lit(page))) == "A <b>B</b>"
