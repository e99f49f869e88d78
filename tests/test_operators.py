"""Filters, scores, quality rules, links, changes, search and files on small literal data."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dirwise.operators import aggregates as agg
from dirwise.operators import changes, enrich, filters, link, merge, nearby, quality, ranking, records, scoring, search, verify
from dirwise.sources import readers, seeds, writers

RICH = dict(
    id="1", name="A School", website="https://a.sch.uk", entranceExamType="GL Assessment", stage_one_format_and_subjects="VR", second_stage_exam_required="No", schoolType="Grammar", gender="Boys",
    ofstedRating="Outstanding", gcseAttainment8=75.0, national_rank_england=5, gcse_rank_england=6, phone="020 8441 4646", email="a@b.org", address="1 Road", postcode="EN5 4DQ", la="Barnet",
    fees_termly_gbp=0, feesTermly="", d={"registrationOpen": "1 May 2026", "registrationDeadline": "1 July 2026", "examDate": "1 Sept 2026", "resultsDate": "1 Oct 2026", "offersAcceptance": "1 March 2027"})
POOR = dict(RICH, id="2", website="", entranceExamType="", stage_one_format_and_subjects="", second_stage_exam_required="", ofstedRating="", gcseAttainment8=None, national_rank_england=None,
            gcse_rank_england=None, phone="", email="", address="", postcode="", la="", d={"examDate": "TBC"})
FULL = ("id string, name string, website string, entranceExamType string, stage_one_format_and_subjects string, second_stage_exam_required string, schoolType string, gender string, ofstedRating string, "
        "gcseAttainment8 double, national_rank_england int, gcse_rank_england int, phone string, email string, address string, postcode string, la string, fees_termly_gbp int, feesTermly string, entranceExamDates map<string,string>")


def full(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], FULL)


def test_completeness(spark):
    assert sum(scoring.WEIGHTS.values()) == 100
    r = {x["id"]: x for x in scoring.completeness(full(spark, RICH, POOR)).collect()}
    assert r["1"]["completeness"] >= 90 and r["1"]["breakdown"]["website"] == 20 and r["1"]["breakdown"]["examDates"] == 25
    assert r["2"]["completeness"] < 30
    only = {k: 0 for k in scoring.WEIGHTS} | {"website": 50, "examDates": 50}
    assert scoring.completeness(full(spark, RICH), only).first()["completeness"] >= 95


@pytest.mark.parametrize("wanted,fits", [
    (["boys", "girls", "mixed"], "BGM"), (["girls"], "G"), (["boys"], "B"), (["mixed"], "M"), (["girls", "mixed"], "GM"), (["boys", "mixed"], "BM"), (["boys", "girls"], "BG")])
def test_sex_filter(spark, wanted, fits):
    df = spark.createDataFrame([("B", "Boys"), ("G", "Girls"), ("M", "Co-educational")], "k string, gender string")
    assert {r["k"] for r in df.filter(filters.accepts_sexes(wanted)).collect()} == set(fits)


def test_rating_is_asymmetric(spark):
    rows = [("o", "Outstanding"), ("g", "Good"), ("r", "Requires improvement")]
    base = spark.createDataFrame(rows, "id string, ofstedRating string")
    for c, v in dict(gender="Mixed", schoolType="Comprehensive", entranceExamType="", la="", postcode="", address="").items():
        base = base.withColumn(c, F.lit(v))
    for c in ("national_rank_england", "gcse_rank_england", "a_level_rank_england", "gcseAttainment8", "gcseProgress8", "easting", "northing", "primary_exam_type_id", "exam_consortium_id"):
        base = base.withColumn(c, F.lit(None).cast("double"))
    base = base.withColumn("exam_consortium", F.lit(""))
    s = {r["id"]: r["matchScore"] for r in scoring.recommend(base, spark.createDataFrame([], "id string")).collect()}
    assert s["o"] - s["g"] <= 5 and s["g"] - s["r"] >= 20


def test_best_advice_scores_few_pairs(spark, monkeypatch):
    """The best of the scored pairs are the best of all pairs, ties by id, and most pairs are never scored."""
    r = random.Random(4)
    pick = lambda *x: r.choice(x)
    rows = [(f"e{i:05d}", pick("Boys", "Girls", "Mixed", ""), pick("Grammar", "Independent", "Academy", "", None), pick("Outstanding", "Good", "Inadequate", None), pick("Kent", "Essex", ""), "", pick("1 Kent Road", ""),
             pick(None, *range(1, 600, 7)), None, None, pick(None, *range(30, 90)), pick(None, *[x / 10 for x in range(-9, 10)]), r.randint(500_000, 600_000), r.randint(150_000, 250_000), pick(None, 1, 2, 3), pick(None, 1, 2),
             pick("", "CEM", "GL", None), pick("", "none", "CSSE", None)) for i in range(3000)]
    schema = ("id string, gender string, schoolType string, ofstedRating string, la string, postcode string, address string, national_rank_england double, gcse_rank_england double, a_level_rank_england double, "
              "gcseAttainment8 double, gcseProgress8 double, easting int, northing int, primary_exam_type_id int, exam_consortium_id int, entranceExamType string, exam_consortium string")
    entities = spark.createDataFrame([tuple(float(x) if 7 <= j <= 11 and x is not None else x for j, x in enumerate(row)) for row in rows], schema)
    users = [(u, pick("top_class", "above_average", "average", "NA", None), pick(None, "good"), pick(None, "very"), pick(None, ["girls"], []), pick(None, ["Grammar"]), pick(None, ["cem"]), pick(None, ["Kent"])) for u in range(20)]
    users = spark.createDataFrame(users, "user_id int, ability string, rating string, proximity string, sexes array<string>, types array<string>, exam_formats array<string>, places array<string>")
    keeps = spark.createDataFrame([(u, f"e{r.randint(0, 2999):05d}") for u in range(18) for _ in range(4)], "user_id int, id string")
    spots = spark.createDataFrame([(u, 500_000.0 + 5000 * u, 200_000.0) for u in range(0, 20, 3)], "user_id int, easting double, northing double")
    seen, own = [], scoring.promising_pairs
    monkeypatch.setattr(scoring, "promising_pairs", lambda *a: (out := own(*a), seen.append(out.count()))[0])
    best = scoring.recommend_many(entities, users, keeps, None, spots, 7)
    every = {}
    for x in scoring.recommend_many(entities, users, keeps, None, spots, None).collect():
        every.setdefault(x["user_id"], []).append((-x["matchScore"], x["id"], x["distanceMiles"], x["reasons"]))
    got = {}
    for x in best.collect():
        got.setdefault(x["user_id"], []).append((-x["matchScore"], x["id"], x["distanceMiles"], x["reasons"]))
    assert {u: sorted(v) for u, v in got.items()} == {u: sorted(v)[:7] for u, v in every.items()}
    assert seen[0] < 0.25 * 20 * 3000


@pytest.mark.parametrize("votes,reviewed,score,level", [([], False, None, None), ([1], False, 65, "Medium"), ([-1], False, 50, "Low"), ([], True, 100, "High"), ([1] * 6, False, 90, "High"), ([-1] * 9, False, 15, "Low")])
def test_field_confidence(spark, votes, reviewed, score, level):
    v = spark.createDataFrame([(i, "s", "f", x) for i, x in enumerate(votes)], "userId int, schoolId string, fieldName string, vote int")
    r = spark.createDataFrame([("s", "f")] if reviewed else [], "schoolId string, fieldName string")
    got = agg.field_confidence(v, r).collect()
    assert [(g["score"], g["level"]) for g in got] == ([(score, level)] if score else [])


def pages(spark, *rows):
    schema = "id string, name string, phone string, email string, postcode string, la string, address string, gender string, entranceExamType string, html string, entranceExamDates map<string,string>"
    return verify.extract(spark.createDataFrame(rows, schema))


def page(html, name="Queen Elizabeth's School", phone="", email="", postcode="", gender="", exam="", dates=None):
    return ("1", name, phone, email, postcode, "", "", gender, exam, html, dates or {})


def test_page_identity(spark):
    good = verify.identity(pages(spark, page("<title>Queen Elizabeth's School, Barnet</title>"))).first()
    bad = verify.identity(pages(spark, page("<title>Domain For Sale</title><p>This domain is for sale</p>"))).first()
    assert good["valid"] and not bad["valid"] and bad["tag"] == "domain_mismatch"


def test_contacts(spark):
    html = "<p>020 8441 4646 office@qebarnet.co.uk EN5 4DQ</p>"
    same = pages(spark, page(html, phone="020 8441 4646", email="office@qebarnet.co.uk", postcode="EN5 4DQ"))
    other = pages(spark, page(html, phone="01234 567890", email="office@qebarnet.co.uk", postcode="EN5 4DQ"))
    assert same.select(verify.contact_mismatches(same).alias("k")).first()["k"] == []
    assert other.select(verify.contact_mismatches(other).alias("k")).first()["k"] == ["CONTACT_PHONE_MISMATCH"]


def test_exam_and_sex(spark):
    ok = pages(spark, page("<p>We use the GL Assessment</p>", exam="GL Assessment"))
    bad = pages(spark, page("<p>ISEB Common Pre-Test</p>", exam="Local Authority (Distance)"))
    for p, want in ((ok, False), (bad, True)):
        assert p.select(verify.exam_mismatch(verify.exam_seen()).alias("m")).first()["m"] is want
    girls = pages(spark, page("<p>A school for girls</p>", name="X Girls School", gender="Girls"))
    assert girls.select(verify.sex_mismatch(verify.sex_seen()).alias("m")).first()["m"] is False


def test_milestones(spark):
    html = "<p>Year 7 admissions. Registration deadline: 20 November 2026. Entrance exam on 9 January 2027. Offers posted by 1 March 2027.</p>"
    p = pages(spark, page(html, dates={"registrationDeadline": "20 November 2026", "examDate": "9 January 2027", "offersAcceptance": "1 March 2027"}))
    assert {r["status"] for r in verify.milestone_verdicts(p).collect()} == {"verified"}
    p = pages(spark, page("<p>11+ admissions: closing date for applications is 31st October</p>", dates={"registrationDeadline": "20 November 2026"}))
    r = verify.milestone_verdicts(p).first()
    assert (r["status"], r["webValue"]) == ("discrepancy", "31st October 2026")
    p = pages(spark, page("<p>Welcome</p>"))
    assert verify.milestone_verdicts(p).first()["status"] == "data_missing"


def test_first_candidate_wins(spark):
    rows = spark.createDataFrame([("1", 1, "u1", False, None), ("1", 2, "u2", True, 92), ("2", 3, "u3", True, 92), ("3", 1, "u4", True, 85), ("3", 2, "u5", True, 92)], "id string, candidate int, url string, isMatch boolean, confidenceScore int")
    got = {r["id"]: r["proposedWebsite"] for r in verify.choose_candidate(rows).collect()}
    assert got == {"1": "u2", "2": "u3", "3": "u4"}
    assert {r["id"] for r in verify.choose_candidate(rows, best=2).collect()} == {"1", "3"}


def brute_accept(rows):
    seen_n, seen_u, ok = set(), set(), set()
    for i, n, u in sorted(rows):
        if n in seen_n or (u is not None and u in seen_u):
            continue
        ok.add(i)
        seen_n.add(n)
        if u is not None:
            seen_u.add(u)
    return ok


@pytest.mark.parametrize("seed", range(3))
def test_batch_acceptance(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"n{r.randint(0, 12)}" if r.random() < 0.7 else "hot", None if r.random() < 0.3 else f"u{r.randint(0, 12)}") for i in range(60)]
    got = link.first_accepted(spark.createDataFrame(rows, "rowNum int, _name string, _urn string"), "rowNum", "_name", "_urn")
    assert {x["rowNum"] for x in got.collect()} == brute_accept(rows)


@pytest.mark.parametrize("seed", range(3))
def test_long_chains_and_mixtures_are_accepted_in_order(spark, seed):
    """Chains in both directions, in random order, and branching ones beside a hot name."""
    r = random.Random(seed)
    rows = [(i, f"n{i // 2}", f"u{(i + 1) // 2}") for i in range(400)] + [(1000 + i, f"m{(300 - i) // 2}", f"v{(301 - i) // 2}") for i in range(300)]
    rows += [(2000 + i, f"b{(i + r.randint(0, 3)) // 2}", f"w{(i + r.randint(0, 3)) // 2}") for i in range(300)] + [(3000 + i, "hot", f"x{i // 3}") for i in range(300)]
    got = link.first_accepted(spark.createDataFrame(rows, "rowNum int, _name string, _urn string"), "rowNum", "_name", "_urn")
    assert {x["rowNum"] for x in got.collect()} == brute_accept(rows)


def test_a_very_long_chain_takes_few_rounds(spark, monkeypatch):
    writes = []
    for module in (link, merge):
        own = module.saved
        monkeypatch.setattr(module, "saved", lambda df, own=own: writes.append(1) or own(df))
    rows = spark.range(100_000).selectExpr("id AS rowNum", "concat('n', id div 2) AS _name", "concat('u', (id + 1) div 2) AS _urn")
    got = link.first_accepted(rows, "rowNum", "_name", "_urn")
    assert got.count() == 50_000 and got.filter("rowNum % 2 = 1").isEmpty()
    assert len(writes) <= 30  # a round of settling writes twice, one of labelling once


def test_chain_of_duplicates(spark):
    rows = [(1, "A", "1", "Kent"), (2, "A", "2", "Kent"), (3, "B", "2", "Kent"), (4, "", "9", "Kent"), (5, "known", "7", "Kent"), (6, "new", "77", "Kent")]
    batch = spark.createDataFrame(rows, "rowNum int, name string, urn string, la string")
    base = spark.createDataFrame([("e1", "Known", "5"), ("e2", "other", "77")], "id string, name string, urn string")
    got = {r["rowNum"]: (r["state"], r["existingId"]) for r in link.triage(batch, base).collect()}
    assert got == {1: ("verified", None), 2: ("duplicate", None), 3: ("verified", None), 4: ("invalid", None), 5: ("duplicate", "e1"), 6: ("duplicate", "e2")}


def test_grid_join_equals_all_pairs(spark):
    r = random.Random(1)
    pts = lambda p, n: [(f"{p}{i}", r.randint(0, 40000), r.randint(0, 40000)) for i in range(n)]
    a, b = pts("a", 80), pts("b", 60)
    got = {(x["id"], x["anchor_id"]) for x in nearby.within(spark.createDataFrame(a, "id string, easting int, northing int"), spark.createDataFrame(b, "anchor_id string, easting int, northing int"), 3.0).collect()}
    want = {(i, j) for i, x, y in a for j, u, v in b if round((((x - u) ** 2 + (y - v) ** 2) ** 0.5) / 1609.344 + 1e-12, 2) <= 3.0}
    assert got == want


def test_radius_limits(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 1609, 0), ("c", None, None)], "id string, easting int, northing int")
    got = nearby.near_place(df, [(0, 0)], 5).collect()
    assert [(r["id"], r["distanceMiles"]) for r in got] == [("a", 0.0), ("b", 1.0)]
    with pytest.raises(ValueError):
        nearby.nearest_anchor(df, [])


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    delta = spark.createDataFrame([("2", "c"), ("3", "d")], "id string, v string")
    once = changes.upsert(base, delta)
    twice = changes.upsert(once, delta)
    assert sorted(once.collect()) == sorted(twice.collect()) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_rollback_undoes_a_batch(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, v string, n int")
    after = changes.patch_many(base, base.filter("id = '2'").select("id"), {"v": F.lit("z")})
    log = changes.log_changes(base, after, "EDIT", "b1", "me", F.lit(None).cast("timestamp_ntz")).withColumn("id", F.lit(1).cast("bigint"))
    assert log.count() == 1
    back, stamped = changes.roll_back(after, log, ["b1"], F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    assert sorted(back.collect()) == sorted(base.collect())
    assert stamped.first()["rolledBackAt"] == dt.datetime(2026, 1, 1)
    assert changes.restore_states(stamped, ["b1"]).count() == 0


def test_earliest_state_is_restored(spark):
    log = spark.createDataFrame([(2, "b", "1", '{"v":"second"}', None), (1, "b", "1", '{"v":"first"}', None)], "id bigint, batchId string, schoolId string, previousState string, rolledBackAt timestamp_ntz")
    base = spark.createDataFrame([("1", "now", "kept")], "id string, v string, w string")
    assert changes.roll_back(base, log, ["b"], F.lit(None).cast("timestamp_ntz"))[0].collect() == [("1", "first", "kept")]


def test_version_rollback_is_logged(spark):
    base = spark.createDataFrame([("1", "n", "w", "Boys")], "id string, name string, website string, gender string")
    cols = "id bigint, actionType string, batchId string, schoolId string, previousState string, newState string, appliedBy string, appliedAt timestamp_ntz, rolledBackAt timestamp_ntz"
    log = spark.createDataFrame([(5, "EDIT", "b", "1", '{"name":"old","website":""}', "{}", "x", None, None)], cols)
    snap, new_log = changes.roll_back_version(base, log, 5, "1", "me", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    assert snap.collect() == [("1", "old", None, "Mixed")]
    rows = new_log.collect()
    assert len(rows) == 2 and sum(r["actionType"] == "MANUAL_VERSION_ROLLBACK" for r in rows) == 1


def test_merge_keeps_other_columns(spark):
    e = spark.createDataFrame([("1", "A", "123456", "", "x", 10), ("2", "A", "", "020", "y", 5)], "id string, name string, urn string, phone string, extra string, confidence_score int")
    e = e.withColumns({"ofstedRating": F.lit(""), "website": F.lit(""), "address": F.lit(""), "verification_status": F.lit("u")})
    plan = merge.merge_plan(spark.createDataFrame([("1", "2")], "id_a string, id_b string"), e)
    out = merge.merge_records(plan, e, "b", "me", F.lit(None).cast("timestamp_ntz"))
    row = out["entities"].first()
    assert out["entities"].count() == 1 and (row["id"], row["phone"], row["extra"], row["confidence_score"]) == ("1", "020", "x", 98)
    assert {r["schoolId"] for r in out["log"].collect()} == {"1", "2"}


def test_guard_keeps_both_tags(spark):
    df = full(spark, dict(RICH, d={"registrationDeadline": "1 October 2026", "examDate": "1 September 2024"}))
    df = df.withColumns({"verification_tags": F.array().cast("array<string>"), "verification_status": F.lit("verified"), "verified_at": F.lit("2026-01-01")})
    r = quality.guard(df).first()
    assert r["verification_tags"] == ["has_anomalies", "stale_dates_pending_recrawl"] and r["verification_status"] == "unverified" and r["verified_at"] is None


def test_single_sex_needs_proof(spark):
    base = full(spark, RICH).withColumns({"verification_tags": F.array().cast("array<string>"), "verification_status": F.lit("u"), "verified_at": F.lit(None).cast("string"), "confidence_score": F.lit(50)})
    for c in ("a_level_rank_england",):
        base = base.withColumn(c, F.lit(None).cast("int"))

    def apply(text):
        p = quality.read_payload(spark.createDataFrame([("1", text)], "id string, payload string"), "payload")
        return quality.apply_payload(base, p, "2026-01-01").first()

    assert apply('{"gender":"Mixed","confidenceScore":90,"website":"https://a.sch.uk"}')["gender"] == "Boys"
    r = apply('{"gender":"Mixed","confidenceScore":96,"website":"https://a.sch.uk"}')
    assert r["gender"] == "Mixed" and "gender" in r["updated"] and "llm_enriched" in r["verification_tags"]
    r = apply('{"gender":"Boys","website":"https://a.sch.uk/"}')
    assert r["gender"] == "Boys"


def test_two_stage_rows(spark):
    df = full(spark, dict(RICH, entranceExamType="Sutton SET Two-Stage")).withColumns({"stage_two_format_and_subjects": F.lit("English essay")})
    df = df.withColumns({"admissionsPolicy": F.lit(""), "rawSchoolType": F.lit("")})
    rows = enrich.stages(enrich.classify(df)).orderBy("stage_number").collect()
    assert [(r["stage_number"], r["is_sifting"]) for r in rows] == [(1, True), (2, False)] and rows[0]["consortium"] == "SUTTON_SET"
    assert seeds.stages_with_names(enrich.stages(enrich.classify(df))).count() == 2


def test_ranks_keep_top_rows(spark):
    rows = [(f"e{i:03d}", f"n{i}", "Grammar" if i % 2 else "Comprehensive", "Outstanding", "11-18", 300, float(40 + i), 0.6, i if i < 5 else None, None, 150 if i == 30 else None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id string, name string, schoolType string, ofstedRating string, ageRange string, pupilCount int, gcseAttainment8 double, gcseProgress8 double, gcse_rank_england int, a_level_rank_england int, national_rank_england int").withColumn("postcode", F.lit(""))
    out = {r["id"]: r for r in ranking.sync_ranks(df, max_rank=120).collect()}
    assert out["e003"]["gcse_rank_england"] == 3 and out["e003"]["national_rank_england"] is None
    got = sorted(r["national_rank_england"] for r in out.values() if r["national_rank_england"])
    assert got == list(range(101, 121))
    nums = [r["n"] for r in ranking.numbered(df, ["name", "id"], "n").orderBy("name", "id").collect()]
    assert nums == list(range(1, 60))


def test_search_prefix_and_index(spark):
    df = spark.createDataFrame([("1", "Schools of Kent testing"), ("2", "kentish school"), ("3", "test")], "id string, name string")
    assert [r["id"] for r in search.search(df, "school ken", columns=["name"]).collect()] == ["1", "2"]
    index = search.token_table(df, "id", ["name"])
    assert [r["id"] for r in search.search_index(index, "School ken").collect()] == ["1", "2"]
    assert search.search(df, "  ", columns=["name"]).count() == 0


def test_typeahead(spark):
    df = spark.createDataFrame([("1", "Barnet", "EN5 4DQ", "Greater London"), ("2", "Enfield", "EN1 1AA", "")], "id string, la string, postcode string, region string")
    got = [r["name"] for r in search.suggest(search.location_index(df), "en").collect()]
    # names that start with the text come first, by kind; "Barnet (Greater London)" holds it nowhere
    assert got[:3] == ["Enfield", "EN1", "EN5"] and "Camden" in got and "Barnet" not in got and len(got) == 10


def test_round_trips(spark, tmp_path):
    s = full(spark, dict(RICH, name='A "quoted", name', address="1 Road\tX"), POOR)
    writers.write_csv(s, str(tmp_path / "c"))
    back = {r["ID"]: r for r in spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"').collect()}
    assert back["1"]["School Name"] == 'A "quoted", name' and back["1"]["Exam Date"] == "1 Sept 2026" and len(back["1"]) == 25
    writers.write_tsv(s, str(tmp_path / "t"))
    assert "1 Road X" in "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    with pytest.raises(Exception):
        writers.write_domains({"x": ("d", s.withColumn("id", F.raise_error(F.lit("boom"))))}, str(tmp_path / "d"))
    assert readers.rules(spark, str(tmp_path / "none.json")) == ([], [])
    assert writers.read_scan(spark, str(tmp_path / "none"), "x") is None


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text('URN,"LA (name)",Postcode,Easting,Northing\n1,"Kent, East", en5  4dq ,530000.4,180000.6\n2,,X,0,0\n')
    assert readers.coordinates_csv(spark, str(tmp_path / "e.csv")).collect() == [("EN5 4DQ", "EN5", 530000, 180001, "Kent, East")]
    line = ["1", "Kent", "", "", "", '"Hall, The"', "1 Road", "", "", "Town", "EN5 4DQ", "Open", "", "", "", "Academy", "", "", "", "11", "18", "Boys", "", "Selective"]
    (tmp_path / "r.csv").write_text(",".join(f"h{i}" for i in range(24)) + "\n" + ",".join(line) + "\n")
    r = readers.register_records(readers.register_by_position(spark, str(tmp_path / "r.csv"))).first()
    assert (r["name"], r["address"], r["schoolType"], r["ageRange"], r["active"]) == ("Hall, The", "1 Road, Town, EN5 4DQ", "Grammar", "11-18", True)
    (tmp_path / "m.json").write_text('{"state_consortia": [{"id": "a", "examType": "X", "dates": {"examDate": "1 May", "secondExamDate": null}, "laList": ["Kent"], "schoolKeywords": ["oak"]}], "independent_consortia": []}')
    state, ind = readers.rules(spark, str(tmp_path / "m.json"))
    assert state[0]["dates"]["examDate"] == "1 May" and ind == []
    (tmp_path / "o.json").write_text('{"EN5": {"outcode": "EN5", "lat": 51.6, "lon": -0.2, "easting": 524000, "northing": 196000, "district": "Barnet"}}')
    assert readers.outcode_map(spark, str(tmp_path / "o.json")).first()["district"] == "Barnet"


def test_due_queue(spark):
    df = spark.createDataFrame([("a", "2026-09-10T00:00:00Z"), ("b", "2026-09-01T00:00:00Z"), ("c", None)], "id string, verified_at string")
    df = df.withColumns({"verification_status": F.lit("verified"), "verification_tags": F.array().cast("array<string>")})
    at = dt.datetime(2026, 9, 15)
    assert {r["id"] for r in df.filter(filters.due(at)).collect()} == {"b", "c"}
    assert {r["id"] for r in df.filter(filters.due(at, 0)).collect()} == {"a", "b", "c"}


def test_hydrate_defaults(spark):
    df = spark.createDataFrame([("1", "X Grammar", None, "", "12 pupils", None, None)], "id string, name string, urn string, schoolType string, pupilCount string, official boolean, verification_tags string").withColumn("ofstedRating", F.lit(None).cast("string"))
    r = records.hydrate(df).first()
    assert (r["urn"], r["schoolType"], r["pupilCount"], r["official"], r["verification_tags"], r["compareSchoolPerformanceUrl"]) == ("", "Grammar", 12, True, [], None)
