"""Whole texts as templates, repeated keys, chains of merges, rules and places from tables, record pairs."""
import datetime as dt
import random

from pyspark.sql import functions as F

from dirwise.operators import changes, enrich, merge, nearby, resolve


def test_templates_that_differ_late_stay_apart(spark):
    head = "x" * 2000
    texts = [head + "a", head + "b", head + "a", f"URN: 1\nPostcode:AB1\n{head}", f"URN:2\nPostcode: CD2\n{head}", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
    keyed, templates = changes.template_dictionary(rows, "prompt")
    assert sorted(r["uses"] for r in templates.collect()) == [1, 2, 2, 2]
    back = {r["id"]: r["prompt"] for r in changes.restored_texts(keyed, templates, "prompt").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_repeated_keys_count_once(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b2", 3, "z")], "id string, v int, w string")
    delta = spark.createDataFrame([("b", 8, 1), ("b", 9, 2), ("c", 5, 1), ("c", 4, 2), ("c", 4, 2)], "id string, v int, turn int")
    last = {r["id"]: r["v"] for r in changes.upsert(base, delta, order=["turn"]).collect()}
    assert last == {"a": 1, "b": 9, "b2": 3, "c": 4} and changes.upsert(base, delta, order=["turn"]).count() == 4
    got = changes.patch(base, delta, order=["turn"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("b", 9, "y"), ("b2", 3, "z")]
    assert {r["id"]: r["v"] for r in changes.insert_new(base, delta, order=["turn"]).collect()} == {"a": 1, "b": 2, "b2": 3, "c": 5}
    assert changes.insert_new(base, delta, order=["turn"]).count() == 4


def test_pruned_payloads_are_kept_aside(spark):
    log = spark.createDataFrame([(1, '{"note":"abcdef","x":"1"}'), (2, '{"x":"1"}'), (3, None), (4, '{"note":"ab"}')], "id int, p string")
    out, side = changes.prune(log, "p", ["x"], {"note": 3})
    assert {r["id"]: r["p"] for r in out.collect()} == {1: '{"note":"abc..."}', 2: "{}", 3: None, 4: '{"note":"ab"}'}
    assert {r["id"]: r["payload"] for r in side.collect()} == {1: '{"note":"abcdef","x":"1"}', 2: '{"x":"1"}'}


def test_plans_of_any_shape_have_one_survivor(spark):
    rng = random.Random(1)
    chain = [f"c{i:03d}" for i in range(60)]
    plan = list(zip(chain, chain[1:], strict=False)) + [("z", f"s{i}") for i in range(30)] + [("p", "q"), ("r", "q"), ("l1", "l2"), ("l2", "l1"), ("x", "x")]
    rng.shuffle(plan)
    got = {r["secondary"]: r["primary"] for r in merge.survivors(spark.createDataFrame(plan, "primary string, secondary string")).collect()}
    want = {c: "c000" for c in chain[1:]} | {f"s{i}": "z" for i in range(30)} | {"q": "p", "r": "p", "l2": "l1"}
    assert got == want


def test_merged_chain_keeps_references_whole(spark):
    e = spark.createDataFrame([("a", "A", "", None), ("b", "B", "N/A", "020"), ("c", "C", "55", "030"), ("d", "D", "66", None)], "id string, name string, urn string, phone string")
    plan = spark.createDataFrame([("b", "c"), ("a", "b"), ("d", "gone")], "primary string, secondary string")
    out = merge.merge_records(plan, e, "b", "me", F.lit(dt.datetime(2026, 1, 1)))
    assert sorted(map(tuple, out["entities"].collect())) == [("a", "A", "55", "020"), ("d", "D", "66", None)]
    assert sorted(map(tuple, out["mapping"].collect())) == [("b", "a"), ("c", "a")]
    assert out["reviewed"].count() == 3 and {r["schoolId"] for r in out["log"].collect()} == {"a", "b", "c"}


def test_many_rules_and_their_districts(spark):
    words = [(i, f"word{i:05d}x") for i in range(6000)]
    df = spark.createDataFrame([("1", "The Word04999x Hall", "Kent", False), ("2", "Plain", "East Kent", True), ("3", "Plain", "East Kent", False), ("4", "word00007x word00003x", "Kent", True)], "id string, name string, la string, sel boolean")
    table = spark.createDataFrame(words, "ordinal int, word string")
    places = spark.createDataFrame([(5, "Kent"), (9, "Kent")], "ordinal int, word string")
    got = {r["id"]: r["ordinal"] for r in enrich.first_rule_table(df, table, "name", districts=places, selective=F.col("sel")).collect()}
    assert got == {"1": 4999, "2": 5, "4": 3}


def test_nearest_of_many_places(spark):
    rng = random.Random(2)
    point = lambda: (rng.randint(0, 200_000), rng.randint(0, 200_000))
    left, right = [(f"l{i}", *point()) for i in range(120)], [(i, *point()) for i in range(40)]
    got = {r["id"]: r["distanceMiles"] for r in nearby.nearest_of(spark.createDataFrame([*left, ("none", None, None)], "id string, easting int, northing int"), spark.createDataFrame(right, "anchor_id int, easting int, northing int")).collect()}
    want = {i: round(min(((e - a) ** 2 + (n - b) ** 2) ** 0.5 for _, a, b in right) / 1609.344, 2) for i, e, n in left}
    assert got == want
    none = spark.createDataFrame([], "anchor_id int, easting int, northing int")
    assert nearby.nearest_of(spark.createDataFrame(left, "id string, easting int, northing int"), none).count() == 0


def test_record_pairs_are_what_rows_count(spark):
    rng = random.Random(3)
    rows = [(f"e{i:03d}", rng.choice(["Kings School", "Kings", "Queens Hall", "Queen Hall", "Other"]), rng.choice(["AB1 2CD", "AB1 3CD", ""]), rng.choice(["100001", "100002", "", None]), rng.choice(["020 8123 4567", ""]), rng.choice(["Boys", "Girls", "Mixed"]), "Kent", "Grammar", "") for i in range(60)]
    e = spark.createDataFrame(rows, "id string, name string, postcode string, urn string, phone string, gender string, la string, schoolType string, website string")
    done = spark.createDataFrame([("e001", "e000"), ("e002", "e005"), ("e010", "e020")], "id_a string, id_b string")
    for found, pairs in ((resolve.duplicate_candidates, resolve.candidate_record_pairs), (resolve.route_pairs, resolve.routed_record_pairs)):
        counted = found(e, done)
        out = pairs(e, counted, done)
        assert out.count() == counted.agg(F.sum("n_pairs")).first()[0] == out.select("id_a", "id_b").distinct().count()
        assert out.filter("id_a >= id_b").count() == 0
    counted = resolve.fuzzy_pairs(e, reviewed=done)
    out = resolve.fuzzy_record_pairs(e, counted, done)
    assert out.count() == counted.agg(F.sum("n_pairs")).first()[0]
    first = [r["similarity"] for r in resolve.best_first(out, "similarity", 20).collect()]
    assert first == sorted(first, reverse=True) and len(first) == 20
