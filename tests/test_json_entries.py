"""JSON documents read by pieces, against the json module."""

import json
import random

import pytest

from dirwise.sources import json_entries as j
from dirwise.sources import readers

NASTY = ['}{', 'a "quoted" }', "back\\slash}", "\\", "é日}", '","b":{', "plain", ""]


def document(r, n, kind):
    entry = lambda: {"id": r.choice(NASTY), "deep": {"x": r.choice(NASTY), "list": [{"y": 1}, {}]}, "n": r.randint(0, 9)}
    if kind == "object":
        return {f"k{i} {r.choice(NASTY)}": entry() for i in range(n)}
    return [entry() for _ in range(n)] if kind == "array" else {"state_consortia": [entry() for _ in range(n)], "independent_consortia": [entry() for _ in range(n // 2)]}


@pytest.mark.parametrize("kind", ["object", "array", "parts"])
@pytest.mark.parametrize("indent", [None, 2])
def test_entries_match_the_json_module_in_any_split(spark, tmp_path, kind, indent):
    """Splits of a few hundred bytes begin inside strings, entries and keys."""
    docs = {f"d{i}.json": document(random.Random(i), n, kind) for i, n in enumerate([60, 1, 7, 0])}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(indent)) + ("\n" if indent else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = j.json_entries(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, doc in docs.items():
        got = [json.loads(r["value"]) for r in sorted((r for r in rows if r["file"].endswith(name)), key=lambda r: r["ordinal"])]
        assert got == (list(doc.values()) if kind == "object" else doc if kind == "array" else [*doc["state_consortia"], *doc["independent_consortia"]])


def test_a_large_rule_file_is_read_in_many_tasks(spark, tmp_path):
    rules = [{"id": f"r{i}", "name": NASTY[i % len(NASTY)], "dates": {"examDate": "1 May", "other": None}, "schoolKeywords": ["oak"]} for i in range(100_000)]
    (tmp_path / "m.json").write_text(json.dumps({"state_consortia": rules, "independent_consortia": rules[:3]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert j._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        got = readers.rule_table(spark, str(tmp_path)).select("ordinal", "id", "name", "dates").orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["ordinal"], r["id"], r["name"]) for r in got] == [(i, x["id"], x["name"]) for i, x in enumerate(rules)] and got[0]["dates"] == {"examDate": "1 May", "other": None}
    assert [r["id"] for r in readers.rule_table(spark, str(tmp_path), "independent_consortia").orderBy("ordinal").collect()] == ["r0", "r1", "r2"]


@pytest.mark.parametrize("text", ['{"a": {"b": 1}', '{"a": {"b": "x}}', '{"a": {"b": 1}} and more {}', '[{"a": 1}, {"b"'])
def test_damaged_documents_are_refused(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="does not end|after the end"):
        j.json_entries(spark, str(tmp_path)).collect()
