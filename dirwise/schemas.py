"""Declared schemas, so that no reader has to guess types. All are DDL texts."""

from __future__ import annotations

REGISTER = (
    "URN string, SCHNAME string, LANAME string, STREET string, LOCALITY string, ADDRESS3 string, TOWN string, POSTCODE string, "
    "SCHSTATUS string, ISSECONDARY string, SCHOOLTYPE string, MINORGROUP string, ADMPOL string, RELCHAR string, GENDER string, "
    "AGELOW string, AGEHIGH string")

# Columns of the register file by position, where no header can be relied on.
REGISTER_POSITIONS = {
    "URN": 0, "LANAME": 1, "SCHNAME": 5, "STREET": 6, "LOCALITY": 7, "TOWN": 9, "POSTCODE": 10, "SCHSTATUS": 11, "CLOSEDATE": 13,
    "SCHOOLTYPE": 15, "AGELOW": 19, "AGEHIGH": 20, "GENDER": 21, "ADMPOL": 23,
}

VOTES = ("userId bigint, schoolId string, fieldName string, vote int, votedAt timestamp_ntz, event_id bigint")

REPORTS = (
    "userId bigint, schoolId string, fieldName string, status string, originalValue string, customValue string, reportedAt timestamp_ntz")

AUDIT = (
    "id bigint, actionType string, batchId string, schoolId string, previousState string, newState string, appliedBy string, "
    "appliedAt timestamp_ntz, rolledBackAt timestamp_ntz")

RULE = (
    "id string, name string, region string, examType string, examFormat string, dates map<string,string>, laList array<string>, "
    "schoolKeywords array<string>")

RULE_MATRIX = "state_consortia array<struct<{0}>>, independent_consortia array<struct<{0}>>".format(
    RULE.replace(" string", ":string").replace(" map", ":map").replace(" array", ":array"))

COORDS = ("outcode string, lat double, lon double, easting double, northing double, district string, sampleSize bigint")

REVIEWED_PAIRS = (
    "pair_id string, school_a_id string, school_b_id string, decision string, reason string, reviewed_by string, reviewed_at timestamp_ntz")
