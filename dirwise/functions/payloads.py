"""Reading JSON that is almost JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirwise.functions.values import text, trim_all


def _valid(s: Column) -> Column:
    return F.try_parse_json(s).isNotNull() & s.rlike(r"[\]}]\s*$")


def repair_steps(c: Column | str) -> list[Column]:
    """Successive readings of a text, from as-given to fully repaired."""
    raw = trim_all(text(c))
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", trim_all(fenced)).otherwise(raw)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    inner = F.when(braces != "", braces).otherwise(body)
    fixed = F.regexp_replace(inner, r"(?s)/\*.*?\*/", "")
    fixed = F.regexp_replace(fixed, r"(^|[^:])//[^\r\n]*", "$1")
    for word, value in (("None", "null"), ("True", "true"), ("False", "false")):
        fixed = F.regexp_replace(fixed, rf"\b{word}\b", value)
    fixed = F.regexp_replace(fixed, r",(\s*[}\]])", "$1")
    fixed = F.regexp_replace(fixed, r"([{,]\s*)'([^'\r\n]+)'\s*:", '$1"$2":')
    flat = F.regexp_replace(fixed, r"[\x00-\x09\x0B-\x1F]+", " ")
    return [raw, body, inner, fixed, flat]


def repaired_json(c: Column | str) -> Column:
    """First reading that is valid JSON, as text; null if none is."""
    out = F.when(F.lit(False), "")
    for step in repair_steps(c):
        out = out.when(_valid(step), step)
    return out


# Lines of a prompt that name the entity it was made for.
OWN_LINES = r"(School Name|URN|Postcode|Website):([^\n]*)\n"


def template_form(c: Column | str) -> Column:
    """A prompt with the values of its entity's own lines blanked."""
    return F.regexp_replace(text(c), OWN_LINES, "$1: {}\n")


def own_values(c: Column | str) -> Column:
    """What ``template_form`` blanks, in order."""
    return F.regexp_extract_all(text(c), F.lit(OWN_LINES), 2)


def template_hash(c: Column | str) -> Column:
    """Key of a prompt's template: the digest of its whole form."""
    return F.sha2(template_form(c), 256)
