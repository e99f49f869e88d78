"""Merging duplicate records: which one stays, what it takes over, what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.sets import pair_key
from dirwise.functions.values import filled, or_null, text
from dirwise.operators.changes import delete, log_changes, patch
from dirwise.operators.records import overlay_map
from dirwise.session import saved

# Points that make a record the one to keep, and the fields a survivor takes over.
SURVIVOR_POINTS = {"urn": 50, "ofstedRating": 20, "website": 10, "phone": 10}
TAKEN_OVER = (
    "urn", "website", "phone", "email", "address", "postcode", "ofstedRating", "schoolType", "gender", "ageRange", "pupilCount",
    "feesTermly", "fees_termly_gbp", "fees_annual_gbp", "entranceExamType", "description", "national_rank_england", "gcseProgress8",
    "gcseAttainment8",
)


def survivor_score() -> Column:
    points = [F.when(filled(c), p).otherwise(0) for c, p in SURVIVOR_POINTS.items()]
    return sum(points[1:], points[0]) + F.coalesce("confidence_score", F.lit(0))


def _empty(c: Column, dtype: str) -> Column:
    """Missing in the sense of the merge: null, '' or the number 0."""
    return c.isNull() | (c == "") if dtype == "string" else c.isNull() | (c == 0)


def merge_plan(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(primary, secondary) of each pair (id_a, id_b): the better record stays, a tie keeps the first."""
    s = entities.select("id", survivor_score().alias("score"))
    a, b = s.select(F.col("id").alias("id_a"), F.col("score").alias("sa")), s.select(F.col("id").alias("id_b"), F.col("score").alias("sb"))
    p = pairs.select("id_a", "id_b").join(a, "id_a").join(b, "id_b")
    keep = F.col("sa") >= F.col("sb")
    return p.select(F.when(keep, F.col("id_a")).otherwise(F.col("id_b")).alias("primary"), F.when(keep, F.col("id_b")).otherwise(F.col("id_a")).alias("secondary"))


def _sides(plan: DataFrame, entities: DataFrame) -> DataFrame:
    cols = entities.columns
    a = entities.select(F.col("id").alias("primary"), F.struct(*cols).alias("a"))
    b = entities.select(F.col("id").alias("secondary"), F.struct(*cols).alias("b"))
    return plan.join(a, "primary").join(b, "secondary")


def blank_filled(plan: DataFrame, entities: DataFrame, note_at: str | None = None) -> DataFrame:
    """Survivors with their empty fields filled from the record they replace; their own milestones win."""
    types = dict(entities.dtypes)

    def value(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in TAKEN_OVER:
            return F.when(_empty(a, types[c]) & ~_empty(b, types[c]), b).otherwise(a)
        if c == "entranceExamDates":
            return overlay_map(b, a)
        return a

    out = _sides(plan, entities)
    rows = out.select(*[value(c).alias(c) for c in entities.columns], F.col("b.name").alias("_bn"), F.col("b.id").alias("_bi"))
    note = F.concat(F.lit("Merged with "), text("_bn"), F.lit(" ("), F.col("_bi"), F.lit(")"), F.lit(f" on {note_at}" if note_at else ""))
    return rows.withColumn("dedupNote", note).drop("_bn", "_bi")


def survivors(plan: DataFrame) -> DataFrame:
    """A plan (primary, secondary) of any shape as one survivor per group: (primary, secondary), each secondary once.

    Pairs that share a record belong together (A-B, B-C: all into A). The
    survivor is the smallest id that no pair gives up, or the smallest id of
    all where every one is given up somewhere. Labels sink along pairs and
    are followed to their own labels, so chains settle in few rounds.
    """
    pairs = plan.filter("primary is not null and secondary is not null and primary <> secondary").select("primary", "secondary").distinct()
    given = pairs.groupBy("secondary").agg(F.lit(True).alias("given")).withColumnRenamed("secondary", "v")
    ends = pairs.select(F.col("primary").alias("v")).union(pairs.select(F.col("secondary").alias("v"))).distinct()
    # kept ids sort before given ones, whatever they are called
    rank = ends.join(given, "v", "left").select("v", F.struct(F.coalesce("given", F.lit(False)).alias("given"), F.col("v").alias("id")).alias("label"))
    both = saved(pairs.select(F.col("primary").alias("v"), F.col("secondary").alias("w")).union(pairs.select(F.col("secondary").alias("v"), F.col("primary").alias("w"))))
    labels = saved(rank)
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("other")), "w").groupBy("v").agg(F.min("other").alias("other"))
        sunk = labels.join(near, "v").select("v", F.least("label", "other").alias("label"))
        far = sunk.select(F.col("v").alias("at"), F.col("label").alias("beyond"))
        followed = sunk.join(far, sunk["label.id"] == far["at"]).select("v", F.least("label", "beyond").alias("label"))
        new = saved(followed)
        moved = new.alias("n").join(labels.alias("o"), "v").filter(F.col("n.label") != F.col("o.label")).limit(1).count()
        labels = new
        if not moved:
            return labels.select(F.col("label.id").alias("primary"), F.col("v").alias("secondary")).filter("primary <> secondary")


def smart_merged(plan: DataFrame, entities: DataFrame, site: str = ".sch.uk") -> DataFrame:
    """Field-by-field best of a survivor and all it replaces, taken in one after the other by id.

    Longest address, own-domain website, usable key and rating, else the first
    that is filled. A survivor may take in any number of records: every field
    is a first or last one under a condition, never a list of records.
    """
    types = dict(entities.dtypes)
    groups = plan.select("primary", F.col("secondary").alias("id"), F.lit(1).alias("turn"))
    groups = groups.unionByName(plan.select("primary", F.col("primary").alias("id"), F.lit(0).alias("turn")).distinct())
    rows = groups.join(entities, "id")
    at = F.struct("turn", "id")

    def first(c: str, when: Column) -> Column:
        return F.min_by(F.when(when, F.col(c)), F.when(when, at))

    def last(c: str, when: Column) -> Column:
        return F.max_by(F.when(when, F.col(c)), F.when(when, at))

    def value(c: str) -> Column:
        own, full, every = F.max(F.when(F.col("turn") == 0, F.col(c))), filled(c), F.lit(True)
        good = full & (F.col(c) != "N/A")
        if c == "urn":
            return F.coalesce(first(c, good), F.max_by(text(c), at))
        if c == "ofstedRating":
            return F.coalesce(first(c, good), last(c, full), own)
        if c == "address":
            return F.coalesce(F.max_by(F.when(full, F.col(c)), F.when(full, F.struct(F.length(c), "turn", "id"))), own)
        if c == "website":
            return F.coalesce(first(c, full & F.col(c).contains(site)), last(c, full), own)
        if types[c] == "string":
            return F.coalesce(first(c, full), F.max_by(F.struct(c), at)[c])
        if types[c].startswith("map"):  # maps have no order: the survivor's own, else any other's
            return F.coalesce(F.first(F.when(F.col("turn") == 0, F.col(c)), ignorenulls=True), F.first(c, ignorenulls=True))
        return first(c, F.col(c).isNotNull() & every)

    out = rows.groupBy("primary").agg(F.count("*").alias("_n"), *[value(c).alias(c) for c in entities.columns if c != "id"])
    return out.filter("_n > 1").select(*[F.col("primary").alias("id") if c == "id" else F.col(c) for c in entities.columns])


def merge_records(plan: DataFrame, entities: DataFrame, batch: str, by: str, as_of: Column, explicit: DataFrame | None = None) -> dict[str, DataFrame]:
    """Carry out a merge plan (primary, secondary), chains and shared records included.

    explicit: (id, columns ..) of survivors whose merged values were edited by
    hand; they win over the computed ones. Returns the new snapshot, the log rows, the id mapping for references
    (see changes.rekey and changes.remap_arrays) and the pairs to mark reviewed.
    """
    asked, plan = plan, saved(survivors(plan).join(entities.select(F.col("id").alias("secondary")), "secondary", "left_semi").join(entities.select(F.col("id").alias("primary")), "primary", "left_semi"))
    fields = ("name", "la", "region") + TAKEN_OVER
    merged = smart_merged(plan, entities.select("id", *[c for c in entities.columns if c in fields]))
    checked = merged.withColumns({"verification_status": F.lit("auto_verified"), "confidence_score": F.lit(98)})
    checked = checked.select(*[c for c in checked.columns if c in entities.columns])
    merged_rows = patch(entities, checked)
    if explicit is not None:
        merged_rows = patch(merged_rows, explicit.join(plan.select(F.col("primary").alias("id")), "id", "left_semi"))
    snapshot = delete(merged_rows, plan.select("secondary"))
    touched = entities.join(plan.select(F.explode(F.array("primary", "secondary")).alias("id")), "id", "left_semi")
    log = log_changes(touched, snapshot.join(plan.select(F.col("primary").alias("id")), "id", "left_semi"), "MERGE", batch, by, as_of)
    return {
        "entities": snapshot,
        "log": log,
        "mapping": plan.select(F.col("secondary").alias("old"), F.col("primary").alias("new")),
        "reviewed": asked.select(pair_key("primary", "secondary", "___").alias("pairKey"), F.col("primary").alias("idA"), F.col("secondary").alias("idB")).distinct(),
    }
