"""Counts, coverage and statistics over a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.values import filled, or_null, present, round_half_up, text, up_to
from dirwise.operators import filters as f


def count_if(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, 0 where there is nothing."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0).cast("bigint"))


def overview(df: DataFrame) -> DataFrame:
    t = text("schoolType")
    return df.agg(
        F.count("*").alias("total"), count_if(t.contains("Grammar"), "grammar"), count_if(t.contains("Independent"), "independent"),
        count_if(t.contains("Comprehensive"), "comprehensive"), count_if(F.lower(text("ofstedRating")) == "outstanding", "outstanding"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value) of every value in use, one row each, so no list has to fit one task."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("s")).select("s.*")
    return long.filter(filled("value")).distinct()


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(F.coalesce(or_null(by), F.lit("Unknown")).alias(by)).agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, by: str, limit: int | None = 10) -> DataFrame:
    return up_to(df.filter(filled(by)).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by), limit)


def coverage(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(field, filled, blank, percentage) for each named condition, in one pass."""
    names = list(conditions)
    one = df.agg(F.count("*").alias("total"), *[F.count_if(~c).alias(f"blank_{n}") for n, c in conditions.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"blank_{n}").alias("blank")) for n in names])
    long = one.select("total", F.explode(rows).alias("r"))
    have = F.col("total") - F.col("r.blank")
    return long.select(F.col("r.field").alias("field"), have.alias("filled"), F.col("r.blank").alias("blank"),
                       percent(have, F.col("total")).alias("percentage"))


def missing_counts(df: DataFrame) -> DataFrame:
    cols = {"missing_rating": "ofstedRating", "missing_website": "website", "missing_phone": "phone", "missing_key": "urn"}
    one = df.agg(F.count("*").alias("total"), *[count_if(~present(c), n) for n, c in cols.items()])
    return one.withColumn("coverage_rate", percent(F.col("total") - F.col("missing_rating"), F.col("total")))


def category_statistics(df: DataFrame) -> DataFrame:
    """(dimension, value, total, enriched, unscanned) by type, region, second stage, fee and overall, in one pass."""
    t = text("schoolType")
    kind = F.when(t.contains("Grammar"), "Grammar").when(t.contains("Independent"), "Independent").otherwise("Comprehensive")
    stage = F.when((text("second_stage_exam_required") == "Yes") | f.two_stage(), "yes").otherwise("no")
    fee = F.when(t.contains("Independent") | filled("feesTermly"), "independent").otherwise("state")
    done = f.tagged("llm_enriched", "llm_verified", "auto_verified", "web_verified") | filled("verified_at") | text(
        "verification_status").isin("llm_enriched", "auto_verified", "verified")
    base = df.select(
        kind.alias("type"), F.coalesce(or_null("region"), F.lit("Other")).alias("region"), stage.alias("second_stage"), fee.alias("fee"),
        done.alias("done"))
    dims = ["type", "region", "second_stage", "fee"]
    sets = base.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims])
    out = sets.agg(*[F.grouping(d).alias(f"g_{d}") for d in dims], F.count("*").alias("total"), count_if(F.col("done"), "enriched"))
    dim, value = F.lit("all"), F.lit("all")
    for d in dims:
        dim = F.when(F.col(f"g_{d}") == 0, d).otherwise(dim)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return out.select(dim.alias("dimension"), value.alias("value"), "total", "enriched", (F.col("total") - F.col("enriched")).alias("unscanned"))


def enrichment_totals(df: DataFrame) -> DataFrame:
    problem = F.exists(F.coalesce(F.col(f.TAGS), F.array().cast("array<string>")), lambda t: t.rlike("mismatch|dead|missing|error|stuck|anomal"))
    return df.agg(
        F.count("*").alias("total"), count_if(f.is_enriched(), "llm_enriched"), count_if(f.tagged(*f.CURRENT_TAGS), "dates_verified"),
        count_if(problem | (text("verification_status") == "anomaly_flagged"), "anomalies"))


def score_histogram(df: DataFrame, score: str = "completeness_score") -> DataFrame:
    s = F.coalesce(score, F.lit(0))
    return df.agg(
        count_if(s >= 80, "excellent"), count_if((s >= 60) & (s < 80), "good"), count_if((s >= 40) & (s < 60), "fair"),
        count_if(s < 40, "poor"), F.coalesce(round_half_up(F.avg(s)), F.lit(0)).alias("average"), F.count("*").alias("total"))


def website_counters(df: DataFrame) -> DataFrame:
    states = ("registered", "unscanned", "healthy", "https", "http", "dead")
    return df.agg(F.count("*").alias("total"), *[count_if(f.website_state(s), s) for s in states])


def guardrail_counters(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), count_if(f.tagged("stale_dates_pending_recrawl"), "stale"), count_if(f.tagged("has_anomalies"), "anomaly"))


def flagged(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """First flagged rows of the guardrail report."""
    stale, odd = f.tagged("stale_dates_pending_recrawl"), f.tagged("has_anomalies")
    return up_to(df.filter(stale | odd).select("id", "name", "schoolType", "region", stale.alias("isStale"), odd.alias("isAnomaly")).orderBy("id"), limit)


def rank_coverage(df: DataFrame, max_rank: int = 500) -> DataFrame:
    cols = {"gcse": "gcse_rank_england", "alevel": "a_level_rank_england", "national": "national_rank_england"}
    return df.agg(
        F.count("*").alias("total"), *[count_if(F.col(c) <= 100, f"top100_{n}") for n, c in cols.items()],
        *[count_if(F.col(c) <= max_rank, f"ranked_{n}") for n, c in cols.items()])


def tag_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(f.TAGS).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def scan_outcomes(df: DataFrame, anomalies: Column) -> DataFrame:
    return df.agg(
        count_if(f.tagged("auto_verified", "llm_enriched"), "verified"), count_if(anomalies, "anomalies"),
        count_if(f.tagged("missing_website", "dead_website"), "missing_websites"),
        count_if(f.tagged("auto_verification_data_missing"), "data_missing"), count_if(f.tagged("crawl_stuck"), "stuck"))


def verification_summary(df: DataFrame) -> DataFrame:
    """Verified, anomalous, without website, without data, and mean confidence."""
    return df.agg(
        F.count("*").alias("total"), count_if(f.tagged("auto_verified", "web_verified", "llm_verified"), "verified"),
        count_if(f.tagged(*f.PROBLEM_TAGS, "has_anomalies"), "anomalies"), count_if(f.tagged("missing_website", "dead_website"), "missing_websites"),
        count_if(f.tagged("auto_verification_data_missing"), "data_missing"),
        F.coalesce(round_half_up(F.avg(F.coalesce("confidence_score", F.lit(0)))), F.lit(0)).alias("mean_quality"))


def key_check(df: DataFrame, key: str = "id", by: str = "schoolType") -> DataFrame:
    """Rows, distinct keys, and rows per class."""
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"),
        *[count_if(F.col(by) == c, c.lower()) for c in ("Grammar", "Independent", "Comprehensive")])


def same_row_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, before, after, same) for tables that were copied."""
    rows = None
    for side, tables in (("before", before), ("after", after)):
        for name, df in tables.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "n")
            rows = one if rows is None else rows.unionByName(one)
    n = lambda side: F.max(F.when(F.col("side") == side, F.col("n")))
    out = rows.groupBy("table").agg(n("before").alias("before"), n("after").alias("after"))
    return out.withColumn("same", F.col("before") == F.col("after"))


# ---- votes and reports -------------------------------------------------------------------------

# Start, steps, bounds and level limits of a field's confidence.
BASE, UP, DOWN, LOWEST, HIGHEST, HIGH_FROM, LOW_BELOW = 60, 5, 10, 15, 98, 85, 60


def vote_sums(votes: DataFrame) -> DataFrame:
    return votes.groupBy("schoolId", "fieldName").agg(
        F.count_if(F.col("vote") > 0).alias("upvotes"), F.count_if(F.col("vote") < 0).alias("downvotes"))


def field_confidence(votes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(schoolId, fieldName, score, level, isAdminVerified, label, upvotes, downvotes).

    votes: one current vote per user and field. An admin review settles a field at 100.
    """
    r = reviews.select("schoolId", "fieldName").distinct().withColumn("reviewed", F.lit(True))
    both = vote_sums(votes).join(r, ["schoolId", "fieldName"], "full")
    up, down = F.coalesce("upvotes", F.lit(0)), F.coalesce("downvotes", F.lit(0))
    admin = F.coalesce("reviewed", F.lit(False))
    voted = F.greatest(F.least(F.lit(BASE) + up * UP - down * DOWN, F.lit(HIGHEST)), F.lit(LOWEST))
    score = F.when(admin, 100).otherwise(voted).cast("bigint")
    level = F.when(score >= HIGH_FROM, "High").when(score < LOW_BELOW, "Low").otherwise("Medium")
    label = F.when(admin, "Admin Verified").otherwise(F.concat(score.cast("string"), F.lit("% Confidence")))
    return both.select("schoolId", "fieldName", score.alias("score"), level.alias("level"), admin.alias("isAdminVerified"),
                       label.alias("label"), up.alias("upvotes"), down.alias("downvotes"))


def report_rollup(reports: DataFrame, entities: DataFrame) -> DataFrame:
    """Open error reports with their entity's name and counts per entity and field.

    One row per report in reading order: most reported entity first, then most
    reported field, newest first. Counts are joined on, so a heavily reported
    entity is never gathered in one task.
    """
    down = reports.filter(F.col("status") == "down")
    per_field = down.groupBy("schoolId", "fieldName").agg(F.count("*").alias("fieldErrorCount"))
    per_entity = per_field.groupBy("schoolId").agg(F.sum("fieldErrorCount").alias("totalErrorCount"))
    names = entities.select(F.col("id").alias("schoolId"), F.col("name").alias("schoolName"), F.col("urn").alias("schoolUrn"))
    return (
        down.join(per_field, ["schoolId", "fieldName"]).join(per_entity, "schoolId").join(names, "schoolId", "left")
        .withColumn("schoolName", F.coalesce(or_null("schoolName"), F.col("schoolId")))
        .withColumn("schoolUrn", F.coalesce(or_null("schoolUrn"), F.lit("N/A")))
    )


def user_overrides(reports: DataFrame, user_id) -> DataFrame:
    """One user's own reports as maps per entity: status and custom values of each field."""
    mine = reports.filter(F.col("userId") == user_id)
    entry = lambda v: F.struct(F.col("fieldName"), v)
    custom = F.when((F.col("status") == "down") & filled("customValue"), F.struct("fieldName", "customValue"))
    return mine.groupBy("schoolId").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry(F.col("status"))))).alias("userReports"),
        F.map_from_entries(F.sort_array(F.collect_list(custom))).alias("userCustomOverrides"))
