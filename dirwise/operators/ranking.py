"""League ranks, numbering and latest-row choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirwise.functions.values import lenient_float, or_null, text, up_to
from dirwise.session import saved


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Consecutive numbers over a whole table, ordered by columns that identify a row.

    The table is cut into ranges of that order and saved; each range is
    numbered by itself and shifted by the rows before it, so no task sees all.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = saved(df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))  # at most one row per task
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = cut.join(F.broadcast(shift), "_range")
    n = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before") + (first - 1)
    return rows.withColumn(name, n.cast("bigint")).drop("_range", "_before")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the given columns; partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


RANKS = ("gcse_rank_england", "a_level_rank_england", "national_rank_england")
KEPT_RANK = 100


def holds_top_rank(top: int = KEPT_RANK) -> Column:
    best = F.least(*[F.coalesce(F.col(c), F.lit(top + 1)) for c in RANKS])
    return best <= top


def _tiered(df: DataFrame) -> DataFrame:
    """Candidates with their tier and the sort values of that tier."""
    rating, t = text("ofstedRating"), text("schoolType")
    pupils = F.coalesce("pupilCount", F.lit(0))
    attainment, progress = lenient_float("gcseAttainment8"), lenient_float("gcseProgress8")
    grammar = F.lower(t).contains("grammar")
    independent = (t == "Independent") & (text("ageRange").contains("18") | text("ageRange").contains("16") | (pupils >= 200))
    state = (t == "Comprehensive") & F.coalesce((rating == "Outstanding") | (attainment >= 55.0) | (progress >= 0.5), rating == "Outstanding")
    tier = F.when(grammar, 1).when(independent, 2).when(state, 3)
    rated = F.when(F.lower(rating).contains("excellent"), 3.0).when(rating == "Outstanding", 2.0).otherwise(1.0)
    first = (
        F.when(tier == 1, F.coalesce(attainment, F.lit(70.0))).when(tier == 2, rated)
        .otherwise(F.coalesce(attainment, F.when(rating == "Outstanding", 65.0).otherwise(55.0)))
    )
    second = F.when(tier == 1, F.lit(0)).otherwise(pupils)
    return df.filter(~holds_top_rank()).withColumns({"tier": tier, "_first": first, "_second": second}).filter("tier is not null")


def allocate_ranks(df: DataFrame, max_rank: int = 500, jitter: bool = False) -> DataFrame:
    """(id, tier and the three ranks) of the rows that get ranks 101 to ``max_rank``.

    Grammar before independent before strong state rows, each tier by its own
    measure, then name and id. With ``jitter`` the two stage ranks move by up
    to two places around the national one.
    """
    slots = max_rank - KEPT_RANK
    best = _tiered(df).select("id", "name", "tier", "_first", "_second").orderBy("tier", F.desc("_first"), F.desc("_second"), "name", "id").limit(slots)
    # the window sorts no more rows than there are slots
    rank = F.row_number().over(Window.orderBy("tier", F.desc("_first"), F.desc("_second"), "name", "id")) + KEPT_RANK
    out = best.select("id", "tier", rank.alias("national_rank_england"))
    r = F.col("national_rank_england")
    shift = r % 5 - 2 if jitter else F.lit(0)
    bound = lambda x: F.least(F.lit(max_rank), F.greatest(F.lit(KEPT_RANK + 1), x))
    return out.withColumns({"gcse_rank_england": bound(r + shift), "a_level_rank_england": bound(r - shift)})


def sync_ranks(df: DataFrame, max_rank: int = 500, jitter: bool = False) -> DataFrame:
    """All rows with their ranks renewed: rows holding a rank up to 100 keep theirs untouched."""
    new = allocate_ranks(df, max_rank, jitter).select("id", *[F.col(c).alias(f"_n_{c}") for c in RANKS])
    high = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in RANKS]) > KEPT_RANK
    keep = holds_top_rank()
    out = df.join(new, "id", "left")
    for c in RANKS:
        out = out.withColumn(f"_k_{c}", F.when(keep, F.col(c)).when(F.col(f"_n_{c}").isNotNull(), F.col(f"_n_{c}")).when(~high, F.col(c)))
    return out.select(*[F.col(f"_k_{c}").cast("int").alias(c) if c in RANKS else F.col(c) for c in df.columns])


def top_ranked(df: DataFrame, by: str, limit: int | None = 10) -> DataFrame:
    return up_to(df.filter(F.col(by).isNotNull()).select("id", "name", "postcode", "schoolType", *RANKS).orderBy(by, "id"), limit)


def current_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per natural key (see latest)."""
    return latest(rows, keys, order)


def dictionary(df: DataFrame, code: str) -> DataFrame:
    """Distinct codes with a dense number in code order."""
    codes = df.filter(or_null(code).isNotNull()).select(F.col(code).alias("code")).distinct()
    return numbered(codes, ["code"], "code_id")
