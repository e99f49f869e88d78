"""Coordinates of postcodes, distances, radius and nearest queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions import geo, names
from dirwise.functions.values import round_half_up, spread_blank
from dirwise.session import saved

EXACT, DISTRICT = "exact_unit", "district_centroid"


def centroids(coords: DataFrame, order: str = "ord") -> DataFrame:
    """Mean grid position per postcode district, with its first named district and sample size."""
    # whole-number sums add up to the same mean in any order
    e, n = F.sum(F.col("easting").cast("decimal(20,0)")), F.sum(F.col("northing").cast("decimal(20,0)"))
    out = coords.groupBy("outcode").agg(
        e.alias("_e"), n.alias("_n"), F.count("*").alias("sampleSize"), F.min_by("admin_district", order).alias("district"))
    mean = lambda c: round_half_up(F.col(c).cast("double") / F.col("sampleSize"))
    out = out.select("outcode", mean("_e").alias("easting"), mean("_n").alias("northing"), "district", "sampleSize")
    return out.withColumn("_at", geo.grid_to_latlon("easting", "northing")).select("*", "_at.lat", "_at.lon").drop("_at")


def locate(df: DataFrame, code: str, coords: DataFrame, districts: DataFrame) -> DataFrame:
    """Rows with the grid position of their postcode: the unit itself, else its district.

    coords: (postcode, outcode, easting, northing). districts: (outcode,
    easting, northing). A district without centroid takes its first known unit.
    Adds easting, northing and precision; rows without any keep nulls.
    """
    first = coords.groupBy("outcode").agg(F.min_by(F.struct("easting", "northing"), "postcode").alias("_s"))
    rows = df.withColumns({"_pc": spread_blank(names.postcode(code), F.monotonically_increasing_id()), "_oc": spread_blank(names.outcode(code), F.monotonically_increasing_id())})
    # one position per postcode and district, the smallest; blank postcodes find none
    units = coords.filter("postcode <> ''").groupBy(F.col("postcode").alias("_pc")).agg(F.min(F.struct("easting", "northing")).alias("_u"))
    areas = districts.filter("outcode <> ''").groupBy(F.col("outcode").alias("_oc")).agg(F.min(F.struct("easting", "northing")).alias("_d"))
    samples = first.select(F.col("outcode").alias("_oc"), "_s")
    out = rows.join(units, "_pc", "left").join(areas, "_oc", "left").join(samples, "_oc", "left")
    pick = lambda f: F.coalesce(F.col(f"_u.{f}"), F.col(f"_d.{f}"), F.col(f"_s.{f}"))
    precision = F.when(F.col("_u").isNotNull(), EXACT).when(F.col("_d").isNotNull() | F.col("_s").isNotNull(), DISTRICT)
    return out.withColumns({"easting": pick("easting"), "northing": pick("northing"), "precision": precision}).drop("_pc", "_oc", "_u", "_d", "_s")


def nearest_anchor(df: DataFrame, anchors: list[tuple[float, float]]) -> DataFrame:
    """Miles and kilometres from each row to the closest of a few given points.

    The points are the places one user typed, so they travel as a literal.
    For tables of points use ``nearest_of``.
    """
    if not anchors:
        raise ValueError("at least one anchor expected")
    points = F.array(*[F.struct(F.lit(float(e)).alias("e"), F.lit(float(n)).alias("n")) for e, n in anchors])
    metres = F.array_min(F.transform(points, lambda p: geo.grid_metres("easting", "northing", p["e"], p["n"])))
    out = df.withColumn("_m", metres)
    return out.withColumns({"distanceMiles": F.round(F.col("_m") / geo.METRES_PER_MILE, 2), "distanceKm": F.round(F.col("_m") / 1000, 2)}).drop("_m")


def near_place(df: DataFrame, anchors, max_miles: float | None = None, limit: int | None = 50) -> DataFrame:
    """Located rows by distance, nearest first; the radius applies to the rounded distance."""
    out = nearest_anchor(df.filter("easting is not null"), anchors)
    if max_miles:
        out = out.filter(F.col("distanceMiles") <= max_miles)
    return out.orderBy("distanceMiles", "id").limit(limit) if limit else out


def within(left: DataFrame, right: DataFrame, miles: float, left_key: str = "id", right_key: str = "anchor_id") -> DataFrame:
    """(left_key, right_key, distanceMiles) of all pairs up to ``miles`` apart.

    Both sides fall into square cells as wide as the radius; a left row looks
    into its own and the eight cells around it, so only near rows are compared.
    """
    # the rounded distance decides, so cells reach half a hundredth of a mile further
    width = (miles + 0.005) * geo.METRES_PER_MILE
    cell = lambda c: F.floor(F.col(c) / width)
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    a = left.select(F.col(left_key), F.col("easting").alias("_e1"), F.col("northing").alias("_n1"), F.explode(steps).alias("_s"))
    a = a.select(left_key, "_e1", "_n1", (cell("_e1") + F.col("_s.x")).alias("_cx"), (cell("_n1") + F.col("_s.y")).alias("_cy"))
    b = right.select(F.col(right_key), F.col("easting").alias("_e2"), F.col("northing").alias("_n2"))
    b = b.select(right_key, "_e2", "_n2", cell("_e2").alias("_cx"), cell("_n2").alias("_cy"))
    out = a.join(b, ["_cx", "_cy"]).withColumn("distanceMiles", geo.grid_miles("_e1", "_n1", "_e2", "_n2"))
    return out.filter(F.col("distanceMiles") <= miles).select(left_key, right_key, "distanceMiles")


def closest_within(left: DataFrame, right: DataFrame, miles: float, left_key: str = "id", right_key: str = "anchor_id") -> DataFrame:
    """The nearest right row of each left row up to ``miles`` away."""
    pairs = within(left, right, miles, left_key, right_key)
    best = pairs.groupBy(left_key).agg(F.min(F.struct("distanceMiles", right_key)).alias("b"))
    return best.select(left_key, f"b.{right_key}", "b.distanceMiles")


def nearest_of(left: DataFrame, right: DataFrame, miles: float = 4.0, left_key: str = "id", right_key: str = "anchor_id") -> DataFrame:
    """The nearest row of a table of any size for each located left row.

    Rings grow: rows that find nothing within a radius look within four times
    that radius, so most rows meet near ones only. Rows without a position, or
    without any right row, are left out.
    """
    open_rows = left.filter("easting is not null and northing is not null").select(left_key, "easting", "northing")
    points = right.filter("easting is not null and northing is not null").select(right_key, "easting", "northing")
    both = open_rows.select("easting", "northing").unionByName(points.select("easting", "northing"))
    span = both.agg(F.max("easting") - F.min("easting") + F.max("northing") - F.min("northing")).first()[0]
    widest = float(span or 0) / geo.METRES_PER_MILE
    out = None
    while True:
        found = saved(closest_within(open_rows, points, miles, left_key, right_key))
        out = found if out is None else out.unionByName(found)
        if miles > widest:
            return out
        open_rows = open_rows.join(found.select(left_key), left_key, "left_anti")
        miles *= 4


def selection_centroid(df: DataFrame) -> DataFrame:
    """Rounded mean position of the located rows of a selection (one row)."""
    return df.filter("easting is not null and easting <> 0 and northing is not null and northing <> 0").agg(
        round_half_up(F.avg("easting")).alias("easting"), round_half_up(F.avg("northing")).alias("northing"), F.count("*").alias("n"))


def text_location(la: Column | str, code: Column | str, address: Column | str, tokens: list[str]) -> Column:
    """First of the location words that district, postcode or address contains; null if none."""
    from dirwise.functions.values import text

    places = [F.lower(text(c)) for c in (la, code, address)]
    out = F.when(F.lit(False), "")
    for t in tokens:
        hit = F.lit(False)
        for p in places:
            hit = hit | p.contains(t.lower())
        out = out.when(hit, t)
    return out
