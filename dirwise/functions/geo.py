"""Distances and the conversion between national grid and latitude/longitude.

The grid conversion uses the Airy 1830 ellipsoid without a datum shift, so its
angles differ from WGS84 ones by about a hundred metres on the ground.
"""

from __future__ import annotations

from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirwise.functions.values import bind, col, round_half_up

# Earth radii and metres per mile.
EARTH_MILES, EARTH_KM, METRES_PER_MILE = 3958.7613, 6371.0088, 1609.344

# Airy 1830 ellipsoid and the national grid's true origin.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
SCALE = 0.9996012717
ORIGIN_LAT, ORIGIN_LON = radians(49), radians(-2)
FALSE_N, FALSE_E = -100000.0, 400000.0
E2 = 1 - AIRY_B**2 / AIRY_A**2
THIRD = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_MILES) -> Column:
    lat1, lon1, lat2, lon2 = (col(x) for x in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)
    )
    return F.round(F.lit(2 * radius) * F.atan2(F.sqrt(half), F.sqrt(1 - half)), 2)


def grid_metres(e1, n1, e2, n2) -> Column:
    """Unrounded straight-line distance on the grid."""
    # squares of whole numbers outgrow an int; as doubles they are exact up to 2**53
    dx, dy = (col(e2) - col(e1)).cast("double"), (col(n2) - col(n1)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def grid_miles(e1, n1, e2, n2) -> Column:
    return F.round(grid_metres(e1, n1, e2, n2) / METRES_PER_MILE, 2)


def grid_km(e1, n1, e2, n2) -> Column:
    return F.round(grid_metres(e1, n1, e2, n2) / 1000, 2)


def _arc(lat: Column) -> Column:
    """Meridian arc from the true origin to a latitude (radians)."""
    n, n2, n3 = THIRD, THIRD**2, THIRD**3
    d, s = lat - ORIGIN_LAT, lat + ORIGIN_LAT
    return (AIRY_B * SCALE) * (
        (1 + n + 1.25 * n2 + 1.25 * n3) * d
        - (3 * n + 3 * n2 + 2.625 * n3) * F.sin(d) * F.cos(s)
        + (1.875 * n2 + 1.875 * n3) * F.sin(2 * d) * F.cos(2 * s)
        - (35 / 24 * n3) * F.sin(3 * d) * F.cos(3 * s)
    )


def _radii(lat: Column) -> Column:
    w = 1 - E2 * F.pow(F.sin(lat), F.lit(2))
    nu = AIRY_A * SCALE / F.sqrt(w)
    rho = AIRY_A * SCALE * (1 - E2) / F.pow(w, F.lit(1.5))
    return F.struct(nu.alias("nu"), rho.alias("rho"), (nu / rho - 1).alias("eta2"), F.tan(lat).alias("t"), lat.alias("lat"))


def grid_to_latlon(easting, northing, rounds: int = 10) -> Column:
    """struct(lat, lon) in degrees, six decimals.

    The footpoint latitude converges to well below a millimetre within ten
    corrections everywhere on the grid.
    """
    e, n = col(easting).cast("double"), col(northing).cast("double")
    foot = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        (n - FALSE_N) / (AIRY_A * SCALE) + ORIGIN_LAT,
        lambda lat, _: lat + (n - FALSE_N - _arc(lat)) / (AIRY_A * SCALE),
    )

    def series(r: Column) -> Column:
        nu, rho, eta2, t, lat = (r[k] for k in ("nu", "rho", "eta2", "t", "lat"))
        x = (e - FALSE_E) / nu
        sec = 1 / F.cos(lat)
        t2 = t * t
        t4 = t2 * t2
        out_lat = lat - t * nu / rho * (
            F.pow(x, F.lit(2)) / 2
            - F.pow(x, F.lit(4)) / 24 * (5 + 3 * t2 + eta2 - 9 * t2 * eta2)
            + F.pow(x, F.lit(6)) / 720 * (61 + 90 * t2 + 45 * t4)
        )
        out_lon = ORIGIN_LON + sec * (
            x - F.pow(x, F.lit(3)) / 6 * (nu / rho + 2 * t2) + F.pow(x, F.lit(5)) / 120 * (5 + 28 * t2 + 24 * t4)
        )
        return F.struct(F.round(F.degrees(out_lat), 6).alias("lat"), F.round(F.degrees(out_lon), 6).alias("lon"))

    return bind(bind(foot, _radii), series)


def latlon_to_grid(lat, lon) -> Column:
    """struct(easting, northing) in whole metres."""
    lam = F.radians(col(lon)) - ORIGIN_LON

    def series(r: Column) -> Column:
        nu, rho, eta2, t, phi = (r[k] for k in ("nu", "rho", "eta2", "t", "lat"))
        t2 = t * t
        t4 = t2 * t2
        c = F.cos(phi) * lam
        north = _arc(phi) + FALSE_N + nu * t * (
            F.pow(c, F.lit(2)) / 2
            + F.pow(c, F.lit(4)) / 24 * (5 - t2 + 9 * eta2)
            + F.pow(c, F.lit(6)) / 720 * (61 - 58 * t2 + t4)
        )
        east = FALSE_E + nu * (
            c + F.pow(c, F.lit(3)) / 6 * (nu / rho - t2)
            + F.pow(c, F.lit(5)) / 120 * (5 - 18 * t2 + t4 + 14 * eta2 - 58 * t2 * eta2)
        )
        return F.struct(round_half_up(east).alias("easting"), round_half_up(north).alias("northing"))

    return bind(_radii(F.radians(col(lat))), series)
