"""Spherical geometry as columns; angles are in radians unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sph_to_cart(theta: Column, phi: Column, r: Column | None = None) -> Column:
    r = F.lit(1.0) if r is None else r
    return F.struct((r * F.sin(theta) * F.cos(phi)).alias("x"), (r * F.sin(theta) * F.sin(phi)).alias("y"), (r * F.cos(theta)).alias("z"))


def cart_to_sph(x: Column, y: Column, z: Column) -> Column:
    r = F.sqrt(x * x + y * y + z * z)
    return F.struct(r.alias("r"), F.when(r == 0, 0.0).otherwise(F.acos(z / F.when(r == 0, 1.0).otherwise(r))).alias("theta"), F.atan2(y, x).alias("phi"))


def sph_dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def tangent_basis(theta: Column, phi: Column) -> Column:
    """Unit vectors of growing theta and growing phi."""
    along = F.struct((F.cos(theta) * F.cos(phi)).alias("x"), (F.cos(theta) * F.sin(phi)).alias("y"), (-F.sin(theta)).alias("z"))
    return F.struct(along.alias("theta_hat"), F.struct((-F.sin(phi)).alias("x"), F.cos(phi).alias("y"), F.lit(0.0).alias("z")).alias("phi_hat"))


def sphdist(long1: Column, lat1: Column, long2: Column, lat2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((long2 - long1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def sph_to_ground(ha: Column, lat: Column, dec: Column) -> Column:
    """East, north and up of a direction given by hour angle and declination."""
    x = -F.cos(dec) * F.sin(ha)
    y = F.cos(lat) * F.sin(dec) - F.sin(lat) * F.cos(dec) * F.cos(ha)
    z = F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(ha)
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def ground_to_sph(x: Column, y: Column, lat: Column) -> Column:
    """Hour angle and declination of the direction above the horizon with these east and north parts."""
    up = F.sqrt(1 - x * x - y * y)
    south, pole = up * F.cos(lat) - y * F.sin(lat), y * F.cos(lat) + up * F.sin(lat)
    return F.struct((-F.atan2(x, south)).alias("ha"), F.atan2(pole, F.sqrt(south * south + x * x)).alias("dec"))


def projected_distance(ha: Column, lat: Column, dec: Column, x: Column, y: Column, z: Column) -> Column:
    return sph_dot(sph_to_ground(ha, lat, dec), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def rotate_ypr(yaw: Column, pitch: Column, roll: Column, x: Column, y: Column, z: Column) -> Column:
    x1, y1 = x * F.cos(yaw) - y * F.sin(yaw), x * F.sin(yaw) + y * F.cos(yaw)
    y2, z2 = y1 * F.cos(pitch) + z * F.sin(pitch), -y1 * F.sin(pitch) + z * F.cos(pitch)
    return F.struct((x1 * F.cos(roll) - z2 * F.sin(roll)).alias("x"), y2.alias("y"), (x1 * F.sin(roll) + z2 * F.cos(roll)).alias("z"))


def great_circle_points(a: Column, b: Column, n: int) -> Column:
    """An array of n points along the arc between two unit vectors; rows come of exploding it.
    Equal ends give the point n times; opposite ends have no single arc and are an error."""
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sph_dot(a, b)))
    angle = F.when(dot <= -1, F.raise_error(F.lit("no single great circle joins opposite points")).cast("double")).otherwise(F.acos(dot))
    same = F.sin(angle) == 0

    def share(f: Column) -> Column:
        return F.when(same, f).otherwise(F.sin(f * angle) / F.when(same, 1.0).otherwise(F.sin(angle)))

    def point(i: Column) -> Column:
        f = i / F.lit(float(max(n - 1, 1)))
        return F.struct(*[(share(1 - f) * a[c] + share(f) * b[c]).alias(c) for c in "xyz"])

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def norm_vec2(x: Column, y: Column) -> Column:
    """The unit vector in the plane along (x, y); null for the zero vector."""
    r = F.nullif(F.hypot(x, y), F.lit(0.0))
    return F.struct((x / r).alias("x"), (y / r).alias("y"))


def cosine_rule(mu: Column, x1: Column, x2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + 2 * x1 * x2 * (1 - mu))


def cosine_rule_outer(mu: Column, x1: Column, x2: Column) -> Column:
    """The cosine rule for arrays: element [i][j] is the side between x1[i] and x2[j]."""
    return F.transform(x1, lambda a: F.transform(x2, lambda b: cosine_rule(mu, a, b)))
