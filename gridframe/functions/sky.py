"""Sidereal time, precession, nutation, and places of the Sun, the Moon and stars, as columns.

Angles are degrees, times UNIX seconds, distances kilometres.  The series are truncated: the Sun is good
to about 2 seconds of arc, the Moon to about 10, nutation to 0.05; UT1 is taken as UTC.  A place is
astrometric, as an observer sees it without aberration (light-time is in it), unless a name says
apparent; bending of light by the Sun and polar motion are left out.

``let`` works columns out once for an expression that uses them often.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridframe.functions.timescale import bound, era, leap_seconds

J2000, CENTURY_S, TT_TAI_S, FIRST_TAI_S = 946728000.0, 36525 * 86400.0, 32.184, 10.0
AU_KM, LIGHT_DEG = 149597870.7, 20.49552 / 3600  # the second: the constant of aberration
#: equator's radius and flattening of WGS 84.
EARTH_KM, FLATTENING = 6378.137, 1 / 298.257223563

#: Arguments of the Moon and the Sun, degrees at J2000 and per century and its square.
ARGUMENTS = {
    "l": (218.3164477, 481267.88123421, -0.0015786),
    "d": (297.8501921, 445267.1114034, -0.0018819),
    "m": (357.5291092, 35999.0502909, -0.0001536),
    "n": (134.9633964, 477198.8675055, 0.0087414),
    "f": (93.2720950, 483202.0175233, -0.0036539),
    "o": (125.04452, -1934.136261, 0.0020708),
}
#: Multiples of d, m, n, f; sine of longitude (10^-6 degrees); cosine of distance (metres).
MOON_LONGITUDE = (
    "0 0 1 0 6288774 -20905355, 2 0 -1 0 1274027 -3699111, 2 0 0 0 658314 -2955968, 0 0 2 0 213618 -569925, 0 1 0 0 -185116 48888, 0 0 0 2 -114332 -3149, "
    "2 0 -2 0 58793 246158, 2 -1 -1 0 57066 -152138, 2 0 1 0 53322 -170733, 2 -1 0 0 45758 -204586, 0 1 -1 0 -40923 -129620, 1 0 0 0 -34720 108743, "
    "0 1 1 0 -30383 104755, 2 0 0 -2 15327 10321, 0 0 1 2 -12528 0, 0 0 1 -2 10980 79661, 4 0 -1 0 10675 -34782, 0 0 3 0 10034 -23210, "
    "4 0 -2 0 8548 -21636, 2 1 -1 0 -7888 24208, 2 1 0 0 -6766 30824, 1 0 -1 0 -5163 -8379, 1 1 0 0 4987 -16675, 2 -1 1 0 4036 -12831, "
    "2 0 2 0 3994 -10445, 4 0 0 0 3861 -11650, 2 0 -3 0 3665 14403, 0 1 -2 0 -2689 -7003, 2 0 -1 2 -2602 0, 2 -1 -2 0 2390 10056, "
    "1 0 1 0 -2348 6322, 2 -2 0 0 2236 -9884, 0 1 2 0 -2120 5751, 0 2 0 0 -2069 0, 2 -2 -1 0 2048 -4950, 2 0 1 -2 -1773 4130, "
    "2 0 0 2 -1595 0, 4 -1 -1 0 1215 -3958, 0 0 2 2 -1110 0"
)
#: Multiples of d, m, n, f; sine of latitude (10^-6 degrees).
MOON_LATITUDE = (
    "0 0 0 1 5128122, 0 0 1 1 280602, 0 0 1 -1 277693, 2 0 0 -1 173237, 2 0 -1 1 55413, 2 0 -1 -1 46271, 2 0 0 1 32573, 0 0 2 1 17198, 2 0 1 -1 9266, "
    "0 0 2 -1 8822, 2 -1 0 -1 8216, 2 0 -2 -1 4324, 2 0 1 1 4200, 2 1 0 -1 -3359, 2 -1 -1 1 2463, 2 -1 0 1 2211, 2 -1 -1 -1 2065, 0 1 -1 -1 -1870, "
    "4 0 -1 -1 1828, 0 1 0 1 -1794, 0 0 0 3 -1749, 0 1 -1 1 -1565, 1 0 0 1 -1491, 0 1 1 1 -1475, 0 1 1 -1 -1410, 0 1 0 -1 -1344, 1 0 0 -1 -1335, 0 0 3 1 1107, 4 0 0 -1 1021"
)
#: Multiples of d, m, n, f, o; sine of the longitude's nutation and cosine of the obliquity's (10^-4 seconds of arc).
NUTATION = (
    "0 0 0 0 1 -171996 92025, -2 0 0 2 2 -13187 5736, 0 0 0 2 2 -2274 977, 0 0 0 0 2 2062 -895, 0 1 0 0 0 1426 54, 0 0 1 0 0 712 -7, -2 1 0 2 2 -517 224, "
    "0 0 0 2 1 -386 200, 0 0 1 2 2 -301 129, -2 -1 0 2 2 217 -95, -2 0 1 0 0 -158 0, -2 0 0 2 1 129 -70, 0 0 -1 2 2 123 -53, 2 0 0 0 0 63 0, 0 0 1 0 1 63 -33"
)


def terms(table: str) -> list[tuple[float, ...]]:
    return [tuple(map(float, row.split())) for row in table.split(",")]


def let(f: Callable[[Column], Column], /, **columns: Column) -> Column:
    return bound(F.struct(*[c.alias(n) for n, c in columns.items()]), f)


def sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def cos(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def atan2(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def turn(degrees: Column) -> Column:
    """From 0 (included) to 360."""
    return degrees - 360 * F.floor(degrees / 360)


def polynomial(x: Column, *coefficients: float) -> Column:
    """Coefficients of the powers of x, the constant first."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def centuries(t: Column) -> Column:
    """Julian centuries of terrestrial time since J2000."""
    return (t - J2000 + TT_TAI_S + FIRST_TAI_S + leap_seconds(t)) / CENTURY_S


def series(table: str, arguments: list[Column], columns: dict[str, tuple[int, Callable[[Column], Column]]], fading: list[Column] | None = None) -> Column:
    """Sums over a table's terms of a coefficient times a wave of a combination of arguments (radians).

    ``columns``: by the name of a sum the column of its coefficients and its wave; the sums share their angles.
    ``fading``: factors by the multiple of the second argument, the Sun's anomaly.  Terms are written out, as a
    sum over an array in a lambda takes several times as long."""
    rows = {f"a{i}": row for i, row in enumerate(terms(table))}

    def angle(row: tuple[float, ...]) -> Column:
        used = [(k, a) for k, a in zip(row, arguments, strict=False) if k]
        first = -used[0][1] if used[0][0] == -1 else used[0][1] if used[0][0] == 1 else used[0][0] * used[0][1]
        return reduce(lambda x, u: x + u[1] if u[0] == 1 else x - u[1] if u[0] == -1 else x + u[0] * u[1], used[1:], first)

    def sums(angles: Column) -> Column:
        def term(name: str, row: tuple[float, ...], column: int, wave: Callable[[Column], Column]) -> Column:
            out = row[column] * wave(angles[name])
            return out * fading[int(abs(row[1]))] if fading and row[1] else out

        return F.struct(*[sum((term(n, row, k, wave) for n, row in rows.items() if row[k]), F.lit(0.0)).alias(out) for out, (k, wave) in columns.items()])

    return let(sums, **{n: angle(row) for n, row in rows.items()})


def arguments(c: Column) -> dict[str, Column]:
    """In radians."""
    return {n: polynomial(c, *map(radians, p)) for n, p in ARGUMENTS.items()}


def mean_obliquity(c: Column) -> Column:
    return polynomial(c, 84381.406, -46.836769, -0.0001831) / 3600


def orientation(t: Column) -> Column:
    """(c, psi, eps, gast): centuries, nutation in longitude, true obliquity and Greenwich apparent sidereal time."""

    def of(s: Column) -> Column:
        ahead = polynomial(s["c"], 0.014506, 4612.156534, 1.3915817, -0.00000044, -0.000029956) / 3600

        def out(v: Column) -> Column:
            gast = era(s["t"]) + ahead + v["psi"] * cos(v["eps"]) + F.sin(s["o"]) * 0.00264 / 3600
            return F.struct(s["c"].alias("c"), v["psi"].alias("psi"), v["eps"].alias("eps"), bound(gast, turn).alias("gast"))

        nutation = series(NUTATION, [s[n] for n in "dmnfo"], {"psi": (5, F.sin), "eps": (6, F.cos)})
        return bound(nutation, lambda n: let(out, psi=n["psi"] / 36e6, eps=mean_obliquity(s["c"]) + n["eps"] / 36e6))

    return let(lambda s: let(of, t=s["t"], c=s["c"], **{n: a for n, a in arguments(s["c"]).items() if n != "l"}), t=t, c=centuries(t))


def sun(c: Column) -> Column:
    """Geometric longitude and latitude (ecliptic and mean equinox of date) and distance of the Sun."""

    def of(s: Column) -> Column:
        e = s["e"]
        centre = polynomial(e, 1.919460, -0.004789, -0.000014) * sin(s["m"]) + polynomial(e, 0.020094, -0.0001) * sin(2 * s["m"]) + 0.000293 * sin(3 * s["m"])
        planets = 0.00134 * cos(153.23 + 22518.7541 * e) + 0.00154 * cos(216.57 + 45037.5082 * e) + 0.00200 * cos(312.69 + 32964.3577 * e) + 0.00178 * sin(231.19 + 20.20 * e)
        moon = 0.00179 * sin(polynomial(e, 350.74, 445267.1142, -0.00144))
        lon = polynomial(e, 279.69668, 36000.76892, 0.0003025) + centre + planets + moon
        ecc = polynomial(e, 0.01675104, -0.0000418, -0.000000126)
        au = 1.0000002 * (1 - ecc * ecc) / (1 + ecc * cos(s["m"] + centre))
        return F.struct(bound(lon, turn).alias("lon"), F.lit(0.0).alias("lat"), (au * AU_KM).alias("km"))

    return let(lambda s: let(of, e=s["e"], m=polynomial(s["e"], 358.47583, 35999.04975, -0.000150, -0.0000033)), e=c + 1.0)


def moon_of_date(c: Column) -> Column:
    """Apparent longitude and latitude without nutation, and distance of the Moon (light-time is in them)."""

    def of(s: Column) -> Column:
        own, fading = [s[n] for n in "dmnf"], [F.lit(1.0), s["e"], s["e"] * s["e"]]
        c, a1 = s["c"], radians(119.75) + radians(131.849) * s["c"]

        def out(v: Column) -> Column:
            lon = v["lon"] + 3958 * F.sin(a1) + 1962 * F.sin(s["l"] - s["f"]) + 318 * sin(53.09 + 479264.290 * c)
            lat = v["lat"]["lat"] - 2235 * F.sin(s["l"]) + 382 * sin(313.45 + 481266.484 * c)
            lat = lat + 175 * F.sin(a1 - s["f"]) + 175 * F.sin(a1 + s["f"]) + 127 * F.sin(s["l"] - s["n"]) - 115 * F.sin(s["l"] + s["n"])
            return F.struct(bound(F.degrees(s["l"]) + lon / 1e6, turn).alias("lon"), (lat / 1e6).alias("lat"), (385000.56 + v["km"] / 1000).alias("km"))

        both = series(MOON_LONGITUDE, own, {"lon": (4, F.sin), "km": (5, F.cos)}, fading)
        return let(lambda v: bound(F.struct(v["own"]["lon"].alias("lon"), v["own"]["km"].alias("km"), v["lat"].alias("lat")), out), own=both, lat=series(MOON_LATITUDE, own, {"lat": (4, F.sin)}, fading))

    return let(lambda s: let(of, c=s["c"], e=polynomial(s["c"], 1.0, -0.002516, -0.0000074), **arguments(s["c"])), c=c)


def moon(c: Column) -> Column:
    """Astrometric place of the Moon: what aberration adds is taken away."""

    def of(s: Column) -> Column:
        between = s["sun"]["lon"] - s["m"]["lon"]
        lon = s["m"]["lon"] + LIGHT_DEG * cos(between) / cos(s["m"]["lat"])
        return F.struct(lon.alias("lon"), (s["m"]["lat"] + LIGHT_DEG * sin(between) * sin(s["m"]["lat"])).alias("lat"), s["m"]["km"].alias("km"))

    return let(lambda s: let(of, sun=sun(s["c"]), m=moon_of_date(s["c"])), c=c)


def vector(lon: Column, lat: Column, size: Column | float = 1.0) -> list[Column]:
    return [size * cos(lat) * cos(lon), size * cos(lat) * sin(lon), size * sin(lat)]


def xyz(v: list[Column]) -> Column:
    return F.struct(*[x.alias(n) for n, x in zip("xyz", v, strict=True)])


def about(axis: int, angle: Column, v: Column) -> Column:
    """Coordinates of v in a frame turned by an angle about an axis (0, 1, 2)."""

    def of(s: Column) -> Column:
        out, i, j = [s["v"][n] for n in "xyz"], (axis + 1) % 3, (axis + 2) % 3
        out[i], out[j] = s["c"] * out[i] + s["s"] * out[j], s["c"] * out[j] - s["s"] * out[i]
        return xyz(out)

    return let(of, v=v, s=sin(angle), c=cos(angle))


def turned(v: list[Column], turns: list[tuple[int, Column]]) -> Column:
    """(x, y, z) after turns about axes."""
    out = xyz(v)
    for axis, angle in turns:
        out = about(axis, angle, out)
    return out


def precession(c: Column) -> list[Column]:
    """The three angles that turn the equator and equinox of J2000 into those of date."""
    zeta = polynomial(c, 2.650545, 2306.083227, 0.2988499, 0.01801828)
    z = polynomial(c, -2.650545, 2306.077181, 1.0927348, 0.01826837)
    return [zeta / 3600, polynomial(c, 0, 2004.191903, -0.4294934, -0.04182264) / 3600, z / 3600]


def to_date(v: list[Column], o: Column) -> Column:
    """A direction of J2000 in the true equator and equinox of date; ``o`` is an ``orientation``."""
    zeta, theta, z = precession(o["c"])
    return turned(v, [(2, -zeta), (1, theta), (2, -z), (0, mean_obliquity(o["c"])), (2, -o["psi"]), (0, -o["eps"])])


def from_date(v: list[Column], o: Column) -> Column:
    zeta, theta, z = precession(o["c"])
    return turned(v, [(0, o["eps"]), (2, o["psi"]), (0, -mean_obliquity(o["c"])), (2, z), (1, -theta), (2, zeta)])


def radec(v: Column) -> Column:
    return F.struct(bound(atan2(v["y"], v["x"]), turn).alias("ra"), atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])).alias("dec"))


@dataclass(frozen=True)
class Star:
    """A fixed source: right ascension and declination of J2000."""

    ra: Column | float
    dec: Column | float = 0.0


BODIES: dict[str, Callable[[Column], Column]] = {"sun": sun, "moon": moon}
Body = str | Star


@dataclass(frozen=True)
class Observer:
    """A place on Earth: east longitude, geodetic latitude, and height in metres; each a number or a column."""

    longitude: Column | float = 0.0
    latitude: Column | float = 0.0
    altitude: Column | float = 0.0

    def column(self, name: str) -> Column:
        given = getattr(self, name)
        return given.cast("double") if isinstance(given, Column) else F.lit(float(given))

    def lst(self, t: Column) -> Column:
        """Local apparent sidereal time."""
        return turn(orientation(t)["gast"] + self.column("longitude"))

    def transit_ra(self, t: Column) -> Column:
        """Right ascension (J2000) of the point where the meridian meets the equator of date."""

        def of(s: Column) -> Column:
            lst = s["o"]["gast"] + self.column("longitude")
            return bound(from_date(vector(lst, F.lit(0.0)), s["o"]), radec)["ra"]

        return let(of, o=orientation(t))

    def position(self, gast: Column) -> list[Column]:
        """From the Earth's centre, in the true equator and equinox of date."""
        lat, high = self.column("latitude"), self.column("altitude") / 1000
        c = 1 / F.sqrt(cos(lat) * cos(lat) + (1 - FLATTENING) ** 2 * sin(lat) * sin(lat))
        flat, up = (EARTH_KM * c + high) * cos(lat), (EARTH_KM * (1 - FLATTENING) ** 2 * c + high) * sin(lat)
        lst = gast + self.column("longitude")
        return [flat * cos(lst), flat * sin(lst), up]

    def place(self, body: Body, t: Column) -> Column:
        """(ra, dec, ha): as seen from the observer, true equator and equinox of date; ha from -180 to 180."""

        def seen(o: Column) -> Column:
            if isinstance(body, Star):
                ra, dec = (x if isinstance(x, Column) else F.lit(float(x)) for x in (body.ra, body.dec))
                return to_date(vector(ra, dec), o)

            def of(s: Column) -> Column:
                centre = turned(vector(s["p"]["lon"] + o["psi"], s["p"]["lat"], s["p"]["km"]), [(0, -o["eps"])])
                return bound(centre, lambda v: xyz([v[n] - x for n, x in zip("xyz", self.position(o["gast"]), strict=True)]))

            return let(of, p=BODIES[body](o["c"]))

        def out(s: Column) -> Column:
            ha = turn(s["o"]["gast"] + self.column("longitude") - s["r"]["ra"] + 180) - 180
            return F.struct(s["r"]["ra"].alias("ra"), s["r"]["dec"].alias("dec"), ha.alias("ha"))

        return let(lambda s: let(out, o=s["o"], r=bound(seen(s["o"]), radec)), o=orientation(t))

    def altitude_of(self, body: Body, t: Column) -> Column:
        """Degrees above the horizon, without refraction."""
        lat = self.column("latitude")
        return bound(self.place(body, t), lambda p: F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin(lat) * sin(p["dec"]) + cos(lat) * cos(p["dec"]) * cos(p["ha"]))))))


def object_coords(star: Star, t: Column | None = None) -> Column:
    """(ra, dec) of a star: of J2000 without a time; else apparent, in the intermediate system of date (CIRS)."""
    ra, dec = (x if isinstance(x, Column) else F.lit(float(x)) for x in (star.ra, star.dec))
    if t is None:
        return F.struct(ra.cast("double").alias("ra"), dec.cast("double").alias("dec"))

    def moved(s: Column) -> Column:
        """Aberration: the Earth's velocity over that of light, in the ecliptic of date, added in the frame of date."""
        lon, per = s["sun"]["lon"] + s["o"]["psi"], LIGHT_DEG * 3.141592653589793 / 180
        ecc, perigee = 0.01671, 282.94 + 1.7192 * s["o"]["c"]
        x, y = per * (sin(lon) - ecc * sin(perigee)), -per * (cos(lon) - ecc * cos(perigee))
        v = s["v"]
        seen = xyz([v["x"] + x, v["y"] + y * cos(s["o"]["eps"]), v["z"] + y * sin(s["o"]["eps"])])
        return bound(bound(seen, radec), lambda r: F.struct(turn(r["ra"] - (s["o"]["gast"] - era(s["t"]))).alias("ra"), r["dec"].alias("dec")))

    return let(lambda s: let(moved, t=s["t"], o=s["o"], v=to_date(vector(ra, dec), s["o"]), sun=sun(s["o"]["c"])), t=t, o=orientation(t))


def star_cirs(ra: Column, dec: Column, t: Column) -> Column:
    """(ra, dec) of J2000 of a direction given in the intermediate system (CIRS) of a time."""
    return let(lambda s: bound(from_date(vector(ra + s["o"]["gast"] - era(s["t"]), dec), s["o"]), radec), t=t, o=orientation(t))
