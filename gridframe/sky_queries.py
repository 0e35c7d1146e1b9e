"""Queries of sidereal time, star places, transits, risings and settings, beside SQL that works each formula out on its own.

The SQL is layered: each layer names expressions over the columns of the one below.  Roots are found there
by halving brackets in a recursive query, here by the root solver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import sky, timescale
from gridframe.operators import events
from gridframe.queries import query, table

LONGITUDE, LATITUDE, ALTITUDE = -119.62, 49.32, 545.0


def layers(source: str, *steps: dict[str, str]) -> str:
    for step in steps:
        source = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM ({source})"
    return source


def poly(x: str, *coefficients: float) -> str:
    return "(" + " + ".join(f"{c!r} * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


def total(terms: list[tuple[float, ...]], names: str, column: int, f: str, faded: bool = False) -> str:
    def one(row: tuple[float, ...]) -> str:
        angle = " + ".join(f"{row[k]:g} * {n}" for k, n in enumerate(names) if row[k])
        return f"{row[column]!r} * {f}(radians({angle}))" + (f" * pow(ecc, {abs(row[1]):g})" if faded and row[1] else "")

    return "(" + " + ".join(one(row) for row in terms if row[column]) + ")"


def orientation() -> list[dict[str, str]]:
    """From ``t``: c, psi, eps, era and gast."""
    from datetime import UTC, datetime

    leaps = " + ".join(f"(t >= {datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp():.0f})::INT" for d in timescale.LEAP_DAYS)
    days = "(t / 86400.0 - 10957.5)"
    turns = f"(0.7790572732640 + 0.00273781191135448 * {days} + ({days} - floor({days})))"
    nutation = sky.terms(sky.NUTATION)
    return [
        {"c": f"(t - 946728000.0 + 42.184 + {leaps}) / 3155760000.0"},
        {k: poly("c", *v) for k, v in sky.ARGUMENTS.items()},
        {"psi": total(nutation, "dmnfo", 5, "sin") + " / 36e6", "obl": poly("c", 84381.406, -46.836769, -0.0001831) + " / 3600"},
        {"eps": "obl + " + total(nutation, "dmnfo", 6, "cos") + " / 36e6", "era": f"360 * ({turns} - floor({turns}))"},
        {"gast": "era + " + poly("c", 0.014506, 4612.156534, 1.3915817, -0.00000044, -0.000029956) + " / 3600 + psi * cos(radians(eps)) + sin(radians(o)) * 0.00264 / 3600"},
    ]


def sun(km: str, lon: str) -> list[dict[str, str]]:
    e = "(c + 1)"
    own = {"sm": poly(e, 358.47583, 35999.04975, -0.000150, -0.0000033), "secc": poly(e, 0.01675104, -0.0000418, -0.000000126)}
    centre = {"sc": f"{poly(e, 1.919460, -0.004789, -0.000014)} * sin(radians(sm)) + {poly(e, 0.020094, -0.0001)} * sin(radians(2 * sm)) + 0.000293 * sin(radians(3 * sm))"}
    more = f"0.00134 * cos(radians(153.23 + 22518.7541 * {e})) + 0.00154 * cos(radians(216.57 + 45037.5082 * {e})) + 0.002 * cos(radians(312.69 + 32964.3577 * {e})) + 0.00178 * sin(radians(231.19 + 20.2 * {e})) + 0.00179 * sin(radians({poly(e, 350.74, 445267.1142, -0.00144)}))"
    return [own, centre, {lon: f"{poly(e, 279.69668, 36000.76892, 0.0003025)} + sc + {more}", km: "149597870.7 * 1.0000002 * (1 - secc * secc) / (1 + secc * cos(radians(sm + sc)))"}]


def moon() -> list[dict[str, str]]:
    lon, lat = sky.terms(sky.MOON_LONGITUDE), sky.terms(sky.MOON_LATITUDE)
    return [
        {"ecc": poly("c", 1.0, -0.002516, -0.0000074), "a1": "119.75 + 131.849 * c"},
        {
            "mlon": f"l + ({total(lon, 'dmnf', 4, 'sin', True)} + 3958 * sin(radians(a1)) + 1962 * sin(radians(l - f)) + 318 * sin(radians(53.09 + 479264.290 * c))) / 1e6",
            "mlat": f"({total(lat, 'dmnf', 4, 'sin', True)} - 2235 * sin(radians(l)) + 382 * sin(radians(313.45 + 481266.484 * c)) + 175 * sin(radians(a1 - f)) + 175 * sin(radians(a1 + f)) + 127 * sin(radians(l - n)) - 115 * sin(radians(l + n))) / 1e6",
            "km": f"385000.56 + {total(lon, 'dmnf', 5, 'cos', True)} / 1000",
        },
        {"lon": "mlon + 20.49552 / 3600 * cos(radians(slon - mlon)) / cos(radians(mlat))", "lat": "mlat + 20.49552 / 3600 * sin(radians(slon - mlon)) * sin(radians(mlat))"},
    ]


def rotation(axis: int, angle: str) -> dict[str, str]:
    i, j = "xyz"[(axis + 1) % 3], "xyz"[(axis + 2) % 3]
    return {f"{i}_": f"cos(radians({angle})) * {i} + sin(radians({angle})) * {j}", f"{j}_": f"cos(radians({angle})) * {j} - sin(radians({angle})) * {i}", f"{'xyz'[axis]}_": "xyz"[axis]}


def rotated(source: str, turns: list[tuple[int, str]], keep: str) -> str:
    for axis, angle in turns:
        source = f"SELECT {keep}, x_ AS x, y_ AS y, z_ AS z FROM ({layers(source, rotation(axis, angle))})"
    return source


def precession() -> dict[str, str]:
    return {"zeta": poly("c", 2.650545, 2306.083227, 0.2988499, 0.01801828) + " / 3600", "theta": poly("c", 0.0, 2004.191903, -0.4294934, -0.04182264) + " / 3600", "zed": poly("c", -2.650545, 2306.077181, 1.0927348, 0.01826837) + " / 3600"}


RADEC = {"ra": "degrees(atan2(y, x)) - 360 * floor(degrees(atan2(y, x)) / 360)", "decl": "degrees(atan2(z, sqrt(x * x + y * y)))"}
FROM_DATE = [(0, "eps"), (2, "psi"), (0, "-obl"), (2, "zed"), (1, "-theta"), (2, "zeta")]
TO_DATE = [(2, "-zeta"), (1, "theta"), (2, "-zed"), (0, "obl"), (2, "-psi"), (0, "-eps")]


def place(body: str) -> list[dict[str, str]]:
    """From t, longitude, latitude and high (metres): ra, decl and ha."""
    own = [*sun("km", "lon"), {"lat": "0.0"}] if body == "sun" else [*sun("skm", "slon"), *moon()]
    flat = "(1 - 1 / 298.257223563)"
    site = {"cc": f"1 / sqrt(pow(cos(radians(latitude)), 2) + pow({flat}, 2) * pow(sin(radians(latitude)), 2))", "lst": "gast + longitude"}
    ecliptic = {"ex": "km * cos(radians(lat)) * cos(radians(lon + psi))", "ey": "km * cos(radians(lat)) * sin(radians(lon + psi))", "ez": "km * sin(radians(lat))"}
    seen = {
        "x": "ex - (6378.137 * cc + high / 1000) * cos(radians(latitude)) * cos(radians(lst))",
        "y": "ey * cos(radians(eps)) - ez * sin(radians(eps)) - (6378.137 * cc + high / 1000) * cos(radians(latitude)) * sin(radians(lst))",
        "z": f"ey * sin(radians(eps)) + ez * cos(radians(eps)) - (6378.137 * pow({flat}, 2) * cc + high / 1000) * sin(radians(latitude))",
    }
    return [*orientation(), *own, site, ecliptic, seen, RADEC, {"ha": "lst - ra + 180 - 360 * floor((lst - ra + 180) / 360) - 180"}]


def height(body: str, diameter: float) -> list[dict[str, str]]:
    return [*place(body), {"fx": f"degrees(asin(sin(radians(latitude)) * sin(radians(decl)) + cos(radians(latitude)) * cos(radians(decl)) * cos(radians(ha)))) + {diameter / 2!r}"}]


#: Each customer has a place on Earth and a day of its own.
CUSTOMERS = "SELECT c_custkey, c_nationkey * 14.4 - 180 AS longitude, c_nationkey * 4.0 - 48 AS latitude, abs(c_acctbal) / 10 AS high, 1600000000.0 + c_custkey * 21600 AS start FROM customer"


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, sky.Observer]:
    nation = F.col("c_nationkey")
    # much work a row, and the table is one small file: as many parts as cores
    rows = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism).select("c_custkey", "c_nationkey", "c_acctbal", (1600000000.0 + F.col("c_custkey") * 21600).alias("start"))
    return rows, sky.Observer(nation * 14.4 - 180, nation * 4.0 - 48, F.abs("c_acctbal") / 10)


def roots_sql(f: list[dict[str, str]], condition: str, out: str) -> str:
    """Roots of ``fx`` in a stellar day after ``start``, a fifth of it apart (the day is shorter than 86,400 seconds)."""
    day = 86400 * timescale.STELLAR_S
    own = "c_custkey, longitude, latitude, high"
    grid = f"SELECT {own}, start + k * {day!r} / 4 AS t, k FROM ({CUSTOMERS}), range(5) r(k)"
    return f"""WITH RECURSIVE grid AS (SELECT {own}, k, t, fx FROM ({layers(grid, *f)})),
      brackets AS (SELECT {own}, k, t AS a, lead(t) OVER w AS b, fx AS fa, lead(fx) OVER w AS fb FROM grid WINDOW w AS (PARTITION BY c_custkey ORDER BY k)),
      halved AS (SELECT {own}, k, a, b, fa, fa < fb AS increasing, 0 AS step FROM brackets WHERE fa * fb <= 0 AND {condition}
        UNION ALL SELECT {own}, k, CASE WHEN fx * fa <= 0 THEN a ELSE t END, CASE WHEN fx * fa <= 0 THEN t ELSE b END, CASE WHEN fx * fa <= 0 THEN fa ELSE fx END, increasing, step + 1 FROM ({layers("SELECT *, (a + b) / 2 AS t FROM halved WHERE step < 45", *f)}))
      SELECT c_custkey, round((a + b) / 2, 1) AS time{out} FROM halved WHERE step = 45"""


def transits(body: str, lower: bool = False) -> str:
    turned = "CASE WHEN ha < 0 THEN ha + 180 ELSE ha - 180 END" if lower else "ha"
    return roots_sql([*place(body), {"fx": turned}], "fa < fb", "")


@query(transits("sun"))
def solar_transits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, observer = customers(spark, sf_dir)
    return events.transit_times(rows, observer, "sun", F.col("start")).select("c_custkey", F.round("time", 1).alias("time"))


@query(transits("moon", lower=True))
def lunar_lower_transits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, observer = customers(spark, sf_dir)
    return events.transit_times(rows, observer, "moon", F.col("start"), lower=True).select("c_custkey", F.round("time", 1).alias("time"))


@query(roots_sql(height("sun", events.VISIBLE), "true", ", increasing AS rising"))
def solar_rise_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, observer = customers(spark, sf_dir)
    return events.visible_rise_set_times(rows, observer, "sun", F.col("start")).select("c_custkey", F.round("time", 1).alias("time"), "rising")


@query(roots_sql(height("moon", 0.0), "fa < fb", ""))
def lunar_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, observer = customers(spark, sf_dir)
    return events.rise_set_times(rows, observer, "moon", F.col("start"), rising=True).select("c_custkey", F.round("time", 1).alias("time"))


EVENT_TIMES = "SELECT event_id, epoch(ts)::DOUBLE AS t FROM events"


@query(f"SELECT event_id, round(s - 360 * floor(s / 360), 6) AS lst FROM (SELECT event_id, gast + {LONGITUDE} AS s FROM ({layers(EVENT_TIMES, *orientation())}))")
def apparent_sidereal_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timescale.unix_time(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(sky.Observer(LONGITUDE).lst(t), 6).alias("lst"))


ORIENTED = layers(EVENT_TIMES, *orientation(), precession(), {"x": f"cos(radians(gast + {LONGITUDE}))", "y": f"sin(radians(gast + {LONGITUDE}))", "z": "0.0"})


@query(f"SELECT event_id, round(ra, 6) AS ra FROM ({layers(rotated(ORIENTED, FROM_DATE, 'event_id, psi, eps, obl, zeta, theta, zed'), RADEC)})")
def transiting_right_ascension(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timescale.unix_time(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(sky.Observer(LONGITUDE, LATITUDE, ALTITUDE).transit_ra(t), 6).alias("ra"))


STARS = "SELECT c_custkey, c_nationkey * 14.1 AS ra0, c_acctbal / 150 AS dec0, 1400000000.0 + c_custkey * 86400 AS t FROM customer"
STAR_KEYS = "c_custkey, c, psi, eps, obl, zeta, theta, zed, gast, era, slon"
PLACED = rotated(layers(STARS, *orientation(), *sun("skm", "slon"), precession(), {"x": "cos(radians(dec0)) * cos(radians(ra0))", "y": "cos(radians(dec0)) * sin(radians(ra0))", "z": "sin(radians(dec0))"}), TO_DATE, STAR_KEYS)
MOVED = f"""SELECT {STAR_KEYS}, x + per * (sin(radians(slon + psi)) - 0.01671 * sin(radians(282.94 + 1.7192 * c))) AS x, y - per * side * cos(radians(eps)) AS y, z - per * side * sin(radians(eps)) AS z
  FROM (SELECT *, radians(20.49552 / 3600) AS per, cos(radians(slon + psi)) - 0.01671 * cos(radians(282.94 + 1.7192 * c)) AS side FROM ({PLACED}))"""


@query(f"SELECT c_custkey, round(turned - 360 * floor(turned / 360), 8) AS ra, round(decl, 8) AS dec FROM (SELECT *, ra - gast + era AS turned FROM ({layers(MOVED, RADEC)}))")
def star_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent places in the intermediate system of date."""
    star = sky.Star(F.col("c_nationkey") * 14.1, F.col("c_acctbal") / 150)
    at = F.col("c_custkey") * 86400 + 1400000000.0
    return table(spark, sf_dir, "customer").select("c_custkey", sky.object_coords(star, at).alias("p")).select("c_custkey", F.round("p.ra", 8).alias("ra"), F.round("p.dec", 8).alias("dec"))


CIRS = layers(STARS, *orientation(), precession(), {"turned": "ra0 + gast - era"}, {"x": "cos(radians(dec0)) * cos(radians(turned))", "y": "cos(radians(dec0)) * sin(radians(turned))", "z": "sin(radians(dec0))"})


@query(f"SELECT c_custkey, round(ra, 8) AS ra, round(decl, 8) AS dec FROM ({layers(rotated(CIRS, FROM_DATE, 'c_custkey, psi, eps, obl, zeta, theta, zed'), RADEC)})")
def star_from_cirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sky.star_cirs(F.col("c_nationkey") * 14.1, F.col("c_acctbal") / 150, F.col("c_custkey") * 86400 + 1400000000.0)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("p")).select("c_custkey", F.round("p.ra", 8).alias("ra"), F.round("p.dec", 8).alias("dec"))
