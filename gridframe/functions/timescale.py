"""Time scales as columns; times are UNIX seconds (UTC) unless a name says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first days on which TAI - UTC had grown by a second, after 10 s on 1972-01-01.
LEAP_DAYS = (
    "1972-07-01 1973-01-01 1974-01-01 1975-01-01 1976-01-01 1977-01-01 1978-01-01 1979-01-01 1980-01-01 1981-07-01 1982-07-01 1983-07-01 1985-07-01 1988-01-01 "
    "1990-01-01 1991-01-01 1992-07-01 1993-07-01 1994-07-01 1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01"
).split()
#: Seconds of UT1 in SI seconds, and of stellar and sidereal time in those of UT1.
UT1_S = 1.00000000205
STELLAR_S, SIDEREAL_S = UT1_S / 1.00273781191135448, UT1_S / 1.002737909350795


def unix_time(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def time_string(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")


def from_time_string(s: Column) -> Column:
    return F.to_timestamp(F.substring(s, 1, 15), "yyyyMMdd'T'HHmmss")


def time_of_day(t: Column) -> Column:
    return t - F.floor(t / 86400) * 86400


def leap_seconds(t: Column) -> Column:
    """Leap seconds put in up to t; the table is part of the expression, the latest day first.

    ``t`` is worked out once and times after the last leap second take one comparison."""
    starts = [datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp() for d in LEAP_DAYS]

    def counted(x: Column) -> Column:
        out = F.when(x >= starts[-1], len(starts))
        for n in range(len(starts) - 1, 0, -1):
            out = out.when(x >= starts[n - 1], n)
        return out.otherwise(0).cast("long")

    return bound(t, counted)


def leap_seconds_between(a: Column, b: Column) -> Column:
    return leap_seconds(b) - leap_seconds(a)


def era(t: Column, dut1: Column | float = 0.0) -> Column:
    """Earth rotation angle in degrees, from UT1 = UTC + dut1."""
    days = (t + dut1) / 86400 - 10957.5
    turns = F.lit(0.7790572732640) + F.lit(0.00273781191135448) * days + (days - F.floor(days))
    return 360 * (turns - F.floor(turns))


def era_to_unix(angle: Column, after: Column) -> Column:
    """The first time from ``after`` on with this Earth rotation angle."""

    def of(a: Column) -> Column:
        t = bound(angle - era(a), lambda ahead: a + (ahead - F.floor(ahead / 360) * 360) * 240 * STELLAR_S)
        return bound(t, lambda x: x - leap_seconds_between(a, x))

    return bound(after, of)


def lsa(t: Column, longitude: float) -> Column:
    """Local stellar angle in degrees."""
    a = era(t) + longitude
    return a - F.floor(a / 360) * 360


def lsd(t: Column, longitude: float, zero: float) -> Column:
    """Local stellar day number with its fraction; ``zero`` is the start of day 0."""
    part = lsa(t, longitude) / 360
    return F.rint((t - zero) / (86400 * STELLAR_S) - part) + part


def unix_to_timestamp(t: Column) -> Column:
    return F.timestamp_micros(F.round(t * 1e6).cast("long"))


def naive_to_utc(ts: Column) -> Column:
    """A timestamp without a zone, taken as UTC whatever the session's zone."""
    return F.concat(ts.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")


def ensure_unix(column: Column, kind: str) -> Column:
    """UNIX seconds of a column whose type is ``kind`` (a simpleString); strings are ISO times or time strings."""
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        return column.cast("double")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return unix_time(column)
    if kind == "string":
        return F.when(column.rlike(r"^\d{8}T\d{6}Z$"), unix_time(F.try_to_timestamp(F.substring(column, 1, 15), F.lit("yyyyMMdd'T'HHmmss")))).otherwise(unix_time(F.try_to_timestamp(column)))
    raise TypeError(f"{kind} is no time")


def bound(column: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, however often f uses it."""
    return F.transform(F.array(column), f)[0]


def lsa_to_unix(angle: Column, after: Column, longitude: float) -> Column:
    """The first time from ``after`` on with this local stellar angle."""
    return bound(after, lambda a: bound(angle - longitude, lambda g: era_to_unix(g - F.floor(g / 360) * 360, a)))


def lsd_zero(start: float, longitude: float) -> Column:
    """The first time from ``start`` on at which the local stellar angle is 0: where day 0 may begin."""
    return lsa_to_unix(F.lit(0.0), F.lit(float(start)), longitude)


def lsd_to_unix(day: Column, longitude: float, zero: float) -> Column:
    """The time of a local stellar day number with its fraction."""

    def time_of(d: Column) -> Column:
        about = zero + d * 86400 * STELLAR_S
        return lsa_to_unix((d - F.floor(d)) * 360, bound(about, lambda t: t - leap_seconds_between(F.lit(float(zero)), t) - 43200), longitude)

    return bound(day, time_of)


def current_lsd(longitude: float, zero: float) -> Column:
    return lsd(unix_time(F.current_timestamp()), longitude, zero)
