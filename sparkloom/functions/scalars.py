"""Column functions, expressions that Spark compiles but for `libm_asin`."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_M = 6_371_000.0
KNOT_MS = 1852 / 3600


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north in which a great circle leaves the first point for the second."""
    p1, p2, over = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(over) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(over))), F.lit(360.0))


@F.pandas_udf(DoubleType())
def libm_asin(x: pd.Series) -> pd.Series:
    """asin as the C library rounds it, as SQL engines do; the JVM's own is off by a unit in the last place now and then,
    enough to put a place on the edge of a cell into the next cell."""
    return pd.Series([math.asin(v) for v in x], dtype="float64")


def destination(lat: Column, lon: Column, bearing: Column, metres: Column, asin=F.asin) -> tuple[Column, Column]:
    """The point so many metres away along a bearing; its longitude lies in [-180, 180)."""
    p1, way, far = F.radians(lat), F.radians(bearing), metres / EARTH_M
    up = F.sin(p1) * F.cos(far) + F.cos(p1) * F.sin(far) * F.cos(way)
    p2 = asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))
    l2 = F.radians(lon) + F.atan2(F.sin(way) * F.sin(far) * F.cos(p1), F.cos(far) - F.sin(p1) * F.sin(p2))
    return F.degrees(p2), ((F.degrees(l2) + 180) % 360 + 360) % 360 - 180


def dead_reckon(lat: Column, lon: Column, knots: Column, course: Column, seconds: Column, asin=F.asin) -> tuple[Column, Column]:
    """Where a thing that holds its course and speed is in so many seconds (below zero: was); without speed or course it
    stays."""
    moves = (F.coalesce(knots, F.lit(0.0)) != 0) & course.isNotNull()
    there = destination(lat, lon, F.when(seconds >= 0, course).otherwise((course + 180) % 360), knots * KNOT_MS * F.abs(seconds), asin)
    return F.when(moves, there[0]).otherwise(lat), F.when(moves, there[1]).otherwise(lon)


def cell_of(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    return F.floor(lon / degrees), F.floor(lat / degrees)


def parse_cents(text: Column) -> Column:
    """Money text to cents; null unless it is digits with at most two decimals."""
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]{1,2})?$"), (text.cast("decimal(18,2)") * 100).cast("long"))


def format_cents(cents: Column) -> Column:
    whole = F.concat(F.floor(F.abs(cents) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    return F.when(cents < 0, F.concat(F.lit("-"), whole)).otherwise(whole)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's score interval; null without trials."""
    p, size = k / n, F.when(n > 0, n.cast("double"))
    middle, half = p + z * z / (2 * size), z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    return (middle - half) / (1 + z * z / size), (middle + half) / (1 + z * z / size)


def morton(x: Column, y: Column, bits: int) -> Column:
    """The bits of two small integers in turn, x's first."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1)), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), k).bitwiseAND(F.lit(1)), 2 * k + 1))
    return out


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def fix_time(received: Column, second: Column, skew: int = 5) -> Column:
    """The moment nearest to received, but at most skew seconds after it, whose second of the minute is second; received
    itself where second isn't 0 to 59."""
    at = F.unix_seconds(received.cast("timestamp"))
    back = F.pmod(at + skew - second, F.lit(60)) - skew
    return F.when(second.between(0, 59), (F.date_trunc("second", received).cast("timestamp_ntz") - F.make_dt_interval(secs=back))).otherwise(received)


def tier_of(n: Column, bounds: list[tuple[str, int]], lowest: str) -> Column:
    """The first tier, from the highest, whose bound n reaches."""
    out = F.lit(lowest)
    for name, least in sorted(bounds, key=lambda b: b[1]):
        out = F.when(n >= least, name).otherwise(out)
    return F.when(n.isNotNull(), out)


def jitter(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.crc32(F.concat_ws(":", *parts).cast("binary")) / F.lit(float(1 << 32))


def surprise_bits(share: Column) -> Column:
    """How many bits a fact of this share tells; null unless the share is above 0 and at most 1."""
    return F.when((share > 0) & (share <= 1), -F.log2(share))


def tag_topics(text: Column, words: dict[str, list[str]]) -> Column:
    """Topics whose words stand among the text's runs of letters, case aside, most mentioned first, ties by name; empty for
    null."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    count = lambda ws: F.size(F.filter(runs, lambda w: w.isin(ws)))
    told = F.array(*(F.struct((-count(ws)).alias("n"), F.lit(t).alias("topic")) for t, ws in words.items()))
    return F.transform(F.array_sort(F.filter(told, lambda x: x["n"] < 0)), lambda x: x["topic"])


def quantise(value: Column, low: Column, side: Column, bits: int = 16) -> Column:
    """The place of a value in [low, low + side] in whole steps from 0 to 2^bits - 1, values outside at the ends."""
    top = (1 << bits) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.round((value - low) / side * top))).cast("int")


def softmax(scores: Column) -> Column:
    """Scores as shares that sum to one; the largest is taken off first."""
    raised = F.transform(scores, lambda x: F.exp(x.cast("double") - F.array_max(scores).cast("double")))
    whole = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / whole)


def softmax_kl(p: Column, q: Column) -> Column:
    """Nats by which the softmax of q misses that of p."""
    return F.aggregate(F.zip_with(softmax(p), softmax(q), lambda a, b: F.when(a > 0, a * F.ln(a / F.greatest(b, F.lit(1e-300)))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def argmax(scores: Column) -> Column:
    """The place of the first largest score, from 0; null for null or empty arrays."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def percent_down(share: Column) -> Column:
    """A share as whole per cent, rounded down, so that no card tells more than is so."""
    return F.concat(F.floor(share * 100).cast("string"), F.lit("%"))


def country_digits(vessel: Column) -> Column:
    """The first three of a vessel number's nine digits, which name the country it is registered in; null for others."""
    return F.when(vessel.between(100_000_000, 999_999_999), F.floor(vessel / 1_000_000).cast("int"))
