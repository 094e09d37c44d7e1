"""How many things reported within a radius and a time of spots, exactly, in blocks: reports go to the blocks of place and
time that their circle touches, spots to their own, and a crowded block is cut by a hash of the things (whose counts add
up) and of the spots. A task holds one such pair as arrays. The work is spots times the reports around them in their time,
by nature, but a pair costs a product of two arrays and no distinct rows are shuffled."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.scalars import EARTH_M
from ..sources.workers import reachable

c = F.col
#: A block's sides in radii and windows; reports and spots that meet at most on average; rows of a product. Results don't
#: depend on them.
WIDE, REPORTS, SPOTS, ROWS = 4, 65_536, 65_536, 32
#: Cosines are off by less; what is closer to the radius is measured by the formula.
SLACK = 1e-14


def _unit(table: pa.Table) -> np.ndarray:
    lat, lon = (np.radians(table[n].to_numpy()) for n in ("lat", "lon"))
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half = lambda a, b: math.sin((math.radians(b) - math.radians(a)) / 2) ** 2
    h = half(lat1, lat2) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))


def _block(radius: float, window: float, keys: list[str]):
    """The counts of a pair: for each of its spots, things other than its own with a report in the circle in (t0, t1]."""
    angle = min(radius / EARTH_M, math.pi)
    limit, chord = math.cos(angle), 2 * math.sin(angle / 2) * (1 + 1e-9) + 1e-9

    def one(spots: pa.Table, reports: pa.Table) -> pa.Table:
        n = np.zeros(len(spots), dtype=np.int64)
        if len(spots) and len(reports):
            reports = reports.take(pc.sort_indices(reports["t"]))
            things = reports["other"].combine_chunks().dictionary_encode()
            code, own = things.indices.to_numpy(), pc.fill_null(pc.index_in(spots["thing"], value_set=things.dictionary), -1).to_numpy()
            count(n, spots, reports, code, own, len(things.dictionary))
        return spots.select(keys).append_column("n_near", pa.array(n))

    def count(n, spots, reports, code, own, n_things):
        a, b, t = _unit(spots), _unit(reports), reports["t"].to_numpy()
        axes = np.ascontiguousarray(b.T)
        place = [(x["lat"].to_numpy(), x["lon"].to_numpy()) for x in (spots, reports)]
        t0 = spots["t0"].to_numpy()
        lo, hi = np.searchsorted(t, t0, "right"), np.searchsorted(t, spots["t1"].to_numpy(), "right")

        def inside(dots, i, j):
            """Of dots between rows i and columns j, which are in the circle."""
            hit = dots >= limit - SLACK
            if np.count_nonzero(hit) != np.count_nonzero(dots >= limit + SLACK):
                for x, y in np.argwhere(hit & (dots < limit + SLACK)):
                    hit[x, y] = _metres(*(p[i[x]] for p in place[0]), *(p[j[y]] for p in place[1])) <= radius
            return hit

        # spots of half a radius and half a window together; their reports are cut to the box around them
        tile = [np.floor(a[:, k] / (chord / 2)) for k in range(3)] + [np.floor(t0 / (window / 2))]
        order = np.lexsort([t0, *tile])
        ends = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in tile], axis=0)) + 1
        for mine in np.split(order, ends):
            first, last = lo[mine].min(), hi[mine].max()
            low, high = a[mine].min(axis=0) - chord, a[mine].max(axis=0) + chord
            box = np.ones(max(last - first, 0), dtype=bool)
            for axis, below, above in zip(axes, low, high):
                near = axis[first:last]
                box &= near >= below
                box &= near <= above
            held = first + np.flatnonzero(box)
            if not len(held):
                continue
            often = np.bincount(code[held], minlength=n_things)[code[held]] > 1
            once, many = held[~often], held[often]
            many = many[np.argsort(code[many], kind="stable")]
            starts = np.flatnonzero(np.diff(code[many], prepend=-1))
            from_, to = np.searchsorted(once, lo[mine]), np.searchsorted(once, hi[mine])
            for k in range(0, len(mine), ROWS):
                rows = mine[k : k + ROWS]
                s, e = from_[k : k + ROWS], to[k : k + ROWS]
                left = s.min()
                columns = once[left : max(e.max(), left)]
                hit = inside(a[rows] @ b[columns].T, rows, columns)
                n[rows] += [np.count_nonzero(hit[x, y - left : max(z, y) - left]) for x, (y, z) in enumerate(zip(s, e))]
                if len(many):
                    hit = inside(a[rows] @ b[many].T, rows, many)
                    hit &= (many >= lo[rows][:, None]) & (many < hi[rows][:, None])
                    n[rows] += np.logical_or.reduceat(hit, starts, axis=1).sum(axis=1)
        # a thing is no neighbour of itself: its own reports by (thing, place in time)
        key = np.sort(code.astype(np.int64) * len(t) + np.arange(len(t)))
        begin, end = (np.searchsorted(key, own.astype(np.int64) * len(t) + x) for x in (lo, hi))
        for x in np.flatnonzero((own >= 0) & (end > begin)):
            columns = key[begin[x] : end[x]] % len(t)
            n[x] -= bool(inside(a[x : x + 1] @ b[columns].T, [x], columns).any())

    return one


def others_near(spots: DataFrame, reports: DataFrame, keys: list[str], radius_m: float, window_s: float) -> DataFrame:
    """(keys, n_near) of the spots with a block: how many things other than the spot's reported in its circle in (t0, t1].

    spots: keys (thing among them), lat, lon, t0, t1 with t1 <= t0 + window_s. reports: other, lat, lon, t; times in
    seconds. Spots that meet no report may be missing."""
    reachable(spots.sparkSession)
    angle = min(radius_m / EARTH_M, math.pi / 2)
    wide = WIDE * math.degrees(angle)
    across = max(1, math.floor(360 / wide))
    step, slab = 360 / across, WIDE * window_s
    finite = "lat between -1e6 and 1e6 and lon between -1e6 and 1e6"
    spots = spots.filter(finite).withColumns({"x": F.pmod(F.floor(c("lon") / step), F.lit(across)), "y": F.floor(c("lat") / wide), "z": F.floor(c("t0") / slab)})
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-9)))))
    cells = lambda lo, hi, size: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    reach = math.degrees(angle) + 1e-6
    polar = half >= 90 - math.degrees(angle)
    west = F.when(polar, 0).otherwise(F.floor((c("lon") - half - 1e-6) / step))
    # no cell twice, however many a circle goes around
    east = F.when(polar, across - 1).otherwise(F.least(F.floor((c("lon") + half + 1e-6) / step), west + (across - 1)))
    reports = reports.filter(finite).withColumn("x", F.explode(F.sequence(west, east))).withColumn("x", F.pmod("x", F.lit(across)))
    reports = reports.withColumn("y", cells(c("lat") - reach, c("lat") + reach, wide)).withColumn("z", cells(c("t") - window_s - 0.001, c("t"), slab))
    block = ["x", "y", "z"]
    sizes = reports.select(*block, F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(spots.select(*block, F.lit(0).alias("r"), F.lit(1).alias("s")))
    parts = lambda n, most: F.ceil(F.sum(n) / most)
    sizes = sizes.groupBy(*block).agg(parts("r", REPORTS).alias("nr"), parts("s", SPOTS).alias("ns")).filter("nr > 0 and ns > 0")
    dealt = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    mine = lambda n, *by: F.pmod(F.xxhash64(*by), c(n))
    pair = [*block, "pr", "ps"]
    asked = spots.join(sizes, block).select(*pair[:3], mine("ns", *keys).alias("ps"), dealt("nr").alias("pr"), *keys, "lat", "lon", "t0", "t1")
    told = reports.join(sizes, block).select(*pair[:3], mine("nr", "other").alias("pr"), dealt("ns").alias("ps"), "other", "lat", "lon", "t")
    out = StructType([spots.schema[k] for k in keys]).add("n_near", LongType())
    return asked.groupBy(*pair).cogroup(told.groupBy(*pair)).applyInArrow(_block(radius_m, window_s, keys), out).groupBy(*keys).agg(F.sum("n_near").alias("n_near"))
