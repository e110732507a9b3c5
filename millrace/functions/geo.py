"""Planar geometry over Columns of coordinates, and points, lines and rings as arrays of (x, y) structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import bound, let


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def box(low: Column, high: Column) -> Column:
    """A rectangle's closed ring."""
    return F.array(low, point(high["x"], low["y"]), high, point(low["x"], high["y"]), low)


def _edges(line: Column) -> Column:
    return F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


@bound
def length(line: Column) -> Column:
    return F.aggregate(_edges(line), F.lit(0.0), lambda t, e: t + distance(e["a"], e["b"]))


@bound
def area(ring: Column) -> Column:
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda t, e: t + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


@bound
def centroid(points: Column) -> Column:
    """The mean of the points."""
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda t, p: t + p[k]) / F.size(points)
    return point(mean("x"), mean("y"))


@bound
def envelope(points: Column) -> Column:
    """min_x, min_y, max_x, max_y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


@bound
def contains(ring: Column, p: Column) -> Column:
    """Whether a point is inside by the even-odd rule; points of the boundary are not. Null if a null coordinate leaves it open."""
    x, y = p["x"], p["y"]

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    odd = F.aggregate(_edges(ring), F.lit(0), lambda t, e: t + F.coalesce(crosses(e), F.lit(False)).cast("int")) % 2 == 1
    within = (x > F.array_min(F.transform(ring, lambda q: q["x"]))) & (x < F.array_max(F.transform(ring, lambda q: q["x"]))) & (y > F.array_min(F.transform(ring, lambda q: q["y"]))) & (y < F.array_max(F.transform(ring, lambda q: q["y"])))
    return within & F.when(x.isNotNull() & y.isNotNull(), odd & ~F.exists(_edges(ring), on))


def translate(points: Column, dx: float, dy: float) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def scale(points: Column, fx: float, fy: float) -> Column:
    return F.transform(points, lambda p: point(p["x"] * fx, p["y"] * fy))


def rotate(points: Column, radians: float) -> Column:
    from math import cos, sin

    c, s = cos(radians), sin(radians)
    return F.transform(points, lambda p: point(p["x"] * c - p["y"] * s, p["x"] * s + p["y"] * c))


def as_text(points: Column, kind: str = "LINESTRING") -> Column:
    """WKT of whole-number or decimal coordinates as Spark prints doubles."""
    return F.concat(F.lit(f"{kind} ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def grid_cell(x: Column, y: Column, size: float) -> Column:
    """A cell id to join nearby points by."""
    return F.concat_ws(":", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def geohash(lon: Column, lat: Column, precision: int = 6) -> Column:
    """Base-32 geohash: bits of both axes interleaved, longitude first."""
    bits = precision * 5
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * F.lit(float(1 << lon_bits))), F.lit(float((1 << lon_bits) - 1))).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * F.lit(float(1 << lat_bits))), F.lit(float((1 << lat_bits) - 1))).cast("long")
    alphabet = "0123456789bcdefghjkmnpqrstuvwxyz"
    bit = lambda k: F.shiftright(x, lon_bits - 1 - k // 2).bitwiseAND(F.lit(1)) if k % 2 == 0 else F.shiftright(y, lat_bits - 1 - k // 2).bitwiseAND(F.lit(1))
    chars = [F.substring(F.lit(alphabet), (reduce(lambda a, k: a * 2 + bit(k), range(5 * i + 1, 5 * i + 5), bit(5 * i)) + 1).cast("int"), F.lit(1)) for i in range(precision)]
    return let(F.concat(*chars), lambda h: h)
