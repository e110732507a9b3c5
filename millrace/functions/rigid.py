"""Rigid-body arithmetic: vectors, unit quaternions (x, y, z, w) and poses, over structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import bound


def vec(x, y, z) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(z).alias("z"))


def quat(x, y, z, w) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(z).alias("z"), c(w).alias("w"))


@bound
def norm(p: Column) -> Column:
    return F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])


@bound
def distance(a: Column, b: Column) -> Column:
    return norm(vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]))


@bound
def azimuth(p: Column) -> Column:
    return F.atan2(p["y"], p["x"])


@bound
def elevation(p: Column) -> Column:
    return F.atan2(p["z"], F.hypot(p["x"], p["y"]))


@bound
def voxel(p: Column, size: float) -> Column:
    return F.struct(*(F.floor(p[k] / size).cast("long").alias(k) for k in "xyz"))


@bound
def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


@bound
def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


@bound
def quat_multiply(a: Column, b: Column) -> Column:
    ax, ay, az, aw = (a[k] for k in "xyzw")
    bx, by, bz, bw = (b[k] for k in "xyzw")
    return quat(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


@bound
def quat_conjugate(q: Column) -> Column:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


@bound
def quat_normalize(q: Column) -> Column:
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])
    return quat(*(F.try_divide(q[k], n) for k in "xyzw"))


@bound
def quat_angle(q: Column) -> Column:
    """Rotation angle, 0 to pi."""
    return 2 * F.atan2(norm(q), F.abs(q["w"]))


@bound
def quat_angular_distance(a: Column, b: Column) -> Column:
    return quat_angle(quat_multiply(quat_conjugate(a), b))


@bound
def quat_from_axis_angle(axis: Column, angle: Column) -> Column:
    s = F.try_divide(F.sin(angle / 2), norm(axis))
    return quat(axis["x"] * s, axis["y"] * s, axis["z"] * s, F.cos(angle / 2))


@bound
def quat_from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rotations about x, then y, then z."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return quat(sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy)


@bound
def euler_from_quat(q: Column) -> Column:
    x, y, z, w = (q[k] for k in "xyzw")
    pitch = F.asin(F.greatest(F.least(2 * (w * y - z * x), F.lit(1.0)), F.lit(-1.0)))
    return F.struct(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)).alias("roll"), pitch.alias("pitch"), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)).alias("yaw"))


@bound
def rotate(q: Column, p: Column) -> Column:
    """p turned by a unit quaternion."""
    t = cross(q, p)
    u = cross(q, t)
    return vec(*(p[k] + 2 * (q["w"] * t[k] + u[k]) for k in "xyz"))


@bound
def transform(translation: Column, q: Column, p: Column) -> Column:
    """p into the pose's parent frame."""
    r = rotate(q, p)
    return vec(*(r[k] + translation[k] for k in "xyz"))


@bound
def inverse_transform(translation: Column, q: Column, p: Column) -> Column:
    return rotate(quat_conjugate(q), vec(*(p[k] - translation[k] for k in "xyz")))


@bound
def slerp(a: Column, b: Column, t: Column) -> Column:
    """The shorter arc; nearly equal rotations are blended in a line."""
    d = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    sign, d = F.when(d < 0, -1.0).otherwise(1.0), F.least(F.abs(d), F.lit(1.0))
    theta = F.acos(d)
    flat = d > 0.9995
    fa = F.when(flat, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * theta), F.sin(theta)))
    fb = F.when(flat, t).otherwise(F.try_divide(F.sin(t * theta), F.sin(theta))) * sign
    return quat_normalize(quat(*(a[k] * fa + b[k] * fb for k in "xyzw")))
