"""Row-wise numeric functions over Columns. Nulls give null unless said otherwise."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def truediv(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity with x's sign, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def floordiv(a: Column, b: Column) -> Column:
    """Division rounded down; a zero divisor gives null."""
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def truncdiv(a: Column, b: Column) -> Column:
    """Integer division toward zero; a zero divisor gives null."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def even(x: Column) -> Column:
    """Away from zero to the next even integer."""
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


def clip(x: Column, low=None, high=None) -> Column:
    """Bounded from below and above; null stays null."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def is_even(x: Column) -> Column:
    return x % 2 == 0


def is_odd(x: Column) -> Column:
    return x % 2 != 0


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == INF


def cut(x: Column, breaks: list[float], labels: list[str], left_closed: bool = False) -> Column:
    """The label of the interval that x falls in; labels are one more than breaks."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("one label more than breaks is needed")
    out = F.lit(labels[-1])
    for b, name in reversed(list(zip(breaks, labels, strict=False))):
        out = F.when((x < b) if left_closed else (x <= b), F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)


def to_base(x: Column, base: int) -> Column:
    return F.lower(F.conv(x.cast("string"), 10, base))


def format_bytes(n: Column, si: bool = False, largest: str | None = None) -> Column:
    """Bytes with one decimal in the largest unit that keeps at least 1, up to the unit named largest."""
    step, units = (1000.0, ["B", "kB", "MB", "GB", "TB", "PB"]) if si else (1024.0, ["B", "KiB", "MiB", "GiB", "TiB", "PiB"])
    if largest is not None:
        units = units[: units.index(largest) + 1]
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(F.abs(n) >= step**k, F.concat(F.format_string("%.1f", n / F.lit(step**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


# Activations.


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * (F.exp(x) - 1))


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(F.lit((2 / pi) ** 0.5) * (x + 0.044715 * x * x * x)))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def mish(x: Column) -> Column:
    return x * F.tanh(softplus(x))


def softsign(x: Column) -> Column:
    return x / (1 + F.abs(x))


def hardtanh(x: Column) -> Column:
    return clip(x, -1.0, 1.0)


def hardsigmoid(x: Column) -> Column:
    return clip(x / 6 + 0.5, 0.0, 1.0)


def hardswish(x: Column) -> Column:
    return x * hardsigmoid(x)


def tanhshrink(x: Column) -> Column:
    return x - F.tanh(x)


# Row-wise reductions over several columns; nulls are skipped.


def sum_horizontal(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols))


def count_horizontal(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cols))


def mean_horizontal(*cols: Column) -> Column:
    return F.try_divide(sum_horizontal(*cols), count_horizontal(*cols))


def product_horizontal(*cols: Column) -> Column:
    return reduce(lambda a, b: a * b, (F.coalesce(c.cast("double"), F.lit(1.0)) for c in cols))


def min_horizontal(*cols: Column) -> Column:
    return F.least(*cols)


def max_horizontal(*cols: Column) -> Column:
    return F.greatest(*cols)


def all_horizontal(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, cols)


def any_horizontal(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, cols)


def fold_horizontal(start: Column, function, *cols: Column) -> Column:
    return reduce(function, cols, start)


def reduce_horizontal(function, *cols: Column) -> Column:
    return reduce(function, cols)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, unrolled over a sequence long enough for 64-bit values."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(a * b), gcd(a, b)).cast("long"), F.lit(0))


def great_circle_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    """Haversine distance in the radius's unit."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
