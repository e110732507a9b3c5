"""List and vector functions over array Columns. A null list gives null."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once a row even where lambdas in body mention it."""
    return F.get(F.transform(F.array(value), body), 0)


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Compute each Column argument once a row."""

    @functools.wraps(f)
    def call(*args, **named):
        at = next((i for i, a in enumerate(args) if isinstance(a, Column)), None)

        def bind(i: int, done: list) -> Column:
            if i == len(args):
                return f(*done, **named)
            if not isinstance(args[i], Column):
                return bind(i + 1, [*done, args[i]])
            return let(args[i], lambda v: bind(i + 1, [*done, v]))

        return f(*args, **named) if at is None else bind(0, [])

    return call


def _fold(a: Column, f, start: float = 0.0) -> Column:
    return F.aggregate(a, F.lit(start), lambda acc, x: acc + f(x.cast("double")))


def list_sum(a: Column) -> Column:
    return _fold(F.array_compact(a), lambda x: x)


def product(a: Column) -> Column:
    return F.aggregate(F.array_compact(a), F.lit(1.0), lambda acc, x: acc * x.cast("double"))


@bound
def mean(a: Column) -> Column:
    return F.try_divide(list_sum(a), F.size(F.array_compact(a)))


def sum_squares(a: Column) -> Column:
    return _fold(a, lambda x: x * x)


def l1_norm(a: Column) -> Column:
    return _fold(a, F.abs)


def l2_norm(a: Column) -> Column:
    return F.sqrt(sum_squares(a))


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


@bound
def var(a: Column) -> Column:
    """Sample variance."""
    return F.when(F.size(a) > 1, let(mean(a), lambda m: _fold(a, lambda x: (x - m) * (x - m))) / (F.size(a) - 1))


@bound
def std(a: Column) -> Column:
    return F.sqrt(var(a))


@bound
def median(a: Column) -> Column:
    s = F.array_sort(F.array_compact(a))
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low.cast("double") + high.cast("double")) / 2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


@bound
def cosine_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


@bound
def angular_distance(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine_similarity(a, b), F.lit(1.0)), F.lit(-1.0))) / F.pi()


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda acc, x: acc + x))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda acc, x: acc + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


@bound
def arg_max(a: Column) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(a, F.array_max(a)) - 1


@bound
def arg_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


@bound
def arg_sort(a: Column) -> Column:
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


@bound
def cum_sum(a: Column) -> Column:
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"] + x.cast("double"))).alias("out"), (s["sum"] + x.cast("double")).alias("sum"))
    return F.aggregate(a, start, step, lambda s: s["out"])


@bound
def diff(a: Column) -> Column:
    """First element null."""
    return F.transform(a, lambda x, i: F.when(i > 0, x - F.get(a, i - 1)))


@bound
def normalize(a: Column) -> Column:
    return let(l2_norm(a), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


@bound
def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = let(top, lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m)))
    return let(e, lambda v: let(_fold(v, lambda x: x), lambda total: F.transform(v, lambda x: x / total)))


@bound
def log_softmax(a: Column) -> Column:
    total = let(F.array_max(a), lambda m: F.log(_fold(a, lambda x: F.exp(x - m))) + m)
    return let(total, lambda z: F.transform(a, lambda x: x.cast("double") - z))


@bound
def entropy(a: Column) -> Column:
    """Natural-log entropy of weights that are scaled to sum one."""
    return let(list_sum(a), lambda total: -_fold(a, lambda x: F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0)))


@bound
def gather(a: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(a, i))


def has_all(a: Column, needles: Column) -> Column:
    return F.size(F.array_except(needles, a)) == 0


@bound
def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


@bound
def multiset_overlap(a: Column, b: Column) -> Column:
    """Elements in common, each as often as in the list that has it less often."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


@bound
def tail(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n))


@bound
def mean_pool(vectors: Column) -> Column:
    """Element-wise mean of a list of vectors."""
    width = F.size(F.get(vectors, 0))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: mean(F.transform(vectors, lambda v: F.get(v, i))))


@bound
def max_pool(vectors: Column) -> Column:
    width = F.size(F.get(vectors, 0))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_max(F.transform(vectors, lambda v: F.get(v, i))))


def is_zero_vector(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


@bound
def is_unit_norm(a: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(l2_norm(a) - 1) <= tolerance


@bound
def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence, one folded row of the table per element of a."""
    first = F.transform(b, lambda _: F.lit(0))

    def row(previous, x):
        start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("corner"))
        pairs = F.zip_with(b, previous, lambda y, up: F.struct(y.alias("y"), up.alias("up")))

        def cell(s, p):
            best = F.when(p["y"] == x, s["corner"] + 1).otherwise(F.greatest(s["left"], p["up"]))
            return F.struct(F.concat(s["row"], F.array(best)).alias("row"), best.alias("left"), p["up"].alias("corner"))

        return F.aggregate(pairs, start, cell, lambda s: s["row"])

    return F.coalesce(F.try_element_at(F.aggregate(a, first, row), F.lit(-1)), F.lit(0))
