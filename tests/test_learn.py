"""Order statistics, encoders and scores on small fixtures: edges that the registered queries don't reach."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import learn as L


def test_quantiles_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (10.0,)], "x double")
    assert tuple(L.quantiles(df, "x", [0, 0.5, 0.75, 1]).first()) == pytest.approx((1, 1.5, 4, 10))
    assert tuple(L.quantiles(df.limit(0), "x", [0.5]).first()) == (None,)
    assert {(r.x, r.r) for r in L.rank_transform(df, "x", "r").collect()} == {(1.0, 0.0), (2.0, 2 / 3), (10.0, 1.0), (None, None)}


def test_robust_means(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 1000)], "x double")
    assert L.trimmed_mean(df, "x", 0.2).first()[0] == pytest.approx(3)
    assert L.winsorized_mean(df, "x", 0.25).first()[0] == pytest.approx(3)
    assert L.median_abs_deviation(df, "x", 1).first()[0] == pytest.approx(1)


def test_concentration_of_one_value(spark):
    row = L.concentration(spark.createDataFrame([("a",), ("a",), (None,)], "c string"), "c").first()
    assert (row.entropy, row.normalized_entropy, row.herfindahl_index, row.mode_share) == (0, 0, 1, 1)


def test_encoders_keep_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 0), (None, 1)], "c string, y int")
    woe = sorted((str(r.c), r.y, round(r.w, 6)) for r in L.woe_encode(df, "c", F.col("y") == 1, "w").collect())
    assert woe == [("None", 0, -0.405465), ("None", 1, -0.405465), ("a", 0, -0.405465), ("a", 1, -0.405465), ("b", 1, 0.0)]
    loo = sorted((str(r.c), r.y, r.e) for r in L.leave_one_out_encode(df, "c", "y", "e").collect())
    assert loo == [("None", 0, 1.0), ("None", 1, 0.0), ("a", 0, 1.0), ("a", 1, 0.0), ("b", 1, 0.6)]
    assert {(r.c, r.c_0, r.c_1) for r in L.binary_encode(df, "c", 2).collect()} == {("a", 1, 0), ("b", 0, 1), (None, 0, 0)}
    with pytest.raises(Exception, match="more categories"):
        L.binary_encode(df, "c", 1).collect()


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in range(8)] + [(None,)], "x double")
    assert [r.b for r in L.bin_uniform(df, "x", 4, "b").orderBy("x").collect()] == [None, 0, 0, 1, 1, 2, 2, 3, 3]
    assert [r.b for r in L.bin_quantile(df, "x", 2, "b").orderBy("x").collect()] == [None, 0, 0, 0, 0, 1, 1, 1, 1]
    assert {r.b for r in L.bin_uniform(df.where("x = 3"), "x", 4, "b").collect()} == {0}


def test_ranked_perfect_and_reversed(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "s double, y boolean")
    row = L.ranked(df, F.col("y"), F.col("s")).first()
    assert tuple(row) == pytest.approx((1, 1, 1, 1, 1, 0.8))
    assert L.ranked(df, ~F.col("y"), F.col("s")).first().roc_auc == 0


def test_majority_and_packing(spark):
    votes = spark.createDataFrame([("a", "b", "b"), ("b", "a", None), (None, None, None)], "x string, y string, z string")
    assert [r[0] for r in votes.select(L.majority("x", "y", "z")).collect()] == ["b", "a", None]
    docs = spark.createDataFrame([(1, 5), (2, 0), (3, 9), (4, None)], "k long, n int")
    got = sorted(map(tuple, L.packed(docs, "k", F.col("n"), 4).collect()))
    assert got == [(1, 0, 0, 0, 4), (1, 1, 0, 4, 1), (3, 1, 1, 0, 3), (3, 2, 0, 3, 4), (3, 3, 0, 7, 2)]
