"""Edges that the shared tables don't hold."""

from pyspark.sql import functions as F

from millrace.functions import lists, numeric, text
from millrace.operators import joins, relational


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_division(spark):
    v = lambda a, b: one(spark, numeric.truediv(F.lit(a), F.lit(b)))
    assert v(1.0, 0.0) == float("inf") and v(-1.0, 0.0) == float("-inf") and v(0.0, 0.0) != v(0.0, 0.0)
    assert one(spark, numeric.floordiv(F.lit(-7), F.lit(2))) == -4
    assert one(spark, numeric.truncdiv(F.lit(-7), F.lit(2))) == -3
    assert one(spark, numeric.truncdiv(F.lit(-7), F.lit(0))) is None


def test_gcd_lcm(spark):
    assert one(spark, numeric.gcd(F.lit(0), F.lit(0))) == 0
    assert one(spark, numeric.gcd(F.lit(-12), F.lit(18))) == 6
    assert one(spark, numeric.lcm(F.lit(4), F.lit(6))) == 12


def test_text_edges(spark):
    assert one(spark, text.regexp_replace_first(F.lit("aXbXc"), "X", "-")) == "a-bXc"
    assert one(spark, text.zfill(F.lit("-7"), 4)) == "-007"
    assert one(spark, text.pad_start(F.lit("long"), 2)) == "long"
    assert one(spark, text.char_entropy(F.lit("aabb"))) == 1.0
    assert one(spark, text.top_ngram_ratio(F.lit("a b a b c"), 2)) == 0.5
    assert one(spark, text.camel_case(F.lit("Hello big-World"))) == "helloBigWorld"
    assert one(spark, text.strip_html(F.lit("<p>a<script>x<1</script> &lt;b&amp;c</p>"))) == "a <b&c"


def test_lcs(spark):
    a, b = (F.array(*map(F.lit, s)) for s in ("ABCBDAB", "BDCABA"))
    assert one(spark, lists.lcs_length(a, b)) == 4


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (None, 5), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (None, 5, "n")], "k int, t int, v string")
    got = lambda **kw: sorted(((r.k or 0, r.t, r.v) for r in joins.asof_join(left, right, "t", ["k"], **kw).collect()), key=str)
    assert got() == sorted([(1, 5, "a"), (1, 10, "b"), (0, 5, None), (2, 1, None)], key=str)
    assert got(allow_exact=False) == sorted([(1, 5, None), (1, 10, "b"), (0, 5, None), (2, 1, None)], key=str)
    assert got(direction="forward") == sorted([(1, 5, "a"), (1, 10, None), (0, 5, None), (2, 1, None)], key=str)
    assert got(tolerance=F.lit(2)) == sorted([(1, 5, "a"), (1, 10, None), (0, 5, None), (2, 1, None)], key=str)


def test_sample_ignores_partitioning(spark):
    df = spark.range(1000)
    a, b = (sorted(r.id for r in relational.sample(d, 0.2, seed=5).collect()) for d in (df, df.repartition(7)))
    assert a == b and 100 < len(a) < 300


def test_split_shares(spark):
    df = relational.split_by_hash(spark.range(2000), "id", {"train": 0.7, "val": 0.2, "test": 0.1})
    n = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(n.values()) == 2000 and 1300 < n["train"] < 1500 and 330 < n["val"] < 470 and 140 < n["test"] < 260


def test_row_index(spark):
    df = relational.with_row_index(spark.range(100).repartition(5), order_by="id", offset=3)
    assert all(r["index"] == r.id + 3 for r in df.collect())


def test_full_join_deals_out_a_large_key(spark):
    """Pairs of one key go to several tasks, each once; nulls match nothing."""
    left = spark.range(3000).select(F.lit(1).alias("k"), "id").union(spark.createDataFrame([(None, -1), (2, -2), (3, -3)], "k int, id long"))
    right = spark.range(400).select(F.lit(1).alias("k"), "id").union(spark.createDataFrame([(None, -4), (4, -5), (3, -6), (3, -7)], "k int, id long"))
    got = relational.join(left, right, "k", "full")
    assert got.columns == ["k", "id", "id_right"]
    pairs = got.where("k = 1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("id") * 400 + F.col("id_right")).alias("s"), F.countDistinct("id", "id_right").alias("d")).collect()
    total = 3000 * 400
    assert sum(r.n for r in pairs) == sum(r.d for r in pairs) == total and sum(r.s for r in pairs) == total * (total - 1) // 2
    assert max(r.n for r in pairs) < 0.8 * total
    rest = sorted(((r.k, r.id, r.id_right) for r in got.where("k is null or k > 1").collect()), key=repr)
    assert rest == sorted([(None, -1, None), (None, None, -4), (2, -2, None), (3, -3, -6), (3, -3, -7), (4, None, -5)], key=repr)
