"""Graph algorithms over an edge table (src, dst), as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """id, triangles: pairs are directed from the vertex of lower degree, so that hubs don't make quadratic pairs."""
    e = undirected(edges)
    deg = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    tagged = e.join(deg.withColumnsRenamed({"v": "a", "d": "da"}), "a").join(deg.withColumnsRenamed({"v": "b", "d": "db"}), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    directed = tagged.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    one, two = directed.withColumnsRenamed({"y": "m"}), directed.withColumnsRenamed({"y": "n"})
    wedges = one.join(two, "x").where("m < n")
    found = wedges.join(e, (F.col("m") == F.col("a")) & (F.col("n") == F.col("b")))
    return found.select(F.explode(F.array("x", "m", "n")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id, rank (sums to one): rank of vertices without outgoing edges is spread evenly."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = staged(edges.join(out, "src").select("src", "dst", "out"), "links")
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        given = links.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        kept = ranks.join(out, F.col("id") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        ranks = ids.join(given, F.col("id") == F.col("dst"), "left").join(F.broadcast(kept)).select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))  # one row
        if k % 2 and k < rounds - 1:  # the lineage doubles with every round
            ranks = staged(ranks, "ranks")
    return ranks


def bfs(edges: DataFrame, start: int, max_depth: int | None = None) -> DataFrame:
    """id, distance in hops along edges from start; as far as edges lead, or to max_depth where one is given."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id long, distance int")
    frontier = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = edges.join(frontier, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(depth))
        nxt = staged(nxt, "frontier")
        if nxt.isEmpty():
            break
        seen, frontier = seen.unionByName(nxt), nxt
    return seen


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, common, jaccard for given pairs of vertices."""
    e = undirected(edges)
    near = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
    deg = near.groupBy("v").agg(F.count("*").alias("d"))
    shared = pairs.join(near.withColumnsRenamed({"v": "a"}), "a").join(near.withColumnsRenamed({"v": "b"}), ["b", "u"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    out = pairs.join(shared, ["a", "b"], "left").join(deg.withColumnsRenamed({"v": "a", "d": "da"}), "a", "left").join(deg.withColumnsRenamed({"v": "b", "d": "db"}), "b", "left")
    common, da, db = (F.coalesce(c, F.lit(0)) for c in ("common", "da", "db"))
    return out.select("a", "b", common.alias("common"), F.coalesce(F.try_divide(common, da + db - common), F.lit(0.0)).alias("jaccard"))


def _both_ways(edges: DataFrame) -> DataFrame:
    e = undirected(edges)
    return e.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("to")))


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (least id that undirected paths reach) of every vertex.

    Alternating large-star and small-star steps until the links no longer change: min-aggregates and
    joins, so that no neighbour list is gathered.
    """
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    links = staged(undirected(edges).select(F.col("b").alias("a"), F.col("a").alias("b")), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            break
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))
        links = staged(large.join(low, "a").select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "links")
    return ids.join(links, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The vertices that stay when those with fewer than k neighbours are taken away, again and again."""
    near, size = staged(_both_ways(edges), "core"), None
    while True:
        keep = near.groupBy("id").agg(F.count("*").alias("d")).where(F.col("d") >= k).select("id")
        near = staged(near.join(keep, "id", "left_semi").join(keep.withColumnRenamed("id", "to"), "to", "left_semi").select("id", "to"), "core")
        now = near.count()
        if now == size or not now:
            return near.select("id").distinct()
        size = now


def hits(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, hub, authority, each of length one over all vertices."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    scores = ids.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"))

    def spread(scores: DataFrame, give: str, take: str, source: str, target: str) -> DataFrame:
        got = edges.join(scores, F.col(source) == F.col("id")).groupBy(F.col(target).alias("to")).agg(F.sum(give).alias("got"))
        got = scores.drop(take).join(got, F.col("id") == F.col("to"), "left").select("id", give, F.coalesce("got", F.lit(0.0)).alias(take))
        length = got.agg(F.sqrt(F.sum(F.col(take) * F.col(take))).alias("length"))
        return got.join(F.broadcast(length)).select("id", give, F.coalesce(F.try_divide(take, "length"), F.lit(0.0)).alias(take))  # one row

    for _ in range(rounds):
        scores = staged(spread(scores, "hub", "authority", "src", "dst"), "hits")
        scores = staged(spread(scores, "authority", "hub", "dst", "src"), "hits")
    return scores.select("id", "hub", "authority")


def pair_scores(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, adamic_adar, resource_allocation, preferential_attachment of given pairs of vertices."""
    near = _both_ways(edges)
    deg = near.groupBy("id").agg(F.count("*").alias("d"))
    one, two = near.select(F.col("id").alias("a"), F.col("to").alias("u")), near.select(F.col("id").alias("b"), F.col("to").alias("u"))
    shared = pairs.join(one, "a").join(two, ["b", "u"]).join(deg, F.col("u") == F.col("id"))
    sums = shared.groupBy("a", "b").agg(F.sum(F.try_divide(F.lit(1.0), F.ln("d"))).alias("aa"), F.sum(1 / F.col("d")).alias("ra"))
    out = pairs.join(sums, ["a", "b"], "left").join(deg.withColumnsRenamed({"id": "a", "d": "da"}), "a", "left").join(deg.withColumnsRenamed({"id": "b", "d": "db"}), "b", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("a", "b", zero("aa").alias("adamic_adar"), zero("ra").alias("resource_allocation"), F.coalesce(F.col("da") * F.col("db"), F.lit(0)).cast("long").alias("preferential_attachment"))
