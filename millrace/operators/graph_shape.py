"""Shape, neighbourhoods and path scores of a graph given as an edge table (src, dst) or (src, dst, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import bfs, connected_components, degrees, undirected
from .staging import staged


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def _ends(edges: DataFrame, *extra: str) -> DataFrame:
    return edges.select(F.col("src").alias("id"), *extra).unionByName(edges.select(F.col("dst").alias("id"), *extra))


def vertices(edges: DataFrame) -> DataFrame:
    return _ends(edges).distinct()


def weighted_degree(edges: DataFrame) -> DataFrame:
    """id, weighted_degree: the weight at both ends; a loop counts twice."""
    return _ends(edges, "weight").groupBy("id").agg(F.sum("weight").alias("weighted_degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """degree, nodes."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """id, degree_centrality: the degree over the number of other vertices."""
    d = degrees(edges)
    n = d.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    return d.join(F.broadcast(n)).select("id", (F.col("degree") / F.col("others")).alias("degree_centrality"))  # one row


def isolated_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ids of a vertex table (id) that no edge has."""
    return nodes.select("id").distinct().join(vertices(edges), "id", "left_anti")


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def summarize(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, reciprocity, average_degree, max_degree. Density and reciprocity are of distinct edges without loops."""
    d = degrees(edges).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"), F.max("degree").alias("max_degree"))
    s = simple(edges)
    marked = s.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("ways"))
    e = marked.agg(F.coalesce(F.sum("ways"), F.lit(0)).alias("plain"), F.coalesce(F.sum(F.when(F.col("ways") == 2, 2)), F.lit(0)).alias("mutual"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return d.join(F.broadcast(e)).select(  # one row
        "nodes",
        (F.col("ends") / 2).cast("long").alias("edges"),
        zero(F.try_divide("plain", possible)).alias("density"),
        zero(F.try_divide("mutual", "plain")).alias("reciprocity"),
        zero(F.try_divide("ends", "nodes")).alias("average_degree"),
        "max_degree",
    )


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: the correlation of the degrees at the two ends of an edge, either way round; 0 where it has none."""
    e = undirected(edges)
    deg = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("d"))
    both = e.join(deg.withColumnsRenamed({"v": "a", "d": "x"}), "a").join(deg.withColumnsRenamed({"v": "b", "d": "y"}), "b").select("x", "y")
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y")))
    r = F.corr("x", "y")
    return both.agg(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("assortativity"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """component, nodes."""
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component of most vertices; of equal ones that of the least id."""
    cells = staged(connected_components(edges), "cells")
    best = cells.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = cells.join(F.broadcast(best), "component", "left_semi").select(F.col("id").alias("src"))  # one row
    return edges.join(inside, "src", "left_semi")


def is_connected(edges: DataFrame) -> DataFrame:
    """One row: do undirected paths join all vertices? True of a graph without any."""
    return connected_components(edges).agg((F.count_distinct("component") <= 1).alias("connected"))


def aggregate_neighbors(edges: DataFrame, features: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """id and, for each column, its mean, sum, max or min over the sources of a vertex's incoming edges; null where there are none."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]
    sent = edges.select("src", "dst").join(features.select(F.col("id").alias("src"), *(F.col(x).cast("double").alias(x) for x in columns)), "src")
    got = sent.groupBy(F.col("dst").alias("id")).agg(*(f(x).alias(f"{x}_{how}") for x in columns))
    return features.select("id").join(got, "id", "left")


def propagate_features(edges: DataFrame, features: DataFrame, columns: Sequence[str], hops: int) -> DataFrame:
    """id, columns and their means over neighbours of neighbours, hop by hop, as column_1 ... column_hops; a vertex that nothing reaches sends nothing on."""
    out = now = staged(features.select("id", *(F.col(x).cast("double").alias(x) for x in columns)), "features")
    for k in range(1, hops + 1):
        now = staged(aggregate_neighbors(edges, now, columns).withColumnsRenamed({f"{x}_mean": x for x in columns}), "features")
        out = out.join(now.withColumnsRenamed({x: f"{x}_{k}" for x in columns}), "id")
    return out


def _drawn(seed: int, *columns: str) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def node_sample(edges: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The vertices whose hash is within the fraction, whatever the partitions."""
    return vertices(edges).where(F.pmod(_drawn(seed, "id"), F.lit(1 << 40)) < int(fraction * (1 << 40)))


def edge_sample(edges: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return edges.where(F.pmod(_drawn(seed, "src", "dst"), F.lit(1 << 40)) < int(fraction * (1 << 40)))


def neighbor_sample(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k distinct edges out of each vertex, those of the least hash.

    A hub's edges are first cut to k within each of 64 parts, so that no task sorts all of them.
    """
    ranked = simple(edges).withColumns({"_h": _drawn(seed, "src", "dst"), "_part": F.pmod(F.xxhash64("dst"), F.lit(64))})
    for by in (["src", "_part"], ["src"]):
        ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "dst"))).where(F.col("_k") <= k)
    return ranked.select("src", "dst")


def random_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """walk, step, id: walks of so many steps from each start (id), a step along an edge drawn by hash; a walk ends where no edge leads on.

    The edges of each vertex are numbered once, within 64 parts of a hub's, and a step joins the walks on vertex and number.
    """
    parts = simple(edges).withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(64)))
    before = parts.groupBy("src", "part").agg(F.count("*").alias("n"))
    before = before.select("src", "part", (F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("src", "part").orderBy("dst")) - 1
    out = staged(parts.withColumn("own", own).join(before, ["src", "part"]).select("src", "dst", (F.col("before") + F.col("own")).alias("k")), "steps")
    count = out.groupBy("src").agg(F.count("*").alias("n"))
    now = starts.select(F.col("id").alias("walk"), F.lit(0).alias("step"), "id").distinct()
    walks = [staged(now, "walks")]
    for step in range(1, length + 1):
        drawn = walks[-1].join(count, F.col("id") == F.col("src")).select("walk", "src", F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed)), F.col("n")).alias("k"))
        walks.append(staged(drawn.join(out, ["src", "k"]).select("walk", F.lit(step).alias("step"), F.col("dst").alias("id")), "walks"))
    whole = walks[0]
    for more in walks[1:]:
        whole = whole.unionByName(more)
    return whole


def ego_network(edges: DataFrame, center: int, radius: int = 1) -> DataFrame:
    """The edges between vertices within so many hops of the center, along edges' directions."""
    if radius < 0:
        raise ValueError("a radius can't be negative")
    near = staged(bfs(edges, center, radius).select("id"), "near")
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def personalized_pagerank(edges: DataFrame, sources: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """id, rank (sums to one) of a surfer who goes back to the sources (id), also from vertices without edges out."""
    home = sources.select("id").distinct().withColumn("home", F.lit(True))
    share = home.agg((1 / F.count("*")).alias("share"))
    ids = vertices(edges).unionByName(sources.select("id")).distinct().join(home, "id", "left").join(F.broadcast(share))  # one row
    ids = staged(ids.select("id", F.when(F.col("home"), F.col("share")).otherwise(0.0).alias("base")), "base")
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = staged(edges.join(out, "src").select("src", "dst", "out"), "links")
    ranks = ids.select("id", F.col("base").alias("rank"))
    for _ in range(rounds):
        given = links.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        loose = ranks.join(out, F.col("id") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        ranks = ids.join(given, F.col("id") == F.col("dst"), "left").join(F.broadcast(loose))  # one row
        ranks = staged(ranks.select("id", (F.col("base") * (1 - damping + damping * F.col("loose")) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "ranks")
    return ranks


def katz_centrality(edges: DataFrame, attenuation: float = 0.1, baseline: float = 1.0, rounds: int = 20) -> DataFrame:
    """id, katz_centrality: baseline plus attenuation times the scores that incoming edges bring, after so many rounds; scaled to length one."""
    ids = staged(vertices(edges), "ids")
    scores = ids.withColumn("x", F.lit(float(baseline)))
    for _ in range(rounds):
        got = edges.join(scores, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("x").alias("got"))
        scores = staged(ids.join(got, F.col("id") == F.col("dst"), "left").select("id", (baseline + attenuation * F.coalesce("got", F.lit(0.0))).alias("x")), "katz")
    length = scores.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return scores.join(F.broadcast(length)).select("id", F.try_divide("x", "length").alias("katz_centrality"))  # one row
