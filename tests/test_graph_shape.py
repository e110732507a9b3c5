"""Shape of graphs against brute force on a small fixture."""

import random

import numpy as np
import pytest

from millrace.operators import graph_shape as S


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    return [(rng.randrange(20), rng.randrange(20)) for _ in range(50)] + [(30, 31), (31, 30), (40, 40)]


@pytest.fixture(scope="module")
def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def adjacency(pairs):
    ids = sorted({v for e in pairs for v in e})
    a = np.zeros((len(ids), len(ids)))
    for s, d in pairs:
        a[ids.index(s), ids.index(d)] += 1
    return ids, a


def test_katz(edges, pairs):
    ids, a = adjacency(pairs)
    x = np.ones(len(ids))
    for _ in range(5):
        x = 1 + 0.1 * a.T @ x
    got = {r.id: r.katz_centrality for r in S.katz_centrality(edges, rounds=5).collect()}
    assert [got[i] for i in ids] == pytest.approx(list(x / np.linalg.norm(x)))


def test_personalized_pagerank(spark, edges, pairs):
    ids, a = adjacency(pairs)
    home = np.array([float(i in (0, 30)) for i in ids]) / 2
    rank, out = home, a.sum(1)
    for _ in range(4):
        loose = rank[out == 0].sum()
        rank = home * (0.15 + 0.85 * loose) + 0.85 * (a / np.maximum(out, 1)[:, None]).T @ rank
    got = {r.id: r["rank"] for r in S.personalized_pagerank(edges, spark.createDataFrame([(0,), (30,)], "id long"), 4).collect()}
    assert [got[i] for i in ids] == pytest.approx(list(rank))
    assert sum(got.values()) == pytest.approx(1)


def test_walks_follow_edges(spark, edges, pairs):
    starts = spark.createDataFrame([(v,) for v in range(20)], "id long")
    rows = S.random_walks(edges, starts, 4).collect()
    at = {(r.walk, r.step): r.id for r in rows}
    assert len(at) == len(rows) and all(at[v, 0] == v for v in range(20))
    out = {s for s, d in pairs if s != d}
    for (walk, step), v in at.items():
        if step:
            assert (at[walk, step - 1], v) in pairs and v != at[walk, step - 1]
        if step < 4:
            assert ((walk, step + 1) in at) == (v in out)
    assert sorted(map(tuple, S.random_walks(edges.repartition(5), starts, 4).collect())) == sorted(map(tuple, rows))


def test_samples(edges, pairs):
    plain = {e for e in pairs if e[0] != e[1]}
    got = {tuple(r) for r in S.neighbor_sample(edges, 2).collect()}
    assert got <= plain
    for v in {s for s, _ in plain}:
        assert sum(s == v for s, _ in got) == min(2, sum(s == v for s, _ in plain))
    assert S.node_sample(edges, 1.0).count() == len({v for e in pairs for v in e}) and S.edge_sample(edges, 0.0).count() == 0


def test_ego_and_components(spark, edges, pairs):
    near = {0} | {d for s, d in pairs if s == 0}
    assert sorted(map(tuple, S.ego_network(edges, 0, 1).collect())) == sorted(e for e in pairs if e[0] in near and e[1] in near)
    assert not S.is_connected(edges).first().connected and S.is_connected(edges.limit(0)).first().connected
    small = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "src long, dst long")
    assert sorted(map(tuple, S.largest_component(small).collect())) == [(1, 2), (2, 3)]
    assert {tuple(r) for r in S.component_sizes(small).collect()} == {(1, 3), (8, 2)}


def test_features(spark):
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 4)], "src long, dst long")
    f = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 0.0), (4, 5.0)], "id long, x double")
    assert {tuple(r) for r in S.aggregate_neighbors(e, f, ["x"]).collect()} == {(1, None), (2, None), (3, 15.0), (4, 0.0)}
    assert {(r.id, r.x_1, r.x_2) for r in S.propagate_features(e, f, ["x"], 2).collect()} == {(1, None, None), (2, None, None), (3, 15.0, None), (4, 0.0, 15.0)}


def test_star_is_disassortative(spark):
    star = spark.createDataFrame([(i, 0) for i in range(1, 5)], "src long, dst long")
    assert S.assortativity(star).first().assortativity == pytest.approx(-1)
    assert {(r.id, round(r.degree_centrality, 6)) for r in S.degree_centrality(star).collect()} == {(0, 1.0), *((i, 0.25) for i in range(1, 5))}
    assert S.summarize(star.limit(0)).first().nodes == 0
