"""Graph operators and table verbs against brute force on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import dataset, graph, quality


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(6)
    return [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(50, 51), (51, 52), (52, 50), (60, 60)]


def test_connected_components(spark, edges):
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == root


def test_k_core(spark, edges):
    near = {v: set() for e in edges for v in e}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    while any(len(n) < 2 for n in near.values()):
        near = {v: n for v, n in near.items() if len(n) >= 2}
        near = {v: n & near.keys() for v, n in near.items()}
    assert {r.id for r in graph.k_core(spark.createDataFrame(edges, "src long, dst long"), 2).collect()} == set(near)


def test_hits(spark):
    edges = [(0, 1), (0, 2), (1, 2), (3, 2), (3, 1)]
    a = np.zeros((4, 4))
    for s, d in edges:
        a[s, d] = 1
    hub = np.ones(4)
    for _ in range(6):
        authority = a.T @ hub
        authority /= np.linalg.norm(authority)
        hub = a @ authority
        hub /= np.linalg.norm(hub)
    got = {r.id: (r.hub, r.authority) for r in graph.hits(spark.createDataFrame(edges, "src long, dst long"), 6).collect()}
    assert all(got[i] == pytest.approx((hub[i], authority[i])) for i in range(4))


def test_bfs_goes_as_far_as_edges_lead(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(25)], "src long, dst long")
    assert {r.id: r.distance for r in graph.bfs(chain, 0).collect()} == {i: i for i in range(26)}


def test_splits_are_whole_and_repeatable(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS k")
    parts = [sorted(r.id for r in p.collect()) for p in dataset.split_proportionately(df, [1, 1, 2], ["id"])]
    assert sorted(sum(parts, [])) == list(range(1000)) and abs(len(parts[2]) - 500) < 80
    assert parts == [sorted(r.id for r in p.repartition(7).collect()) for p in dataset.split_proportionately(df, [1, 1, 2], ["id"])]
    some, rest = dataset.stratified_split(df, "k", 0.1, ["id"])
    assert sorted(r["count"] for r in some.groupBy("k").count().collect()) == [34, 34, 34] and rest.count() == 898
    assert [p.count() for p in dataset.split_at_indices(df, [10, 400], "id")] == [10, 390, 600]


def test_map_batches_tries_again(spark, tmp_path):
    def once_broken(batch: pa.RecordBatch) -> pa.RecordBatch:
        mark = tmp_path / str(batch.column(0)[0])
        if not mark.exists():
            mark.touch()
            raise ValueError("first time")
        return batch

    assert dataset.map_batches(spark.range(10), once_broken, "id long", retries=1).count() == 10


def test_schema_faults(spark):
    df = spark.range(1).selectExpr("id", "'x' AS s")
    assert quality.schema_faults(df, {"id": "bigint", "s": "string"}, extra=False) == []
    assert quality.schema_faults(df, {"id": "int", "t": "string"}, extra=False) == ["id is bigint, not int", "t is missing", "s is unexpected"]
    with pytest.raises(ValueError):
        quality.compare_columns("id", "; drop", "s")
