"""Queries that must read whole texts, against brute force."""

import pytest

from millrace.functions import sequences
from millrace.plans import catalogue
from tests.oracle import connect, difference

LONG = "Ae Io, [x] fooBar eia " * 40 + "The End. aeioaei"
TEXTS = {1: LONG, 2: LONG[:-3] + "zzz", 3: "", 4: "a e  i", 5: None}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def values(spark, sf, name):
    return {r.doc_id: r.value for r in catalogue.queries()[name](spark, sf).collect()}


def bases(t):
    return "".join({"a": "A", "e": "C", "i": "G", "o": "T"}.get(x, "") for x in t.lower())


def protein(s):
    order = {b: i for i, b in enumerate("TCAG")}
    return "".join(sequences._CODE[order[s[i]] * 16 + order[s[i + 1]] * 4 + order[s[i + 2]]] for i in range(0, len(s) - 2, 3))


def test_translate_and_minhash_read_whole_texts(spark, sf):
    assert values(spark, sf, "seq_translate") == {k: t if t is None else protein(bases(t)) for k, t in TEXTS.items()}
    # the same first 300 characters, other tails
    tails = [" ".join(f"w{k}" for k in range(200)) + " " + " ".join(f"t{n}x{k}" for k in range(200)) for n in range(4)]
    d = sf + "/tails"
    spark.createDataFrame(list(enumerate(tails)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert len(set(values(spark, d, "str_minhash").values())) == 4


@pytest.mark.parametrize("name", ["seq_kmers", "seq_transcribe", "seq_reverse_complement", "verb_explode"])
def test_whole_forms(spark, sf, name):
    if name == "verb_explode":
        got = catalogue.queries()[name](spark, sf).collect()
        assert sorted((r.doc_id, r.w) for r in got) == sorted((k, w) for k, t in TEXTS.items() if t is not None for w in t.split(" "))
        return
    f = {"seq_kmers": lambda s: ",".join(s[i : i + 4] for i in range(len(s) - 3)), "seq_transcribe": lambda s: s.replace("T", "U"), "seq_reverse_complement": lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))}[name]
    assert values(spark, sf, name) == {k: t if t is None else f(bases(t)) for k, t in TEXTS.items()}


def test_pagerank_uses_every_lineitem_edge(spark, tmp_path):
    pairs = {(s, (7 * s + k * k) % 61) for s in range(1, 50) for k in range(6)}
    spark.createDataFrame([*pairs, *list(pairs)[:9]], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    ids = {v for e in pairs for v in e}
    out = {v: [b for a, b in pairs if a == v] for v in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(5):
        loose = sum(rank[v] for v in ids if not out[v])
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * loose / len(ids))
        for v in ids:
            for b in out[v]:
                new[b] += 0.85 * rank[v] / len(out[v])
        rank = new
    got = {r.id: r["rank"] for r in catalogue.queries()["graph_pagerank"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(rank)


@pytest.mark.parametrize("name,least", [("metric_roc_auc", 1), ("join_full", 150), ("graph_triangles", 3), ("graph_bfs", 100)])
def test_whole_tables(spark, name, least):
    """On sf0.01, where ids go past the parts that the other SQL reads, so more than one path and triangle counts."""
    sf = "/root/testdata/sf0.01"
    assert difference(spark, con := connect(sf), sf, catalogue.queries()[name], sql := catalogue.oracle_sql()[name]) is None
    assert len(con.execute(sql).fetchall()) >= least
