import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import jaccard
from millrace.llm.common import connected_components
from millrace.llm.jaccard import _band, jaccard_components, keep_one_per_group
from millrace.llm.shingles import shingle_sets


def shingles(text):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def families(seed):
    """Families with edits near the threshold, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(60))
    passage = [word() for _ in range(50)]
    texts, n = {}, 0
    for _ in range(14):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += passage
            texts[n] = " ".join(copy)
            n += 1
    return texts


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}


def test_families_match_brute_force(spark):
    for seed in (1, 2):
        texts = families(seed)
        assert run(spark, list(texts.items())) == brute(texts)


def test_hot_regions_by_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 6)
    monkeypatch.setattr(jaccard, "HOT_COPIES", 3)
    monkeypatch.setattr(jaccard, "_PER_SALT", 4)
    monkeypatch.setattr(jaccard, "_LARGE", 5)
    rng, texts = random.Random(9), families(3)
    base = [f"w{i}" for i in range(200)]
    for n in range(1000, 1080):  # a large group of copies that all differ, beyond the radius too
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(200)] = f"v{rng.randrange(99)}"
        texts[n] = " ".join(copy)
    assert run(spark, list(texts.items())) == brute(texts)


def test_repeated_doc_ids_are_rows_of_their_own(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, one), (5, two), (9, two), (3, one + " c"), (7, "alone here"), (None, one), (7, "alone here")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(3, 27, 3), (5, 26, 3), (5, 26, 5), (7, 1, 7), (7, 1, 7), (9, 26, 5)]
    kept = keep_one_per_group(spark.createDataFrame([(a, b, "x", n) for n, (a, b) in enumerate(rows)], "doc_id long, text string, least string, row int"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, one), (3, one + " c"), (5, two), (7, "alone here")])


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, "x " * 20000), (8, "x " * 30000)]
    got = run(spark, rows)
    assert got == brute(dict(rows)) and got[4] == (1, 4) and got[5] == (1, 4) and got[8] == (1, 7)
    assert run(spark, []) == {}


def test_keep_one_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "p"), (2, "a b c d e f", "q"), (None, "z", "r"), (3, "other words", "s")], "doc_id long, text string, component string")
    kept = keep_one_per_group(df)
    assert kept.columns == df.columns and sorted(r.component for r in kept.collect()) == ["p", "r", "s"]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tAé", max_size=30), max_size=6))
def test_shingle_counts(texts):
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_bands_of_exact_ties_meet(spark):
    """Distances that differ by exactly 0.2 are in the same band or in neighbouring ones."""
    rows = [(t - d, t) for t in range(1, 121) for d in range(t + 1)]
    far = {(r.common, r.total): r.band for r in spark.createDataFrame(rows, "common long, total long").select("common", "total", _band().alias("band")).collect()}
    for t in (5, 100, 115):
        for d in range(t - t // 5 + 1):
            assert far[t - d - t // 5, t] - far[t - d, t] == 1
    assert [far[100 - d, 100] for d in (20, 40, 60, 80)] == [1, 2, 3, 4]
    assert all(r == 5 * (t - c) // t for (c, t), r in far.items())
