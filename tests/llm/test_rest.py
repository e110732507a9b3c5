import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import decontam, embed_dedup, mixing, quality, tokens, toxicity, warc
from millrace.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


# Toxicity.


def test_grammar_forms():
    lex = toxicity.Lexicon({})
    total = lambda t: dict(lex.clauses(t))
    assert total("you idiot") == {("aimed", "insult"): 1.0}
    assert total("not an idiot") == {("negated", "insult"): 1.0}
    assert total("he said idiot") == {("reported", "insult"): 1.0}
    assert total("not here. idiot") == {("bare", "insult"): 1.0}
    assert total("plain words") == {}


def test_composition_is_function_composition():
    a, b = toxicity._scope("negation", "negated", 2, ("insult",)), toxicity._scope("target", "aimed", 3, ("insult",))
    alphabet = ["insult", "negation", "target", "other"]
    c, rng = toxicity.compose(a, b, alphabet), random.Random(3)
    for _ in range(200):
        s = [rng.choice(alphabet) for _ in range(9)]
        assert [x for x, _ in c(s)] == [x for x, _ in b([y for y, _ in a(s)])]


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.75  # area under the curve
    assert np.mean([a >= 0.3 for a in toxic]) > 0.5 and np.mean([b >= 0.3 for b in clean]) < 0.02
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 700 < kept.count() < 1000


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "idiot " * 50000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score


def test_clause_classes_in_four_languages():
    lex = toxicity.Lexicon({"tonto": 1.0, "dumm": 1.0, "bete": 1.0})
    total = lambda t: dict(lex.clauses(t))
    assert total("nunca tonto") == {("negated", "insult"): 1.0} and total("du dumm") == {("aimed", "insult"): 1.0}
    assert total("il dit bete") == {("reported", "insult"): 1.0} or total("elle disait bete") == {("reported", "insult"): 1.0}
    assert total("x " * 100000 + "tonto") == {("bare", "insult"): 1.0}


# Quality.


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_quality(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100000)], "doc_id long, text string")
    rows = quality.score_quality(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert len(rows) == 3 and all(r.score == 0.5 for r in rows)


# Decontamination.


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=12), st.text(alphabet="abc ", max_size=20))
def test_myers(p, t):
    d = edit_distance(p, t)
    assert decontam.edit_distance_within(p, t, len(p)) == d
    assert decontam.edit_distance_within(p, t, d - 1) is None


def test_pigeonhole_finds_all_within_budget():
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    m = decontam.Matcher([(7, item)])
    k = int(decontam.RATE * len(item))
    for _ in range(60):
        s = list(item)
        for _ in range(rng.randrange(0, k + 4)):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh")
        text = "some words before " + "".join(s) + " and after"
        d = edit_distance(decontam.normalized(item), decontam.normalized(text))
        found = m.find(text)
        assert (7 in found) == (d <= k) and found.get(7, k) <= k


def test_contamination_edges(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y", 0), (2, None, 0), (3, "", 0), (None, item, 1), (1, "clean", 2)], "doc_id long, text string, n_items int")
    got = sorted((r.doc_id or 0, r.contaminated, r["items"]) for r in decontam.contamination(docs, bench).collect())
    assert got == [(0, True, [1]), (1, False, []), (1, True, [1]), (2, False, []), (3, False, [])]
    assert decontam.drop_contaminated(docs, bench).count() == 3
    assert decontam.contamination(docs.where("false"), bench).collect() == [] and decontam.drop_contaminated(docs.where("false"), bench).collect() == []
    assert decontam.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_short_items_and_blocks(spark, monkeypatch):
    """Items under MIN_CHARS count as whole words, and a benchmark in several blocks gives what one block gives."""
    bench = spark.createDataFrame([(1, "Blue Cat"), (2, "a longer item with more than enough letters"), (3, "blue"), (4, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the blue  cat."), (2, "bluecat blues"), (3, "q a longer item with more then enough letters " + "pad " * 60000), (4, "(X)")], "doc_id long, text string")
    found = lambda: {r.doc_id: r["items"] for r in decontam.contamination(docs, bench).collect()}
    want = {1: [1, 3], 2: [], 3: [2], 4: [4]}
    assert found() == want
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 10)
    assert found() == want and [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [2]


# Tokens.


@functools.cache
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def encoded_lists(texts, enc):
    out = []
    for first, ids, sizes in tokens.encoded(pa.array(texts, pa.string()), enc):
        assert first == len(out)
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


PIECES = st.sampled_from([*"ab \n\t\r1!\u00e9'\0\x85\u3000\u00a0\u2003\u4e16\x1c", "<|endoftext|>", "'s", " the", "x" * 40, "word" * 7, "  "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=6))
def test_encoder_equals_library(texts):
    want = [[*plain_tokenizer().encode(t or "", add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    assert encoded_lists(texts, tokens.encoder(tokenizer_path())) == want


def test_encoder_table_keeps_right_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "_SET_BITS", 3)
    monkeypatch.setattr(tokens, "_POOL", 50)
    monkeypatch.setattr(tokens, "_CHUNK", 300)
    enc, plain, rng = tokens.Encoder(tokenizer_path()), plain_tokenizer(), random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(40))) for _ in range(200)]
    assert encoded_lists(texts, enc) == [[*plain.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in texts]


def packed(docs, **more):
    return tokens.pack(list(range(len(docs))), np.concatenate([np.array(d, "<u2") for d in docs]), np.array([len(d) for d in docs]), 50257, np.dtype("<u2"), **more)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=8))
def test_grammar_round_trip(docs):
    b = tokens.Block(packed(docs, least=2))
    assert b.decode()[0].tolist() == [x for d in docs for x in d]
    assert all(b.decode(i, i + 1)[0].tolist() == d for i, d in enumerate(docs))


def most_uses(seq, last):
    """Greatest number of uses without overlap of any pair that crosses no document."""
    uses, end = {}, {}
    for i in range(len(seq) - 1):
        pair = (seq[i], seq[i + 1])
        if not last[i] and end.get(pair, -1) < i:
            uses[pair], end[pair] = uses.get(pair, 0) + 1, i + 1
    return max(uses.values(), default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=90), min_size=1, max_size=6), st.integers(2, 5))
def test_no_frequent_pair_is_left(docs, least):
    symbols, sizes = np.concatenate([np.array(d, "<u2") for d in docs]), np.array([len(d) for d in docs])
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes) - 1] = True
    _, _, seq, stop = tokens.re_pair(symbols, last, 50257, least)
    assert most_uses(seq.tolist(), stop.tolist()) < least
    assert int(stop.sum()) == len(docs)


def test_rules_stay_in_two_bytes():
    rng = np.random.default_rng(3)
    symbols = rng.choice(90, 1 << 18, p=np.arange(90, 0, -1) / np.arange(91).sum()).astype("<u2")
    least = tokens.least_uses(len(symbols), 50257)
    last = np.arange(len(symbols)) == len(symbols) - 1
    rules, _, seq, _ = tokens.re_pair(symbols, last, 50257)
    assert 0 < len(rules) <= len(symbols) // least and 50257 + len(rules) <= 1 << 16 and len(seq) < len(symbols)


def test_grammar_compresses():
    d = np.tile(np.arange(7, dtype="<u2"), 400)
    rules, _, seq, _ = tokens.re_pair(d, np.arange(len(d)) == len(d) - 1, 50257)
    assert len(rules) > 3 and len(seq) < len(d) / 5


def test_token_digest(spark):
    most = (1 << 63) - 1
    rows = [(5, "hello world", 1), (2, None, 1), (9, "a\nb  c", 1), (2, "again", 1), (7, "word " * 30000, 1), (None, "x <|endoftext|> y", 1), (most, "last", 1), (10, "", 1)]
    got = tokens.token_digest(spark.createDataFrame(rows, "doc_id long, text string, start int"), tokenizer_path()).orderBy("start").collect()
    plain = plain_tokenizer()
    crc = {zlib.crc32(np.array(v, "<u4").tobytes()): len(v) for v in ([*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _ in rows)}
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 7, 9, 10, most]
    at = 0
    for r in got:
        assert r.start == at and crc[r.ids_crc32] == r.n_tokens
        at += r.n_tokens
    assert tokens.token_digest(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


# Mixing.


def test_rates_equal_brute_force(spark):
    """Nonnegative least squares by plain projected gradient over the documents, run to the end."""
    rng = np.random.default_rng(1)
    n, p = rng.integers(1, 60, 30).astype(float), rng.dirichlet([0.6, 0.6, 0.6], 30)
    members = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(30)], "doc_id long, n_tokens long, posterior array<double>")
    weights = [0.05, 0.15, 0.8]
    rated, trace = mixing.solve_rates(members, 3, weights)
    r = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
    a = (n[:, None] * p).T
    target = np.array(weights) * max(a.sum(1) / weights)
    s = a.sum(1)
    loss = lambda r: ((a @ r - target) ** 2 / (2 * s)).sum()
    x, scaled = np.ones(30), a / np.sqrt(s)[:, None]
    step = 1 / np.linalg.eigvalsh(scaled @ scaled.T).max()
    for _ in range(20_000):
        x = np.maximum(0, x - step * scaled.T @ (scaled @ x - target / np.sqrt(s)))
    assert (r >= 0).all() and loss(r) <= loss(x) + 1e-6 * target.sum()
    assert np.abs(a @ r - a @ x).max() <= 1e-4 * target.sum() and np.allclose(a @ r, trace[-1], rtol=1e-6)


def test_mixing_stage_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 7), (None, None, "y", 8), (2, "", "y", 9), (3, "word " * 60000, "y", 1)], "doc_id long, text string, lang string, copies int")
    out = mixing.repeat_to_rates(docs, mixing.labelled_languages(docs, docs.select("doc_id")))
    assert out.columns == docs.columns
    rows = out.collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(1, 7), (None, 8), (2, 9), (3, 1)} and sum(r.doc_id == 1 for r in rows) >= 2
    assert mixing.repeat_to_rates(docs.where("false"), mixing.labelled_languages(docs, docs.select("doc_id"))).collect() == []


def test_mixing_meets_targets(spark):
    docs = spark.createDataFrame([(i, ("alpha beta gamma " if i % 3 else "delta epsilon zeta ") * (1 + i % 5), "d0" if i % 3 else "d1") for i in range(300)], "doc_id long, text string, rate string")
    labelled = docs.where("doc_id < 200").selectExpr("doc_id", "rate AS domain")
    m = mixing.mix(docs, labelled, {"d0": 0.5, "d1": 0.5}, budget=1000.0).toPandas()
    total = (m.rate * m.n_tokens).groupby(m.domain).sum()
    assert abs(total["d0"] - 500) < 10 and abs(total["d1"] - 500) < 10 and (m.rate >= 0).all()
    floored = mixing.mix(docs, labelled, floor=1.0).toPandas()
    assert (floored.copies >= 1).all()
    assert mixing.repeat_to_rates(docs, labelled).select("doc_id").distinct().count() == 300


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a"), (3, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(docs, none).count() == 5 and mixing.repeat_to_rates(docs, none).count() == 5
    assert mixing.mix(docs.where("false"), none).collect() == []


@pytest.mark.parametrize("a", [0.6, 0.7, 0.95])
def test_mixing_converges_on_uncertain_posteriors(spark, a):
    rows = [(i, 10, [a, 1 - a] if i % 2 else [1 - a, a]) for i in range(100)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    rated, _ = mixing.solve_rates(members, 2, [0.45, 0.55], budget=1000.0)
    r = rated.toPandas()
    got = [sum(n * p[k] * x for n, p, x in zip(r.n_tokens, r.posterior, r.rate, strict=True)) for k in range(2)]
    assert np.allclose(got, [450, 550], rtol=1e-5) and (r.rate >= 0).all()


def test_mixing_at_the_floor_and_out_of_reach(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.8] * 5, size=300)
    rows = [(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(rng.integers(0, 90, 300), p, strict=True))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    n = np.array([x[1] for x in rows])
    # in the second case no rates reach the targets
    for weights, floor in (([0.5, 0.2, 0.1, 0.1, 0.1], 0.0), ([0.6, 0.1, 0.1, 0.1, 0.1], 0.5), ([0.4, 0.15, 0.15, 0.15, 0.15], 1.0)):
        r = mixing.solve_rates(members, 5, weights, 20000.0, floor)[0].toPandas().sort_values("doc_id")
        miss = (p.T @ (n * r.rate.to_numpy()) - 20000.0 * np.array(weights)) / (p.T @ n)
        pull = p @ miss  # the gradient at each document: none above the floor, and none that would lift a rate from it
        assert (r.rate >= floor).all() and pull.min() > -1e-5 and np.abs(pull[r.rate.to_numpy() > floor + 1e-6]).max() < 1e-5
    with pytest.warns(UserWarning, match="mixing"):  # below the floor
        r = mixing.solve_rates(members, 5, weights, 0.5 * n.sum(), 1.0)[0].toPandas()
    assert np.allclose(r.rate, 1.0)


# Embeddings.


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + rng.normal(scale=0.05, size=(10, 16)), base[:3], base[:2] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [None] * 16), (104, [1.0, 2.0]), (105, [2.0, 4.0])]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = (u @ u.T >= 0.9).sum(1) - 1
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert got[50].component_id == 0 and not got[50].kept and got[104].component_id == 104 and got[105].component_id == 104
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103))


def test_recall_of_planted_pairs(spark):
    """At least 0.9 of pairs planted at cosines from 0.90 to 0.95 among 20,000 vectors, none below 0.9."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(18_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(2_000, 64))
    side -= (side * x[:2_000]).sum(1, keepdims=True) * x[:2_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.95, (2_000, 1))
    x = np.concatenate([x, c * x[:2_000] + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    linked = [got[18_000 + i].component_id == i for i in range(2_000)]
    assert len(got) == 20_000 and np.mean(linked) >= 0.9
    assert sum(r.n_links for r in got.values()) == 2 * sum(linked)


def test_vector_edges(spark):
    """Doubles stay doubles, repeated vec_ids and rows are vectors of their own, ties take the least id."""
    near = [0.9, float(np.sqrt(1 - 0.81))]  # cosine 0.9 with the first axis, up to rounding
    rows = [(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (2, [0.0, 1e-200], 3), (5, [0.0, 1e200], 4), (None, [1.0, 0.0], 5), (9, [1.0, 1e-12], 6), (4, [], 7), (8, near, 8), (7, [-1.0, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect())
    exact = float(np.array(near) @ np.array([1.0, 0.0]) / np.linalg.norm(near)) >= 0.9
    assert [g for g in got if g[0] not in (3, 8, 9)] == [(0, 0, None), (2, 1, 2), (4, 0, 4), (5, 1, 2), (7, 0, 7)]
    assert [g[2] for g in got if g[0] in (3, 9)] == [3, 3, 3] and (not exact or [g[2] for g in got if g[0] == 8] == [3])
    assert embed_dedup.near_vectors(df.where("false")).collect() == []


# WARC.


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.sets(st.integers(0, 39)))
def test_descent_finds_exactly_the_damage(n, bad):
    leaves = [bytes([i]) * 32 for i in range(n)]
    other = [b"\xff" * 32 if i in bad else x for i, x in enumerate(leaves)]
    found, compared = warc.differing(warc.tree(leaves), warc.tree(other))
    assert found == sorted(b for b in bad if b < n) and (found or compared == 1)


def test_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "y" * (i % 50)) for i in range(700)] + [(None, None, None)], "page_id long, url string, html string")
    archive = warc.build_archive(pages, 64)
    assert archive.count() == 701
    report = warc.audit_report(archive, warc.with_faults(archive, 50)).collect()
    assert len(report) == 701 and all(r.intact == (zlib.crc32(str(r.page_id if r.page_id is not None else "").encode()) % 50 != 0) for r in report)
    assert warc.audit(archive, archive).collect() == []
    lost = archive.where("not (segment = 0 and ordinal = 63)")
    assert warc.audit(archive, lost).count() == archive.where("segment = 0 and ordinal = 63").count()


def test_audit_climbs_levels(spark, monkeypatch):
    """Many small segments, so that shards have trees of several levels above them; repeated page_ids and an empty archive."""
    monkeypatch.setattr(warc, "FAN", 3)
    pages = spark.createDataFrame([(i // 2, "u", "p" * (i % 9), 1) for i in range(400)], "page_id long, url string, html string, shard int")
    archive = warc.build_archive(pages, 4)
    broken = archive.withColumn("record", F.when(F.expr("page_id in (7, 150)"), F.lit(b"x")).otherwise(F.col("record")))
    bad = {(r.shard, r.segment, r.ordinal) for r in warc.audit(archive, broken).collect()}
    assert bad == {(r.shard, r.segment, r.ordinal) for r in archive.where("page_id in (7, 150)").collect()} and len(bad) == 4
    none = warc.build_archive(pages.where("false"))
    assert warc.audit(none, none).collect() == [] and warc.audit_report(none, none).collect() == []


# Registration.


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_decontamination", "op9_warc_audit"])
def test_queries_cover_their_tables(spark, name):
    from millrace.llm.queries import QUERIES

    table = {"op2_decontamination": "documents", "op9_warc_audit": "pages"}[name]
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
