"""Queries over vector and text metrics, table facts, splits, Python over batches and groups, and further graph operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import dataset as D
from ..operators import graph, quality
from .catalogue import register
from .common import load
from .relational import query
from .tpch import _of

c = F.col


def r(x, n=6):
    return F.round(x, n)


V, W = "embedding::DOUBLE[]", "list_reverse(embedding)::DOUBLE[]"
for _f, _sql in [
    (M.mean_dot_product, f"avg(list_inner_product({V}, {W}))"),
    (M.mean_cosine_similarity, f"avg(list_cosine_similarity({V}, {W}))"),
    (M.mean_cosine_distance, f"avg(1 - list_cosine_similarity({V}, {W}))"),
    (M.mean_angular_distance, f"avg(acos(greatest(-1, least(1, list_cosine_similarity({V}, {W})))) / pi())"),
    (M.mean_euclidean_distance, f"avg(list_distance({V}, {W}))"),
    (M.mean_manhattan_distance, f"avg(list_sum([abs(p[1] - p[2]) FOR p IN list_zip({V}, {W})]))"),
    (M.mean_hamming_distance, f"avg(len([1 FOR p IN list_zip({V}, {W}) IF p[1] <> p[2]]))"),
]:
    query(f"metric_{_f.__name__}", f"SELECT label, round({_sql}, 6) AS value FROM embeddings GROUP BY 1", "embeddings")(lambda e, f=_f: e.groupBy("label").agg(r(f(c("embedding"), F.reverse("embedding"))).alias("value")))
for _f, _sql in [
    (M.mean_embedding_norm, f"avg(sqrt(list_inner_product({V}, {V})))"),
    (M.unit_norm_rate, f"avg((abs(sqrt(list_inner_product({V}, {V})) - 1) <= 1e-3)::INTEGER)"),
    (M.zero_vector_rate, f"avg((list_inner_product({V}, {V}) = 0)::INTEGER)"),
]:
    query(f"metric_{_f.__name__}", f"SELECT label, round({_sql}, 6) AS value FROM embeddings GROUP BY 1", "embeddings")(lambda e, f=_f: e.groupBy("label").agg(r(f(c("embedding"))).alias("value")))

WORDS = r"[w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']"
for _n, _f, _sql in [
    ("distinct_token_ratio", lambda: M.distinct_token_ratio(c("text")), f"avg(len(list_distinct({WORDS})) / nullif(len({WORDS}), 0))"),
    ("mean_output_tokens", lambda: M.mean_output_tokens(c("text")), f"avg(len({WORDS}))"),
    ("empty_generation_rate", lambda: M.empty_generation_rate(c("text")), r"avg(coalesce(NOT regexp_matches(text, '\S'), true)::INTEGER)"),
    ("truncation_rate", lambda: M.truncation_rate(c("text")), r"""avg((NOT regexp_matches(text, '[.!?"'')\]]\s*$'))::INTEGER)"""),
    ("contains_any_rate", lambda: M.contains_any_rate(c("text"), ["token", "password"]), "avg((contains(lower(text), 'token') OR contains(lower(text), 'password'))::INTEGER)"),
    ("repeated_line_rate", lambda: M.repeated_line_rate(c("text")), r"avg((len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> '']) > len(list_distinct([x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])))::INTEGER)"),
    ("latin_only_rate", lambda: M.latin_only_rate(c("text")), r"avg((NOT regexp_matches(text, '[^\x{0000}-\x{024f}]'))::INTEGER)"),
    ("mean_ratio", lambda: M.mean_ratio(F.length(F.regexp_replace("text", "[^ ]", "")), F.length("text")), "avg(length(regexp_replace(text, '[^ ]', '', 'g')) / nullif(length(text), 0))"),
]:
    query(f"metric_{_n}", f"SELECT lang, round({_sql}, 6) AS value FROM documents GROUP BY 1", "documents")(lambda d, f=_f: d.groupBy("lang").agg(r(f()).alias("value")))

FACTS = [
    ("row_count_between", lambda q: q.row_count_between(1, 10**12), "count(*)", 1, 1e12),
    ("mean_between", lambda q: q.mean_between("l_quantity", 20, 30), "avg(l_quantity)", 20, 30),
    ("sum_between", lambda q: q.sum_between("l_quantity", 0, 100), "sum(l_quantity)", 0, 100),
    ("stddev_between", lambda q: q.stddev_between("l_quantity", 1, 100), "stddev_samp(l_quantity)", 1, 100),
    ("median_between", lambda q: q.median_between("l_quantity", 40, 50), "quantile_cont(l_quantity, 0.5)", 40, 50),
    ("quantile_between", lambda q: q.quantile_between("l_quantity", 0.9, 40, 50), "quantile_cont(l_quantity, 0.9)", 40, 50),
    ("min_between", lambda q: q.min_between("l_quantity", 1, 2), "min(l_quantity)", 1, 2),
    ("max_between", lambda q: q.max_between("l_quantity", 1, 2), "max(l_quantity)", 1, 2),
    ("null_rate_below", lambda q: q.null_rate_below("l_quantity", 0.01), "avg((l_quantity IS NULL)::INTEGER)", -1, 0.01),
    ("distinct_count_between", lambda q: q.distinct_count_between("l_returnflag", 3, 3), "count(DISTINCT l_returnflag)", 3, 3),
    ("unique_ratio_above", lambda q: q.unique_ratio_above("l_orderkey", 0.9), "count(DISTINCT l_orderkey) / count(l_orderkey)", 0.9, 2),
]
for _n, _f, _sql, _low, _high in FACTS:
    query(f"dq_{_n}", f"SELECT round({_sql}, 6) AS value, {_sql} BETWEEN {_low} AND {_high} AS holds FROM lineitem", "lineitem")(lambda l, f=_f: f(quality.Facts()).validate(l).select(r(c("value")).alias("value"), "holds"))

NOW = lambda: F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
for _n, _table, _key, _f, _sql in [
    ("str_length_between", "part", "p_partkey", lambda: quality.str_length_between("p_name", 5, 12), "length(p_name) BETWEEN 5 AND 12"),
    ("not_empty", "documents", "doc_id", lambda: quality.not_empty("text"), r"regexp_matches(text, '\S')"),
    ("not_matches", "orders", "o_orderkey", lambda: quality.not_matches("o_orderpriority", "^[12]-"), "NOT regexp_matches(o_orderpriority, '^[12]-')"),
    ("positive", "customer", "c_custkey", lambda: quality.positive("c_acctbal"), "c_acctbal > 0"),
    ("not_in_future", "events", "event_id", lambda: quality.not_in_future("ts", NOW()), "ts <= TIMESTAMP '2024-01-20 00:00:00'"),
    ("fresh_within", "events", "event_id", lambda: quality.fresh_within("ts", 86400, NOW()), "ts >= TIMESTAMP '2024-01-19 00:00:00'"),
    ("compare_columns", "lineitem", "l_orderkey, l_linenumber", lambda: quality.compare_columns("l_tax", "<=", "l_discount"), "l_tax <= l_discount"),
]:
    query(f"dq_{_n}", f"SELECT {_key}, {_sql} AS holds FROM {_table}", _table)(lambda t, k=_key, f=_f: t.select(*k.split(", "), f().alias("holds")))


def _doubled(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pc.multiply(batch.column(1), 2.0)], ["o_orderkey", "twice"])


def _range(table: pa.Table) -> pa.Table:
    v = table["value"]
    return pa.table({"user_id": table["user_id"][:1], "spread": pa.array([pc.max(v).as_py() - pc.min(v).as_py()], pa.float64())})


for _n, _sql, _tables, _f in [
    ("verb_map_batches", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders", "orders", lambda o: D.map_batches(o.select("o_orderkey", c("o_totalprice").cast("double")), _doubled, "o_orderkey long, twice double", retries=1)),
    ("verb_map_groups", "SELECT user_id::BIGINT AS user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1", "events", lambda e: D.map_groups(e.select(c("user_id").cast("long"), c("value").cast("double")), ["user_id"], _range, "user_id long, spread double").select("user_id", r(c("spread")).alias("spread"))),
    ("verb_split_at_indices", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 100 AND i < 500", "orders", lambda o: D.split_at_indices(o.select("o_orderkey"), [100, 500], "o_orderkey")[1]),
    ("verb_split_proportionately", "SELECT count(*) AS n FROM orders", "orders", lambda o: [a.unionByName(b) for a, b in [D.split_proportionately(o, [3, 1], ["o_orderkey"])]][0].agg(F.count("*").alias("n"))),
    ("verb_train_val_test_split", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders", "orders", lambda o: [a.unionByName(b).unionByName(d) for a, b, d in [D.train_val_test_split(o, ["o_orderkey"])]][0].agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))),
    ("verb_stratified_split", "SELECT o_orderstatus, ceil(count(*) * 0.25)::BIGINT AS n FROM orders GROUP BY 1", "orders", lambda o: D.stratified_split(o, "o_orderstatus", 0.25, ["o_orderkey"])[0].groupBy("o_orderstatus").agg(F.count("*").alias("n"))),
    ("verb_filter_by_length", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 100 AND 2000", "documents", lambda d: D.filter_by_length(d, "text", 100, 2000).select("doc_id")),
    ("verb_filter_by_token_budget", "SELECT doc_id FROM documents WHERE ceil(length(text) / 4.0) <= 300", "documents", lambda d: D.filter_by_token_budget(d, "text", 300).select("doc_id")),
    ("verb_drop_empty", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')", "documents", lambda d: D.drop_empty(d, "text").select("doc_id")),
    ("verb_reverse", "SELECT o_orderkey FROM orders", "orders", lambda o: D.reverse(o.select("o_orderkey"), "o_orderkey")),
    ("verb_select_dtypes", "SELECT p_name, p_brand, p_type FROM part", "part", lambda p: D.select_dtypes(p.select("p_partkey", "p_name", "p_brand", "p_type"), ["string"])),
    ("verb_class_weights", "SELECT toxic, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY 1", "labels", lambda l: D.class_weights(l, "toxic").select("toxic", r(c("weight")).alias("weight"))),
    ("verb_column_facts", "SELECT 'value' AS \"column\", count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (value IS NULL) > 0 AS has_nulls, count(value) = 0 AS all_null, count(DISTINCT value) AS n_unique FROM events UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), count(*) FILTER (event_type IS NULL) > 0, count(event_type) = 0, count(DISTINCT event_type) FROM events", "events", lambda e: D.column_facts(e, ["value", "event_type"])),
    ("verb_cov", "SELECT l_returnflag, round(covar_samp(l_quantity, l_tax), 8) AS value FROM lineitem GROUP BY 1", "lineitem", lambda l: l.groupBy("l_returnflag").agg(r(F.covar_samp("l_quantity", "l_tax"), 8).alias("value"))),
]:
    query(_n, _sql, _tables)(_f)


def _sparse(l):
    return l.where("l_quantity > 49").select(c("l_suppkey").cast("long").alias("src"), (c("l_orderkey") * 10 + 5000000000).cast("long").alias("dst"))


def _shared(l):
    return l.select(c("l_suppkey").cast("long").alias("src"), c("l_partkey").cast("long").alias("dst"))


@register("graph_connected_components")
def connected(spark, sf_dir):
    return graph.connected_components(_sparse(load(spark, sf_dir, "lineitem")))


@register("graph_k_core")
def k_core(spark, sf_dir):
    return graph.k_core(_shared(load(spark, sf_dir, "lineitem")), 3)


@register("graph_hits")
def hits(spark, sf_dir):
    return graph.hits(_shared(load(spark, sf_dir, "lineitem")).distinct(), 3)


@register(
    "graph_pair_scores",
    "WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey)::BIGINT AS a, greatest(l_suppkey, l_partkey)::BIGINT AS b FROM lineitem WHERE l_suppkey <> l_partkey), n AS (SELECT a AS id, b AS u FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT id, count(*) AS d FROM n GROUP BY 1), s AS (SELECT x.id AS a, y.id AS b, sum(1 / ln(d.d)) AS aa, sum(1.0 / d.d) AS ra FROM n x JOIN n y ON x.u = y.u AND y.id = x.id + 1 JOIN d ON d.id = x.u GROUP BY 1, 2) SELECT p.s_suppkey::BIGINT AS a, p.s_suppkey::BIGINT + 1 AS b, round(coalesce(aa, 0), 6) AS adamic_adar, round(coalesce(ra, 0), 6) AS resource_allocation, coalesce(d1.d * d2.d, 0)::BIGINT AS preferential_attachment FROM supplier p LEFT JOIN s ON s.a = p.s_suppkey LEFT JOIN d d1 ON d1.id = p.s_suppkey LEFT JOIN d d2 ON d2.id = p.s_suppkey + 1",
)
def pair_scores(spark, sf_dir):
    pairs = load(spark, sf_dir, "supplier").select(c("s_suppkey").cast("long").alias("a"), (c("s_suppkey").cast("long") + 1).alias("b"))
    out = graph.pair_scores(_shared(load(spark, sf_dir, "lineitem")), pairs)
    return out.select("a", "b", r(c("adamic_adar")).alias("adamic_adar"), r(c("resource_allocation")).alias("resource_allocation"), "preferential_attachment")


# The two whose tables lack partsupp take the least price of a part's lines for its cost.
_of("q02", "SELECT s_acctbal, s_name, n_name, p_partkey, cost FROM part, supplier, nation, region, (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey) ps, (SELECT l_partkey AS best_part, min(l_extendedprice / l_quantity) AS best FROM lineitem GROUP BY l_partkey) least WHERE p_partkey = ps.l_partkey AND s_suppkey = ps.l_suppkey AND best_part = p_partkey AND cost = best AND p_size < 25 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name IN ('EUROPE', 'ASIA') ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100")
_of("q11", "WITH held AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_nationkey < 8 GROUP BY l_partkey) SELECT l_partkey, value FROM held WHERE value > (SELECT sum(value) * 0.001 FROM held)")
