"""Queries over the composed subsystems: data quality, merge, graphs, streaming forms, sequences, geometry, metrics, scaling, dialect."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import metrics as M
from ..functions import rigid as B
from ..functions import sequences as Q
from ..operators import graph, merge, quality
from ..streaming import operators as st
from .catalogue import register
from .common import load
from .dialect import sql as dialect_sql
from .relational import query

c = F.col


def r(x, n=6):
    return F.round(x, n)


RULES = lambda: quality.Rules().not_null("o_custkey").in_range("o_totalprice", 1000, 400000).accepted("o_orderstatus", ["F", "O"]).matches("o_orderpriority", "^[1-3]-")
GOOD = "o_custkey IS NOT NULL AND o_totalprice BETWEEN 1000 AND 400000 AND o_orderstatus IN ('F', 'O') AND regexp_matches(o_orderpriority, '^[1-3]-')"
EDGES = "SELECT l_suppkey AS src, l_partkey + 100000 AS dst FROM lineitem"
ITEMS = "SELECT l_suppkey::BIGINT AS src, l_partkey::BIGINT AS dst FROM lineitem"


def _bipartite(l):
    return l.select(c("l_suppkey").alias("src"), (c("l_partkey") + 100000).alias("dst"))


def _items(l):
    """The lineitem edges in one id space, so that there are paths and triangles."""
    return l.select(c("l_suppkey").cast("long").alias("src"), c("l_partkey").cast("long").alias("dst"))


DNA = "upper(translate(regexp_replace(lower(text), '[^aeio]', '', 'g'), 'aeio', 'ACGT'))"



def dna(text=None):
    """Text as bases: the whole text, or another column."""
    return F.upper(F.translate(F.regexp_replace(F.lower(c("text") if text is None else text), "[^aeio]", ""), "aeio", "ACGT"))


for name, sql, tables, f in [
    ("dq_validate", f"SELECT * FROM (VALUES ('o_custkey not null', (SELECT count(*) FROM orders WHERE o_custkey IS NULL), (SELECT count(*) FROM orders)), ('o_totalprice in range', (SELECT count(*) FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 400000), (SELECT count(*) FROM orders)), ('o_orderstatus accepted', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')), (SELECT count(*) FROM orders)), ('o_orderpriority matches', (SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')), (SELECT count(*) FROM orders))) t(rule, failed, total)", "orders", lambda o: RULES().validate(o)),
    ("dq_pass", f"SELECT o_orderkey FROM orders WHERE {GOOD}", "orders", lambda o: RULES().split(o)[0].select("o_orderkey")),
    ("dq_quarantine", f"SELECT o_orderkey FROM orders WHERE NOT ({GOOD})", "orders", lambda o: RULES().split(o)[1].select("o_orderkey")),
    ("dq_unique", "SELECT c_nationkey, count(*) AS times FROM customer GROUP BY 1 HAVING count(*) > 1", "customer", lambda t: quality.unique_violations(t, ["c_nationkey"])),
    ("dq_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", "orders customer", lambda o, t: quality.orphans(o, "o_custkey", t.where("c_acctbal > 0"), "c_custkey").select("o_orderkey")),
    ("dq_outliers", "SELECT event_id FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)", "events", lambda e: quality.outliers(e, "value").select("event_id")),
    ("merge_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 3 <> 0 AND c_acctbal < 0) UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 7 = 0", "customer", lambda t: merge.Merge(t.select(c("c_custkey").alias("k"), c("c_mktsegment").alias("v"), "c_acctbal"), t.where("c_custkey % 3 = 0").select(c("c_custkey").alias("k"), F.lit("new").alias("v"), "c_acctbal").union(t.where("c_custkey % 7 = 0").select(c("c_custkey") + 1000000, F.lit("new"), "c_acctbal")), ["k"]).when_matched_update().when_not_matched_insert().when_not_matched_by_source_delete((F.col("t.k") % 5 == 0) & (F.col("t.c_acctbal") < 0)).result().select("k", "v")),
    ("merge_delete", "SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 1", "customer", lambda t: merge.Merge(t.select(c("c_custkey").alias("k")), t.where("c_custkey % 2 = 0").select(c("c_custkey").alias("k")), ["k"]).when_matched_delete().result()),
    ("cdc_apply", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 4 > 1 UNION ALL SELECT s_suppkey, s_acctbal + 2 FROM supplier WHERE s_suppkey % 4 = 1", "supplier", lambda s: merge.apply_changes(s.select("s_suppkey", "s_acctbal"), s.where("s_suppkey % 4 < 2").select("s_suppkey", (c("s_acctbal") + 1).alias("s_acctbal"), F.lit("U").alias("op"), F.lit(1).alias("seq")).union(s.where("s_suppkey % 4 < 2").select("s_suppkey", c("s_acctbal") + 2, F.when(c("s_suppkey") % 4 == 0, "D").otherwise("U"), F.lit(2))), ["s_suppkey"], "seq")),
    ("cdc_diff", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'delete' WHEN s_suppkey % 5 = 1 THEN 'update' END AS change FROM supplier WHERE s_suppkey % 5 < 2", "supplier", lambda s: merge.diff(s.select("s_suppkey", "s_acctbal"), s.where("s_suppkey % 5 <> 0").select("s_suppkey", F.when(c("s_suppkey") % 5 == 1, c("s_acctbal") + 1).otherwise(c("s_acctbal")).alias("s_acctbal")), ["s_suppkey"])),
    ("scd2", "SELECT s_suppkey, s_acctbal, 1 AS valid_from, CASE WHEN s_suppkey % 5 < 2 THEN 2 END AS valid_to, s_suppkey % 5 >= 2 AS is_current FROM supplier UNION ALL SELECT s_suppkey, s_acctbal + 1, 2, NULL, true FROM supplier WHERE s_suppkey % 5 = 1", "supplier", lambda s: merge.scd2(s.select("s_suppkey", "s_acctbal", F.lit(1).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), F.lit(True).alias("is_current")), s.where("s_suppkey % 5 <> 0").select("s_suppkey", F.when(c("s_suppkey") % 5 == 1, c("s_acctbal") + 1).otherwise(c("s_acctbal")).alias("s_acctbal")), ["s_suppkey"], F.lit(2))),
    ("graph_degrees", f"SELECT id, count(*) FILTER (d = 'i') AS in_degree, count(*) FILTER (d = 'o') AS out_degree, count(*) AS degree FROM (SELECT src AS id, 'o' AS d FROM ({EDGES}) UNION ALL SELECT dst, 'i' FROM ({EDGES})) GROUP BY 1", "lineitem", lambda l: graph.degrees(_bipartite(l))),
    ("graph_triangles", f"WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({ITEMS}) WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1", "lineitem", lambda l: graph.triangles(_items(l))),
    ("graph_bfs", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({ITEMS})), p(id, d) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, p.d + 1 FROM p JOIN e ON e.src = p.id WHERE p.d < 20) SELECT id, min(d) AS distance FROM p GROUP BY 1", "lineitem", lambda l: graph.bfs(_items(l).distinct(), 1)),
    ("graph_pagerank", None, "lineitem", lambda l: graph.pagerank(_items(l).distinct(), 5)),
    ("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL", "events", lambda e: st.windowed(e, "ts", "1 hour", [F.count("*").alias("n")], ["event_type"])),
    ("stream_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 3 HOUR THEN 1 ELSE 0 END AS f FROM events)) GROUP BY user_id, s", "events", lambda e: st.session_windows(e, "ts", "3 hours", [F.count("*").alias("n")], ["user_id"])),
    ("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events", "events", lambda e: st.deduplicated(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")),
    ("seq_reverse_complement", f"SELECT doc_id, reverse(translate({DNA}, 'ACGT', 'TGCA')) AS value FROM documents", "documents", lambda d: d.select("doc_id", Q.reverse_complement(dna()).alias("value"))),
    ("seq_gc_content", f"SELECT doc_id, round(len(regexp_extract_all({DNA}, '[GC]')) / nullif(length({DNA}), 0)::DOUBLE, 6) AS value FROM documents", "documents", lambda d: d.select("doc_id", r(Q.gc_content(dna())).alias("value"))),
    ("seq_transcribe", f"SELECT doc_id, replace({DNA}, 'T', 'U') AS value FROM documents", "documents", lambda d: d.select("doc_id", Q.transcribe(dna()).alias("value"))),
    ("seq_kmers", f"SELECT doc_id, array_to_string([substr(d, i, 4) FOR i IN range(1, length(d) - 2)], ',') AS value FROM (SELECT doc_id, {DNA} AS d FROM documents)", "documents", lambda d: d.select("doc_id", F.array_join(Q.kmers(dna(), 4), ",").alias("value"))),
    ("seq_translate", None, "documents", lambda d: d.select("doc_id", Q.translate(dna()).alias("value"))),
    ("geo_distance", "SELECT c_custkey, round(sqrt(pow(c_acctbal - 100, 2) + pow(c_nationkey - 7, 2)), 6) AS value FROM customer", "customer", lambda t: t.select("c_custkey", r(G.distance(G.point(c("c_acctbal"), c("c_nationkey")), G.point(F.lit(100), F.lit(7)))).alias("value"))),
    ("geo_area", "SELECT c_custkey, round(abs(c_acctbal) * (c_nationkey + 1), 4) AS value FROM customer", "customer", lambda t: t.select("c_custkey", r(G.area(G.box(G.point(F.lit(0), F.lit(0)), G.point(c("c_acctbal"), c("c_nationkey") + 1))), 4).alias("value"))),
    ("geo_contains", "SELECT c_custkey, c_acctbal > 0.5 AND c_acctbal < 5000.5 AND c_nationkey > 2.5 AND c_nationkey < 9.5 AS value FROM customer", "customer", lambda t: t.select("c_custkey", G.contains(G.box(G.point(F.lit(0.5), F.lit(2.5)), G.point(F.lit(5000.5), F.lit(9.5))), G.point(c("c_acctbal"), c("c_nationkey"))).alias("value"))),
    ("geo_length", "SELECT c_custkey, round(2 * abs(c_acctbal) + 2 * (c_nationkey + 1), 4) AS value FROM customer", "customer", lambda t: t.select("c_custkey", r(G.length(G.box(G.point(F.lit(0), F.lit(0)), G.point(c("c_acctbal"), c("c_nationkey") + 1))), 4).alias("value"))),
    ("geo_geohash", None, "customer", lambda t: t.select("c_custkey", G.geohash(c("c_acctbal") % 180, c("c_nationkey") * 3.0).alias("value"))),
    ("metric_classification", "SELECT round(avg((y = p)::INTEGER), 6) AS accuracy, round(count(*) FILTER (y = 1 AND p = 1) / count(*) FILTER (p = 1), 6) AS precision, round(count(*) FILTER (y = 1 AND p = 1) / count(*) FILTER (y = 1), 6) AS recall, round(2 * count(*) FILTER (y = 1 AND p = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (p = 1)), 6) AS f1 FROM (SELECT (l_tax > 0.03)::INTEGER AS y, (l_discount > 0.04)::INTEGER AS p FROM lineitem)", "lineitem", lambda l: l.select((c("l_tax") > 0.03).cast("int").alias("y"), (c("l_discount") > 0.04).cast("int").alias("p")).agg(*(r(m(c("y"), c("p"))).alias(m.__name__) for m in (M.accuracy, M.precision, M.recall, M.f1)))),
    ("metric_regression", "SELECT round(avg(abs(l_tax - l_discount)), 6) AS mae, round(avg(pow(l_tax - l_discount, 2)), 6) AS mse, round(sqrt(avg(pow(l_tax - l_discount, 2))), 6) AS rmse FROM lineitem", "lineitem", lambda l: l.agg(*(r(m(c("l_tax"), c("l_discount"))).alias(m.__name__) for m in (M.mae, M.mse, M.rmse)))),
    ("metric_roc_auc", "SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS k FROM (SELECT (p_size > 25)::INTEGER AS y, p_retailprice AS q FROM part))", "part", lambda p: M.roc_auc(p.select((c("p_size") > 25).cast("int").alias("y"), c("p_retailprice").alias("q")), "y", "q").withColumn("auc", r(c("auc")))),
    ("sql_qualify", "SELECT event_id, user_id FROM events WHERE event_type <> 'x' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1", "events", lambda e: dialect_sql(e.sparkSession, "SELECT event_id, user_id FROM {events} WHERE event_type <> 'x' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1", events=e)),
    ("sql_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, value DESC, event_id", "events", lambda e: dialect_sql(e.sparkSession, "SELECT DISTINCT ON (user_id) user_id, event_id FROM {events} ORDER BY user_id, value DESC, event_id", events=e)),
]:
    query(name, sql, tables)(f)


@register("ml_standard_scale", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS value FROM part")
def standard_scale(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    stats = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    return p.join(F.broadcast(stats)).select("p_partkey", r((c("p_retailprice") - c("m")) / c("s")).alias("value"))  # one row


@register("ml_label_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand)::INTEGER - 1 AS value FROM part")
def label_encode(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    brands = p.select("p_brand").distinct()  # bounded by the number of classes
    codes = brands.agg(F.array_sort(F.collect_set("p_brand")).alias("b")).select(F.posexplode("b").alias("value", "p_brand"))
    return p.join(codes, "p_brand").select("p_partkey", "value")


@register("ml_target_encode", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS value FROM part")
def target_encode(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    means = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    return p.join(means, "p_brand").select("p_partkey", r(c("m")).alias("value"))


for _n, _pattern in M.TEXT_RATES.items():
    _said = _pattern.replace("'", "''").replace("\\u", "\\x")
    _said = re.sub(r"\\x([0-9a-f]{4})", r"\\x{\1}", _said)  # the notation that both dialects have for code points
    query(f"metric_{_n}", f"SELECT lang, round(avg(regexp_matches(text, '{_said}')::INTEGER), 6) AS value FROM documents GROUP BY 1", "documents")(lambda d, n=_n: d.groupBy("lang").agg(r(M.text_rate(n, c("text"))).alias("value")))

_Y, _P = "(l_tax + 0.1)", "(l_discount + 0.2)"
for _m, _sql in [
    (M.poisson_deviance, f"2 * avg({_Y} * ln({_Y} / {_P}) - ({_Y} - {_P}))"),
    (M.gamma_deviance, f"2 * avg(ln({_P} / {_Y}) + {_Y} / {_P} - 1)"),
    (M.concordance_correlation, f"2 * covar_pop({_Y}, {_P}) / (var_pop({_Y}) + var_pop({_P}) + pow(avg({_Y}) - avg({_P}), 2))"),
    (M.kling_gupta_efficiency, f"1 - sqrt(pow(corr({_Y}, {_P}) - 1, 2) + pow(stddev_pop({_P}) / stddev_pop({_Y}) - 1, 2) + pow(avg({_P}) / avg({_Y}) - 1, 2))"),
    (M.r2, f"1 - sum(pow({_Y} - {_P}, 2)) / regr_syy({_Y}, {_Y})"),
    (M.mape, f"avg(abs(({_Y} - {_P}) / {_Y}))"),
]:
    query(f"metric_{_m.__name__}", f"SELECT l_returnflag, round({_sql}, 5) AS value FROM lineitem GROUP BY 1", "lineitem")(lambda l, m=_m: l.groupBy("l_returnflag").agg(r(m(c("l_tax") + 0.1, c("l_discount") + 0.2), 5).alias("value")))


def _p():
    return B.vec(c("l_quantity"), c("l_tax") * 100, c("l_discount") * 100)


def _half():
    """A quarter turn about z."""
    return B.quat(0, 0, 2**-0.5, 2**-0.5)


for _name, _column, _sql in [
    ("norm", lambda: B.norm(_p()), "sqrt(pow(l_quantity, 2) + pow(l_tax * 100, 2) + pow(l_discount * 100, 2))"),
    ("azimuth", lambda: B.azimuth(_p()), "atan2(l_tax * 100, l_quantity)"),
    ("elevation", lambda: B.elevation(_p()), "atan2(l_discount * 100, sqrt(pow(l_quantity, 2) + pow(l_tax * 100, 2)))"),
    ("distance", lambda: B.distance(_p(), B.vec(1, 2, 3)), "sqrt(pow(l_quantity - 1, 2) + pow(l_tax * 100 - 2, 2) + pow(l_discount * 100 - 3, 2))"),
    ("rotate_x", lambda: B.rotate(_half(), _p())["x"] + 1000, "1000 - l_tax * 100"),
    ("transform_y", lambda: B.transform(B.vec(1, 2, 3), _half(), _p())["y"], "l_quantity + 2"),
    ("inverse_transform_x", lambda: B.inverse_transform(B.vec(1, 2, 3), _half(), _p())["x"] + 1000, "1000 + l_tax * 100 - 2"),
    ("quat_angle", lambda: B.quat_angle(B.quat_from_axis_angle(B.vec(0, 0, 1), c("l_tax"))), "l_tax"),
    ("quat_angular_distance", lambda: B.quat_angular_distance(B.quat(0, 0, 0, 1), _half()), "pi() / 2"),
    ("slerp_angle", lambda: B.quat_angle(B.slerp(B.quat(0, 0, 0, 1), _half(), c("l_discount") * 5 + 0.2)), "(l_discount * 5 + 0.2) * pi() / 2"),
    ("euler_yaw", lambda: B.euler_from_quat(B.quat_from_euler(F.lit(0.1), F.lit(0.2), c("l_tax")))["yaw"], "l_tax"),
    ("voxel", lambda: B.voxel(_p(), 5.0)["x"].cast("double"), "floor(l_quantity / 5)"),
]:
    query(f"rigid_{_name}", f"SELECT l_orderkey, l_linenumber, round({_sql} + 3e-7, 5) AS value FROM lineitem", "lineitem")(lambda l, column=_column: l.select("l_orderkey", "l_linenumber", r(column() + 3e-7, 5).alias("value")))
