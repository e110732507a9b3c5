"""Queries for verbs, joins, aggregates and windows, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import relational as R
from ..operators import windows as W
from .catalogue import register
from .common import load

c = F.col
x = y = i = w = wv = run = None


def _columns() -> None:
    """Columns and windows that many queries share; they need a session, so they are made when a query runs."""
    global x, y, i, w, wv, run
    x, y, i = c("l_extendedprice") / 1000, c("l_quantity"), c("l_partkey")
    w = Window.partitionBy("user_id").orderBy("event_id")
    wv = Window.partitionBy("user_id").orderBy("value", "event_id")
    run = W.running(w)


def r(x: Column, n: int = 4) -> Column:
    return F.round(x, n)


def query(name: str, sql: str | None, tables: str):
    """Register f(*tables) under a name."""

    def add(f):
        def run(spark, sf_dir):
            _columns()
            return f(*(load(spark, sf_dir, t) for t in tables.split()))

        register(name, sql)(run)
        return f

    return add


# Verbs.
for name, sql, tables, f in [
    ("filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'", "lineitem", lambda l: l.where((c("l_quantity") > 45) & (c("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")),
    ("select", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders", "orders", lambda o: o.select("o_orderkey", (c("o_totalprice") * 2).alias("twice"))),
    ("with_columns", "SELECT c_custkey, c_acctbal < 0 AS owes, upper(c_mktsegment) AS seg FROM customer", "customer", lambda t: t.withColumns({"owes": c("c_acctbal") < 0, "seg": F.upper("c_mktsegment")}).select("c_custkey", "owes", "seg")),
    ("rename", "SELECT r_regionkey AS key, r_name AS name FROM region", "region", lambda t: t.withColumnsRenamed({"r_regionkey": "key", "r_name": "name"})),
    ("drop", "SELECT n_nationkey, n_name FROM nation", "nation", lambda t: t.drop("n_regionkey")),
    ("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders", lambda o: R.sort(o, ["o_totalprice", "o_orderkey"], [True, False]).limit(25).select("o_orderkey", "o_totalprice")),
    ("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 10", "part", lambda p: R.top_k(p, 10, ["p_retailprice", "p_partkey"]).select("p_partkey", "p_retailprice")),
    ("bottom_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10", "part", lambda p: R.bottom_k(p, 10, ["p_retailprice", "p_partkey"]).select("p_partkey", "p_retailprice")),
    ("slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 15", "orders", lambda o: R.slice_rows(o, 15, 20, "o_orderkey").select("o_orderkey")),
    ("tail", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7", "orders", lambda o: R.top_k(o, 7, "o_orderkey").select("o_orderkey")),
    ("distinct", "SELECT DISTINCT p_brand, p_type FROM part", "part", lambda p: R.distinct(p.select("p_brand", "p_type"))),
    ("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "orders", lambda o: R.distinct(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], [True, False]).select("o_custkey", "o_orderkey", "o_totalprice")),
    ("row_index", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, o_orderkey FROM orders", "orders", lambda o: R.with_row_index(o.select("o_orderkey"), order_by="o_orderkey")),
    ("gather_every", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 10 = 3", "orders", lambda o: R.gather_every(o.select("o_orderkey"), 10, "o_orderkey", 3)),
    ("union", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", "nation region", lambda n, g: R.union(n.select(c("n_name").alias("x")), g.select("r_name"))),
    ("union_distinct", "SELECT c_nationkey AS x FROM customer UNION SELECT s_nationkey FROM supplier", "customer supplier", lambda a, b: R.union(a.select(c("c_nationkey").alias("x")), b.select("s_nationkey"), distinct=True)),
    ("union_by_name", "SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS extra FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS k FROM region", "nation region", lambda n, g: R.union(n.select(c("n_nationkey").alias("k"), c("n_name").alias("name"), F.lit(None).cast("int").alias("extra")), g.select(c("r_name").alias("name"), c("r_regionkey").alias("k")), by_name=True)),
    ("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000", "orders customer", lambda o, t: o.select(c("o_custkey").alias("k")).intersect(t.where("c_acctbal > 5000").select("c_custkey"))),
    ("intersect_all", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer", "supplier customer", lambda s, t: s.select(c("s_nationkey").alias("k")).intersectAll(t.select("c_nationkey"))),
    ("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", "customer orders", lambda t, o: t.select(c("c_custkey").alias("k")).subtract(o.select("o_custkey"))),
    ("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer supplier", lambda t, s: t.select(c("c_nationkey").alias("k")).exceptAll(s.select("s_nationkey"))),
    ("explode", "SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)", "documents", lambda d: R.explode(d.select("doc_id", F.split("text", " ", -1).alias("w")), "w")),
    ("explode_index", "SELECT vec_id, i::INTEGER AS i, v FROM (SELECT vec_id, unnest(range(0, 4)) AS i, unnest(embedding[1:4]) AS v FROM embeddings)", "embeddings", lambda d: R.explode(d.select("vec_id", F.slice("embedding", 1, 4).alias("v")), "v", index="i")),
    ("unpivot", "SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem) UNPIVOT (value FOR variable IN (l_tax, l_discount))", "lineitem", lambda l: R.unpivot(l, ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])),
    ("pivot", "SELECT l_linestatus, sum(l_quantity) FILTER (l_returnflag = 'A') AS \"A\", sum(l_quantity) FILTER (l_returnflag = 'N') AS \"N\", sum(l_quantity) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1", "lineitem", lambda l: R.pivot(l, ["l_linestatus"], "l_returnflag", F.sum("l_quantity"), ["A", "N", "R"])),
    ("value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1", "events", lambda e: R.value_counts(e, "event_type")),
    ("null_count", "SELECT count(*) FILTER (props IS NULL) AS props, count(*) FILTER (value IS NULL) AS value FROM events", "events", lambda e: R.null_count(e.select("props", "value")).select(*(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("props", "value")))),
    ("describe", "SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS count, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS median, max(c_acctbal) AS max FROM customer", "customer", lambda t: R.describe(t, ["c_acctbal"]).select("column", "count", r(c("mean")).alias("mean"), r(c("std")).alias("std"), "min", r(c("q1")).alias("q1"), r(c("median")).alias("median"), "max")),
    ("corr_matrix", "SELECT 'l_tax' AS a, 'l_discount' AS b, round(corr(l_tax, l_discount), 6) AS corr FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem", "lineitem", lambda l: R.corr_matrix(l, ["l_tax", "l_discount"]).where("a <> b").withColumn("corr", r(c("corr"), 6))),
    ("cov_matrix", "SELECT 'l_tax' AS a, 'l_discount' AS b, round(covar_samp(l_tax, l_discount), 8) AS cov FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(covar_samp(l_discount, l_tax), 8) FROM lineitem", "lineitem", lambda l: R.cov_matrix(l, ["l_tax", "l_discount"]).where("a <> b").withColumn("cov", r(c("cov"), 8))),
    ("class_balance", "SELECT o_orderstatus, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1", "orders", lambda o: R.class_balance(o, "o_orderstatus").withColumn("share", r(c("share"), 6))),
    ("balance_classes", "SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))", "orders", lambda o: R.balance_classes(o, "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus")),
    ("get_dummies", "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS st_F, (o_orderstatus = 'O')::INTEGER AS st_O FROM orders", "orders", lambda o: R.get_dummies(o.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"], "st")),
    ("fill_null", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS event_type FROM events", "events", lambda e: R.fill_null(e.select("event_id", F.nullif(c("event_type"), F.lit("click")).alias("event_type")), ["event_type"], "none")),
    ("fill_forward", "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events", "events", lambda e: R.fill_null(e.select("event_id", "user_id", F.when(c("event_id") % 3 == 0, c("value")).alias("value")), ["value"], strategy="forward", order_by="event_id", partition_by=["user_id"]).select("event_id", "value")),
    ("fill_backward", "SELECT event_id, first_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events", "events", lambda e: R.fill_null(e.select("event_id", "user_id", F.when(c("event_id") % 3 == 0, c("value")).alias("value")), ["value"], strategy="backward", order_by="event_id", partition_by=["user_id"]).select("event_id", "value")),
    ("drop_nulls", "SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NOT NULL", "events", lambda e: e.select("event_id", F.nullif(c("event_type"), F.lit("click")).alias("t")).dropna(subset=["t"]).select("event_id")),
    ("unnest_struct", "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation", "nation", lambda n: R.unnest(n.select("n_nationkey", F.struct(c("n_name").alias("a"), c("n_regionkey").alias("b")).alias("s")), "s")),
    ("sample", None, "orders", lambda o: R.sample(o, 0.1, seed=3)),
    ("sample_n", None, "orders", lambda o: R.sample(o, n=50, seed=3)),
    ("split", None, "orders", lambda o: R.split_by_hash(o, "o_custkey", {"train": 0.8, "val": 0.1, "test": 0.1})),
    ("selectors", "SELECT c_acctbal FROM customer", "customer", lambda t: t.select(*(f.name for f in t.schema if f.dataType.typeName() == "double"))),
]:
    query(f"verb_{name}", sql, tables)(f)

# Joins.
for name, sql, tables, f in [
    ("inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders customer", lambda o, t: o.join(t, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")),
    ("left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey", "customer orders", lambda t, o: t.join(o, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "o_orderkey")),
    ("right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", "orders customer", lambda o, t: o.join(t, c("o_custkey") == c("c_custkey"), "right").select("c_custkey", "o_orderkey")),
    ("full", "SELECT k, s_suppkey, c_custkey FROM (SELECT s_nationkey AS k, s_suppkey FROM supplier WHERE s_nationkey < 15) FULL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer WHERE c_nationkey > 10) USING (k)", "supplier customer", lambda s, t: R.join(s.where("s_nationkey < 15").select(c("s_nationkey").alias("k"), "s_suppkey"), t.where("c_nationkey > 10").select(c("c_nationkey").alias("k"), "c_custkey"), "k", "full")),
    ("semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer orders", lambda t, o: t.join(o.where("o_totalprice > 400000"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")),
    ("anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer orders", lambda t, o: t.join(o.where("o_totalprice > 400000"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")),
    ("cross", "SELECT r_name, n_name FROM region, nation", "region nation", lambda g, n: g.crossJoin(n).select("r_name", "n_name")),
    ("suffix", "SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b USING (n_nationkey)", "nation nation", lambda a, b: R.join(a.select("n_nationkey", "n_name"), b.select("n_nationkey", "n_name"), "n_nationkey")),
    ("theta", "SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier supplier", lambda a, b: a.alias("a").join(b.alias("b"), (c("a.s_nationkey") == c("b.s_nationkey")) & (c("a.s_acctbal") < c("b.s_acctbal"))).select("a.s_suppkey", c("b.s_suppkey").alias("other"))),
    ("left_residual", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40", "customer orders", lambda t, o: t.join(o, (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > c("c_acctbal") * 40), "left").select("c_custkey", "o_orderkey")),
    ("band", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 20 AND s_acctbal + 20", "customer supplier", lambda t, s: J.band_join(t, s.withColumns({"lo": c("s_acctbal") - 20, "hi": c("s_acctbal") + 20}), "c_acctbal", "lo", "hi", 40.0).select("c_custkey", "s_suppkey")),
    ("interval", "SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE AND a.event_type = 'error'", "events events", lambda a, b: J.interval_join(a.where("event_type = 'error'"), b, ["user_id"], "ts", "ts", "10 minutes").select("l.event_id", c("r.event_id").alias("other"))),
    ("asof_backward", "SELECT a.event_id, b.event_id AS event_id_right FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts", "events events", lambda a, b: J.asof_join(a.where("event_type = 'error'"), b.where("event_type = 'click'"), "ts", ["user_id"]).select("event_id", "event_id_right")),
    ("asof_forward", "SELECT a.event_id, b.event_id AS event_id_right FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts <= b.ts", "events events", lambda a, b: J.asof_join(a.where("event_type = 'error'"), b.where("event_type = 'click'"), "ts", ["user_id"], "forward").select("event_id", "event_id_right")),
    ("asof_tolerance", "SELECT event_id, CASE WHEN ts - t <= INTERVAL 1 HOUR THEN other END AS event_id_right FROM (SELECT a.event_id, a.ts, b.ts AS t, b.event_id AS other FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts)", "events events", lambda a, b: J.asof_join(a.where("event_type = 'error'"), b.where("event_type = 'click'"), "ts", ["user_id"], tolerance=F.expr("INTERVAL 1 HOUR")).select("event_id", "event_id_right")),
    ("asof_nearest", "SELECT event_id, event_id_right FROM (SELECT a.event_id, b.event_id AS event_id_right, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts) AS k FROM (SELECT * FROM events WHERE event_type = 'error') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id) WHERE k = 1", "events events", lambda a, b: J.asof_join(a.where("event_type = 'error'"), b.where("event_type = 'click'"), "ts", ["user_id"], "nearest").select("event_id", "event_id_right")),
]:
    query(f"join_{name}", sql, tables)(f)

# Aggregates over lineitem by flag: (name, Column, SQL).
X, Y, WT = "l_extendedprice / 1000", "l_quantity", "l_quantity"
Q = "quantile_cont(l_extendedprice / 1000, {})"
for name, column, sql in [
    ("count", lambda: F.count("*"), "count(*)"),
    ("sum", lambda: r(F.sum(x)), f"round(sum({X}), 4)"),
    ("mean", lambda: r(F.avg(x)), f"round(avg({X}), 4)"),
    ("min", lambda: F.min(y), "min(l_quantity)"),
    ("max", lambda: F.max(y), "max(l_quantity)"),
    ("median", lambda: r(F.median(x)), f"round(median({X}), 4)"),
    ("std", lambda: r(F.stddev_samp(x)), f"round(stddev_samp({X}), 4)"),
    ("var", lambda: r(F.var_samp(x)), f"round(var_samp({X}), 4)"),
    ("stddev_pop", lambda: r(F.stddev_pop(x)), f"round(stddev_pop({X}), 4)"),
    ("var_pop", lambda: r(F.var_pop(x)), f"round(var_pop({X}), 4)"),
    ("n_unique", lambda: F.count_distinct(i), "count(DISTINCT l_partkey)"),
    ("product", lambda: r(F.product(1 + c("l_tax") / 1000)), "round(product(1 + l_tax / 1000), 4)"),
    ("skewness", lambda: r(A.skewness(x)), f"round(skewness({X}), 4)"),
    ("kurtosis", lambda: r(A.kurtosis(x)), f"round(kurtosis({X}), 4)"),
    ("bool_and", lambda: F.bool_and(y > 0), "bool_and(l_quantity > 0)"),
    ("bool_or", lambda: F.bool_or(y > 49), "bool_or(l_quantity > 49)"),
    ("bit_and", lambda: F.bit_and(i.bitwiseOR(F.lit(5))), "bit_and(l_partkey | 5)"),
    ("bit_or", lambda: F.bit_or(i), "bit_or(l_partkey)"),
    ("bit_xor", lambda: F.bit_xor(i), "bit_xor(l_partkey)"),
    ("any_value", lambda: F.min(i), "min(l_partkey)"),
    ("count_if", lambda: F.count_if(y > 25), "count_if(l_quantity > 25)::BIGINT"),
    ("quantile", lambda: r(F.percentile(x, 0.9)), f"round({Q.format(0.9)}, 4)"),
    ("quantile_disc", lambda: F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)"), "quantile_disc(l_quantity, 0.5)"),
    ("corr", lambda: r(F.corr(x, y), 6), f"round(corr({X}, {Y}), 6)"),
    ("covar_pop", lambda: r(F.covar_pop(x, y)), f"round(covar_pop({X}, {Y}), 4)"),
    ("covar_samp", lambda: r(F.covar_samp(x, y)), f"round(covar_samp({X}, {Y}), 4)"),
    ("regr_slope", lambda: r(F.regr_slope(x, y)), f"round(regr_slope({X}, {Y}), 4)"),
    ("regr_intercept", lambda: r(F.regr_intercept(x, y)), f"round(regr_intercept({X}, {Y}), 4)"),
    ("regr_r2", lambda: r(F.regr_r2(x, y)), f"round(regr_r2({X}, {Y}), 4)"),
    ("regr_count", lambda: F.regr_count(x, y), f"regr_count({X}, {Y})::BIGINT"),
    ("regr_avgx", lambda: r(F.regr_avgx(x, y)), f"round(regr_avgx({X}, {Y}), 4)"),
    ("regr_avgy", lambda: r(F.regr_avgy(x, y)), f"round(regr_avgy({X}, {Y}), 4)"),
    ("regr_sxx", lambda: r(F.regr_sxx(x, y), 2), f"round(regr_sxx({X}, {Y}), 2)"),
    ("regr_syy", lambda: r(F.regr_syy(x, y), 2), f"round(regr_syy({X}, {Y}), 2)"),
    ("regr_sxy", lambda: r(F.regr_sxy(x, y), 2), f"round(regr_sxy({X}, {Y}), 2)"),
    ("geometric_mean", lambda: r(A.geometric_mean(x)), f"round(exp(avg(ln({X}))), 4)"),
    ("harmonic_mean", lambda: r(A.harmonic_mean(x)), f"round(count({X}) / sum(1 / ({X})), 4)"),
    ("rms", lambda: r(A.rms(x)), f"round(sqrt(avg({X} * {X})), 4)"),
    ("cv", lambda: r(A.cv(x)), f"round(stddev_samp({X}) / avg({X}), 4)"),
    ("sem", lambda: r(A.sem(x)), f"round(stddev_samp({X}) / sqrt(count({X})), 4)"),
    ("midrange", lambda: r(A.midrange(x)), f"round((max({X}) + min({X})) / 2, 4)"),
    ("value_range", lambda: r(A.value_range(x)), f"round(max({X}) - min({X}), 4)"),
    ("weighted_mean", lambda: r(A.weighted_mean(x, y)), f"round(sum({X} * {WT}) / sum({WT}), 4)"),
    ("weighted_var", lambda: r(A.weighted_var(x, y), 2), f"round(sum({X} * {X} * {WT}) / sum({WT}) - pow(sum({X} * {WT}) / sum({WT}), 2), 2)"),
    ("weighted_std", lambda: r(A.weighted_std(x, y), 3), f"round(sqrt(sum({X} * {X} * {WT}) / sum({WT}) - pow(sum({X} * {WT}) / sum({WT}), 2)), 3)"),
    ("weighted_covariance", lambda: r(A.weighted_covariance(x, c("l_tax"), y)), f"round(sum({X} * l_tax * {WT}) / sum({WT}) - sum({X} * {WT}) / sum({WT}) * sum(l_tax * {WT}) / sum({WT}), 4)"),
    ("weighted_correlation", lambda: r(A.weighted_correlation(x, c("l_tax"), y)), f"round((sum({X} * l_tax * {WT}) / sum({WT}) - sum({X} * {WT}) / sum({WT}) * sum(l_tax * {WT}) / sum({WT})) / sqrt((sum({X} * {X} * {WT}) / sum({WT}) - pow(sum({X} * {WT}) / sum({WT}), 2)) * (sum(l_tax * l_tax * {WT}) / sum({WT}) - pow(sum(l_tax * {WT}) / sum({WT}), 2))), 4)"),
    ("q1", lambda: r(A.q1(x)), f"round({Q.format(0.25)}, 4)"),
    ("q3", lambda: r(A.q3(x)), f"round({Q.format(0.75)}, 4)"),
    ("iqr", lambda: r(A.iqr(x)), f"round({Q.format(0.75)} - {Q.format(0.25)}, 4)"),
    ("midhinge", lambda: r(A.midhinge(x)), f"round(({Q.format(0.75)} + {Q.format(0.25)}) / 2, 4)"),
    ("trimean", lambda: r(A.trimean(x)), f"round(({Q.format(0.75)} + 2 * {Q.format(0.5)} + {Q.format(0.25)}) / 4, 4)"),
    ("quartile_dispersion", lambda: r(A.quartile_dispersion(x)), f"round(({Q.format(0.75)} - {Q.format(0.25)}) / ({Q.format(0.75)} + {Q.format(0.25)}), 4)"),
    ("bowley_skew", lambda: r(A.bowley_skew(x)), f"round(({Q.format(0.75)} + {Q.format(0.25)} - 2 * {Q.format(0.5)}) / ({Q.format(0.75)} - {Q.format(0.25)}), 4)"),
    ("interdecile_range", lambda: r(A.interdecile_range(x)), f"round({Q.format(0.9)} - {Q.format(0.1)}, 4)"),
    ("decile_ratio", lambda: r(A.decile_ratio(x)), f"round({Q.format(0.9)} / {Q.format(0.1)}, 4)"),
    ("index_of_dispersion", lambda: r(A.index_of_dispersion(x)), f"round(var_samp({X}) / avg({X}), 4)"),
    ("signal_to_noise", lambda: r(A.signal_to_noise(x)), f"round(avg({X}) / stddev_samp({X}), 4)"),
    ("studentized_range", lambda: r(A.studentized_range(x)), f"round((max({X}) - min({X})) / stddev_samp({X}), 4)"),
    ("relative_range", lambda: r(A.relative_range(x)), f"round((max({X}) - min({X})) / avg({X}), 4)"),
    ("geometric_std", lambda: r(A.geometric_std(x)), f"round(exp(stddev_samp(ln({X}))), 4)"),
    ("moors_kurtosis", lambda: r(A.moors_kurtosis(x)), f"round((({Q.format(0.875)} - {Q.format(0.625)}) + ({Q.format(0.375)} - {Q.format(0.125)})) / ({Q.format(0.75)} - {Q.format(0.25)}), 4)"),
    ("null_rate", lambda: r(A.null_rate(F.nullif(c("l_linenumber"), F.lit(1)))), "round(count(*) FILTER (l_linenumber = 1) / count(*), 4)"),
    ("non_null_rate", lambda: r(A.non_null_rate(F.nullif(c("l_linenumber"), F.lit(1)))), "round(count(*) FILTER (l_linenumber <> 1) / count(*), 4)"),
    ("nunique_ratio", lambda: r(A.nunique_ratio(i), 6), "round(count(DISTINCT l_partkey) / count(l_partkey), 6)"),
    ("arg_min", lambda: F.min_by(c("l_orderkey"), F.struct("l_extendedprice", "l_orderkey")), "arg_min(l_orderkey, (l_extendedprice, l_orderkey))"),
    ("arg_max", lambda: F.max_by(c("l_orderkey"), F.struct("l_extendedprice", "l_orderkey")), "arg_max(l_orderkey, (l_extendedprice, l_orderkey))"),
    ("first", lambda: F.min_by(c("l_orderkey"), F.struct("l_shipdate", "l_orderkey")), "arg_min(l_orderkey, (l_shipdate, l_orderkey))"),
    ("last", lambda: F.max_by(c("l_orderkey"), F.struct("l_shipdate", "l_orderkey")), "arg_max(l_orderkey, (l_shipdate, l_orderkey))"),
    ("string_agg", lambda: F.length(A.string_agg(c("l_linenumber").cast("string"), ",", c("l_orderkey"))), "length(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_orderkey))::INTEGER"),
    ("filtered_sum", lambda: r(F.sum(F.when(c("l_tax") > 0.04, y))), "round(sum(l_quantity) FILTER (l_tax > 0.04), 4)"),
    ("approx_n_unique", lambda: F.approx_count_distinct("l_partkey") > 0, "true"),
    ("approx_quantile", lambda: F.percentile_approx("l_quantity", 0.5, 10000), "quantile_disc(l_quantity, 0.5)"),
]:
    query(f"agg_{name}", f"SELECT l_returnflag, l_linestatus, {sql} AS value FROM lineitem GROUP BY 1, 2", "lineitem")(lambda l, column=column: l.groupBy("l_returnflag", "l_linestatus").agg(column().alias("value")))

for name, sql, tables, f in [
    ("mode", "SELECT p_brand, (SELECT p_size FROM part q WHERE q.p_brand = p.p_brand GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1) AS mode FROM (SELECT DISTINCT p_brand FROM part) p", "part", lambda p: A.mode(p, ["p_brand"], "p_size")),
    ("entropy", "SELECT p_brand, round(entropy(p_size), 6) AS entropy FROM part GROUP BY 1", "part", lambda p: A.entropy(p, ["p_brand"], "p_size").withColumn("entropy", r(c("entropy"), 6))),
    ("mad", "SELECT p_brand, round(mad(p_retailprice), 4) AS mad FROM part GROUP BY 1", "part", lambda p: A.mad(p, ["p_brand"], "p_retailprice").withColumn("mad", r(c("mad")))),
    ("histogram", "SELECT o_orderstatus, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2", "orders", lambda o: A.histogram(o, ["o_orderstatus"], "o_orderpriority").select("o_orderstatus", F.explode("histogram").alias("k", "n"))),
    ("top_values", "SELECT p_brand, string_agg(p_size, ',' ORDER BY k) AS top FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY 1, 2) WHERE k <= 3 GROUP BY 1", "part", lambda p: A.top_values(p, ["p_brand"], "p_size", 3).select("p_brand", F.array_join(c("top").cast("array<string>"), ",").alias("top"))),
    ("assembly_n50", "SELECT source, max(n_chars) FILTER (s >= t * 0.5) AS n, min(k) FILTER (s >= t * 0.5)::INTEGER AS l, round(sum(n_chars * n_chars) / sum(n_chars), 4) AS aun FROM (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS s, sum(n_chars) OVER (PARTITION BY source) AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC) AS k FROM documents) GROUP BY 1", "documents", lambda d: A.assembly(d, ["source"], "n_chars").withColumn("aun", r(c("aun")))),
    ("rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem", lambda l: l.rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").alias("g"), F.sum("l_quantity").alias("q"))),
    ("cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem", lambda l: l.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))),
    ("grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "lineitem", lambda l: l.groupingSets([[c("l_returnflag")], [c("l_linestatus")], []], c("l_returnflag"), c("l_linestatus")).agg(F.sum("l_quantity").alias("q"))),
    ("global", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS s, round(avg(l_quantity), 4) AS q FROM lineitem", "lineitem", lambda l: l.agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("s"), r(F.avg("l_quantity")).alias("q"))),
    ("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15", "orders", lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")),
]:
    query(f"agg_{name}", sql, tables)(f)

# Windows over events by user in time order.
WS = "OVER (PARTITION BY user_id ORDER BY event_id)"
for name, column, sql in [
    ("row_number", lambda: F.row_number().over(w), f"row_number() {WS}::INTEGER"),
    ("rank", lambda: F.rank().over(Window.partitionBy("user_id").orderBy("event_type")), "rank() OVER (PARTITION BY user_id ORDER BY event_type)::INTEGER"),
    ("dense_rank", lambda: F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")), "dense_rank() OVER (PARTITION BY user_id ORDER BY event_type)::INTEGER"),
    ("percent_rank", lambda: r(F.percent_rank().over(w), 6), f"round(percent_rank() {WS}, 6)"),
    ("cume_dist", lambda: r(F.cume_dist().over(w), 6), f"round(cume_dist() {WS}, 6)"),
    ("ntile", lambda: F.ntile(4).over(w), f"ntile(4) {WS}::INTEGER"),
    ("lag", lambda: F.lag("value", 2).over(w), f"lag(value, 2) {WS}"),
    ("lead", lambda: F.lead("value", 1, -1.0).over(w), f"lead(value, 1, -1) {WS}"),
    ("first_value", lambda: F.first("value").over(w), f"first_value(value) {WS}"),
    ("last_value", lambda: F.last("value").over(w), f"last_value(value) {WS}"),
    ("nth_value", lambda: F.nth_value("value", 3).over(w), f"nth_value(value, 3) {WS}"),
    ("cum_sum", lambda: r(F.sum("value").over(run)), f"round(sum(value) {WS}, 4)"),
    ("cum_min", lambda: F.min("value").over(run), f"min(value) {WS}"),
    ("cum_max", lambda: F.max("value").over(run), f"max(value) {WS}"),
    ("cum_count", lambda: F.count("value").over(run), f"count(value) {WS}"),
    ("cum_prod", lambda: r(F.product(1 + c("value") / 10000).over(run) + 3e-7, 5), f"round(product(1 + value / 10000) {WS} + 3e-7, 5)"),
    ("expanding_mean", lambda: r(F.avg("value").over(run) + 3e-6), f"round(avg(value) {WS} + 3e-6, 4)"),
    ("cumulative_pct", lambda: r(F.sum("value").over(run) / F.sum("value").over(Window.partitionBy("user_id"))), f"round(sum(value) {WS} / sum(value) OVER (PARTITION BY user_id), 4)"),
    ("rolling_mean", lambda: r(W.rolling(F.avg("value"), "value", w, 3)), "round(CASE WHEN count(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) >= 3 THEN avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) END, 4)"),
    ("rolling_sum", lambda: r(W.rolling(F.sum("value"), "value", w, 3, 1)), "round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING), 4)"),
    ("rolling_std", lambda: r(W.rolling(F.stddev_samp("value"), "value", w, 4)), "round(CASE WHEN count(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) >= 4 THEN stddev_samp(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) END, 4)"),
    ("rolling_mean_by", lambda: r(W.rolling_by(F.avg("value"), ["user_id"], "ts", 3_600_000_000)), "round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 4)"),
    ("rolling_count_by", lambda: W.rolling_by(F.count("value"), ["user_id"], "ts", 3_600_000_000), "count(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"),
    ("rolling_min_by", lambda: W.rolling_by(F.min("value"), ["user_id"], "ts", 3_600_000_000), "min(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"),
    ("diff", lambda: r(W.diff("value", w)), f"round(value - lag(value) {WS}, 4)"),
    ("pct_change", lambda: r(W.pct_change("value", w)), f"round(value / nullif(lag(value) {WS}, 0) - 1, 4)"),
    ("zscore", lambda: r(W.zscore("value", ["user_id"])), "round((value - avg(value) OVER (PARTITION BY user_id)) / stddev_samp(value) OVER (PARTITION BY user_id), 4)"),
    ("minmax_scale", lambda: r(W.minmax_scale("value", ["user_id"])), "round((value - min(value) OVER (PARTITION BY user_id)) / (max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id)), 4)"),
    ("mean_center", lambda: r(W.mean_center("value", ["user_id"]) + 3e-6), "round(value - avg(value) OVER (PARTITION BY user_id) + 3e-6, 4)"),
    ("pct_of_total", lambda: r(W.pct_of_total("value", ["user_id"])), "round(value / sum(value) OVER (PARTITION BY user_id), 4)"),
    ("rank_pct", lambda: r(W.rank_pct(wv, ["user_id"]), 6), "round(rank() OVER (PARTITION BY user_id ORDER BY value, event_id) / count(*) OVER (PARTITION BY user_id), 6)"),
    ("is_unique", lambda: F.count("*").over(Window.partitionBy("value")) == 1, "count(*) OVER (PARTITION BY value) = 1"),
    ("is_duplicated", lambda: F.count("*").over(Window.partitionBy("value")) > 1, "count(*) OVER (PARTITION BY value) > 1"),
    ("is_first_distinct", lambda: F.row_number().over(Window.partitionBy("value").orderBy("event_id")) == 1, "row_number() OVER (PARTITION BY value ORDER BY event_id) = 1"),
    ("is_last_distinct", lambda: F.row_number().over(Window.partitionBy("value").orderBy(F.desc("event_id"))) == 1, "row_number() OVER (PARTITION BY value ORDER BY event_id DESC) = 1"),
    ("peak_max", lambda: W.peak_max("value", w), f"coalesce(value > lag(value) {WS} AND value > lead(value) {WS}, false)"),
    ("median", lambda: r(F.median("value").over(Window.partitionBy("user_id"))), "round(median(value) OVER (PARTITION BY user_id), 4)"),
    ("count_distinct", lambda: F.size(F.collect_set("event_type").over(Window.partitionBy("user_id"))), "count(DISTINCT event_type) OVER (PARTITION BY user_id)::INTEGER"),
]:
    query(f"window_{name}", f"SELECT event_id, {sql} AS value FROM events", "events")(lambda e, column=column: e.select("event_id", column().alias("value")))

for name, sql, tables, f in [
    ("groups_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS value FROM events", "events", lambda e: W.with_groups_frame(e, F.sum("value"), "s", ["user_id"], ["event_type"], 1, 0).select("event_id", r(c("s")).alias("value"))),
    ("rle_id", "SELECT event_id, sum(f) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS rle_id FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type THEN 1 ELSE 0 END AS f FROM events)", "events", lambda e: W.with_rle_id(e, "event_type", w).select("event_id", "rle_id")),
    ("session", "SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS f FROM events)) GROUP BY user_id, s", "events", lambda e: W.sessions(e, "ts", "2 hours", ["user_id"], [F.count("*").alias("n")])),
    ("qualify", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2", "events", lambda e: W.qualify(e, F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")) <= 2).select("event_id")),
    ("interpolate", "SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v ELSE a + (b - a) * (event_id - ai) / (bi - ai) END + 3e-6, 4) AS value FROM (SELECT event_id, v, last_value(v IGNORE NULLS) OVER p AS a, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS ai, first_value(v IGNORE NULLS) OVER q AS b, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER q AS bi FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events) WINDOW p AS (PARTITION BY user_id ORDER BY event_id), q AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", "events", lambda e: e.withColumn("v", F.when(c("event_id") % 4 == 0, c("value"))).select("event_id", r(W.interpolate("v", c("event_id"), w) + 3e-6).alias("value"))),
    ("ewm_mean", None, "events", lambda e: e.select("event_id", r(W.ewm_mean("value", w, 0.3)).alias("value"))),
    ("tumbling", "SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS hour, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1", "events", lambda e: e.groupBy(F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("v"))),
    ("sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([make_timestamp(epoch_us(ts) - epoch_us(ts) % 900000000 - k * 900000000) FOR k IN range(0, 4)]) AS s FROM events) GROUP BY 1", "events", lambda e: e.groupBy(F.window("ts", "1 hour", "15 minutes")["start"].alias("start")).agg(F.count("*").alias("n"))),
]:
    query(f"window_{name}", sql, tables)(f)
