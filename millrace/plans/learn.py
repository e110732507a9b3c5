"""Queries over the shape of graphs, statistics, encoders, features and scores of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph_shape as S
from ..operators import learn as L
from .relational import query

c = F.col


def rounded(df, n=6):
    """df with its doubles rounded."""
    return df.select(*(F.round(x, n).alias(x) if t == "double" else c(x) for x, t in df.dtypes))


def items(l):
    return l.select(c("l_suppkey").cast("long").alias("src"), c("l_partkey").cast("long").alias("dst"), c("l_quantity").cast("double").alias("weight"))


E = "e AS (SELECT l_suppkey::BIGINT AS src, l_partkey::BIGINT AS dst, l_quantity::DOUBLE AS weight FROM lineitem)"
ENDS = f"{E}, d AS (SELECT id, count(*) AS d, sum(weight) AS w FROM (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1)"
PLAIN = "s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)"
PAIRS = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), g AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM u UNION ALL SELECT b FROM u) GROUP BY 1), x AS (SELECT p.d AS x, q.d AS y FROM u JOIN g p ON p.v = a JOIN g q ON q.v = b)"

for _n, _sql, _tables, _f in [
    ("weighted_degree", f"WITH {ENDS} SELECT id, round(w, 6) AS weighted_degree FROM d", "lineitem", lambda l: S.weighted_degree(items(l))),
    ("degree_distribution", f"WITH {ENDS} SELECT d AS degree, count(*) AS nodes FROM d GROUP BY 1", "lineitem", lambda l: S.degree_distribution(items(l))),
    ("degree_centrality", f"WITH {ENDS} SELECT id, round(d / ((SELECT count(*) FROM d) - 1), 6) AS degree_centrality FROM d", "lineitem", lambda l: S.degree_centrality(items(l))),
    ("average_degree", f"WITH {ENDS} SELECT round(avg(d), 6) AS average_degree FROM d", "lineitem", lambda l: S.summarize(items(l)).select("average_degree")),
    ("isolated_nodes", "SELECT p_partkey::BIGINT AS id FROM part WHERE p_partkey NOT IN (SELECT l_suppkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)", "lineitem part", lambda l, p: S.isolated_nodes(items(l), p.select(c("p_partkey").cast("long").alias("id")))),
    (
        "summarize",
        f"WITH {ENDS}, {PLAIN}, n AS (SELECT count(*) AS nodes, sum(d)::DOUBLE AS ends, max(d) AS max_degree FROM d) SELECT nodes, (ends / 2)::BIGINT AS edges, round((SELECT count(*) FROM s) / (nodes * (nodes - 1)), 6) AS density, round((SELECT count(*) FROM s WHERE (dst, src) IN (SELECT (src, dst) FROM s)) / (SELECT count(*) FROM s), 6) AS reciprocity, round(ends / nodes, 6) AS average_degree, max_degree FROM n",
        "lineitem",
        lambda l: S.summarize(items(l)),
    ),
    ("density", f"WITH {ENDS}, {PLAIN} SELECT round((SELECT count(*) FROM s) / (count(*) * (count(*) - 1)), 6) AS density FROM d", "lineitem", lambda l: S.summarize(items(l)).select("density")),
    ("reciprocity", f"WITH {E}, {PLAIN} SELECT round(avg(((dst, src) IN (SELECT (src, dst) FROM s))::INTEGER), 6) AS reciprocity FROM s", "lineitem", lambda l: S.summarize(items(l)).select("reciprocity")),
    ("assortativity", f"WITH {E}, {PAIRS} SELECT round(corr(x, y), 6) AS assortativity FROM (SELECT x, y FROM x UNION ALL SELECT y, x FROM x)", "lineitem", lambda l: S.assortativity(items(l))),
    ("aggregate_neighbors", f"WITH {E} SELECT p_partkey::BIGINT AS id, round(avg(s_acctbal), 6) AS x_mean FROM part LEFT JOIN e ON dst = p_partkey LEFT JOIN supplier ON s_suppkey = src GROUP BY 1", "lineitem part supplier", lambda l, p, s: S.aggregate_neighbors(items(l), s.select(c("s_suppkey").cast("long").alias("id"), c("s_acctbal").alias("x")).join(p.select(c("p_partkey").cast("long").alias("id")), "id", "full"), ["x"]).join(p.select(c("p_partkey").cast("long").alias("id")), "id", "left_semi")),
    ("component_sizes", None, "lineitem", lambda l: S.component_sizes(items(l))),
    ("largest_component", None, "lineitem", lambda l: S.largest_component(items(l))),
    ("is_connected", None, "lineitem", lambda l: S.is_connected(items(l))),
    ("propagate_features", None, "lineitem supplier", lambda l, s: S.propagate_features(items(l), s.select(c("s_suppkey").cast("long").alias("id"), c("s_acctbal").alias("x")), ["x"], 2)),
    ("neighbor_sample", f"WITH {E}, {PLAIN} SELECT src, least(count(*), 5) AS n FROM s GROUP BY 1", "lineitem", lambda l: S.neighbor_sample(items(l), 5).groupBy("src").agg(F.count("*").alias("n"))),
    ("node_sample", None, "lineitem", lambda l: S.node_sample(items(l), 0.1)),
    ("edge_sample", None, "lineitem", lambda l: S.edge_sample(items(l), 0.1)),
    ("random_walks", None, "lineitem supplier", lambda l, s: S.random_walks(items(l), s.select(c("s_suppkey").cast("long").alias("id")), 3)),
    ("ego_network", f"WITH {E}, n AS (SELECT 1::BIGINT AS id UNION SELECT dst FROM e WHERE src = 1) SELECT src, dst, count(*) AS n FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1, 2", "lineitem", lambda l: S.ego_network(items(l), 1).groupBy("src", "dst").agg(F.count("*").alias("n"))),
    ("personalized_pagerank", None, "lineitem", lambda l: S.personalized_pagerank(items(l), l.select(c("l_suppkey").cast("long").alias("id")).agg(F.min("id").alias("id")), 3)),
    (
        "katz_centrality",
        f"WITH {ENDS}, one AS (SELECT id, 1 + 0.01 * coalesce(n, 0) AS x FROM d LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) ON dst = id), two AS (SELECT id, 1 + 0.01 * coalesce(n, 0) AS x FROM d LEFT JOIN (SELECT dst, sum(x) AS n FROM e JOIN one ON one.id = src GROUP BY 1) ON dst = id) SELECT id, round(x / sqrt((SELECT sum(x * x) FROM two)), 6) AS katz_centrality FROM two",
        "lineitem",
        lambda l: S.katz_centrality(items(l), 0.01, rounds=2),
    ),
]:
    query(f"graph_{_n}", _sql, _tables)(lambda *t, f=_f: rounded(f(*t)))

#: Columns of doubles, which both sides round, and their digits where they aren't 6.
DOUBLES = {
    "quantiles": "q0 q1 q2",
    "concentration": "entropy normalized_entropy gini_impurity herfindahl_index mode_share",
    "bartlett": "statistic",
    "f_classif_scores": "f",
    "f_regression_scores": "f",
    "rank_transform": "rank",
    "woe_encode": "woe",
    "leave_one_out_encode": "loo",
    "binary_encode": "",
    "group_stats": "group_l_quantity_mean group_l_quantity_min group_l_quantity_max",
    "group_impute": "value",
    "bin_uniform": "",
    "bin_quantile": "",
    "calendar_features": "",
    "cyclical": "h_sin h_cos",
    "lags": "value_lag_1 value_lag_3",
    "rolling": "value_roll_mean value_roll_min value_roll_max",
    "tfidf": "weight",
    "calibration": "expected_calibration_error maximum_calibration_error brier_skill_score",
    "fairness": "selection_rate true_positive_rate false_positive_rate precision",
    "fairness_gaps": "demographic_parity_difference disparate_impact_ratio equal_opportunity_difference equalized_odds_difference predictive_parity_difference",
    "ranked": "roc_auc gini_coefficient average_precision ks_statistic best_f1 best_threshold",
    "blend": "score",
    "majority": "",
    "packed": "",
}
PLACES = dict.fromkeys(["quantiles", "trimmed_mean", "winsorized_mean", "median_abs_deviation", "mean_abs_deviation", "bartlett", "f_classif_scores", "f_regression_scores", "group_impute"], 3)


def _rounded(name: str, sql: str) -> str:
    doubles = DOUBLES.get(name, name).split()
    return f"SELECT * REPLACE ({', '.join(f'round({x}::DOUBLE, {PLACES.get(name, 6)}) AS {x}' for x in doubles)}) FROM ({sql})" if doubles else sql


Q = "l_extendedprice::DOUBLE"
CUTS = f"q AS (SELECT quantile_cont({Q}, 0.1) AS lo, quantile_cont({Q}, 0.9) AS hi FROM lineitem)"
FLAG = "(l_returnflag = 'R')"
RANK = f"b AS (SELECT l_quantity / 51.0::DOUBLE AS s, sum({FLAG}::INTEGER)::DOUBLE AS p, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(p) OVER () AS ps, sum(n) OVER () AS ns, sum(p) OVER (ORDER BY s) AS up, sum(n) OVER (ORDER BY s) AS un, sum(p) OVER (ORDER BY s DESC) AS ap, sum(n) OVER (ORDER BY s DESC) AS an FROM b)"
GROUPS = f"SELECT l_linestatus, count(*) AS n, avg((l_quantity > 25)::INTEGER) AS selection_rate, avg((l_quantity > 25)::INTEGER) FILTER ({FLAG}) AS true_positive_rate, avg((l_quantity > 25)::INTEGER) FILTER (NOT {FLAG}) AS false_positive_rate, avg({FLAG}::INTEGER) FILTER (l_quantity > 25) AS precision FROM lineitem GROUP BY 1"
KEY = "l_orderkey, l_linenumber"
key = KEY.split(", ")


def late():
    return c("l_returnflag") == "R"


def score():
    return c("l_quantity").cast("double") / 51


def f64(l):
    return l.withColumn("l_extendedprice", c("l_extendedprice").cast("double"))


for _n, _sql, _tables, _f in [
    ("quantiles", f"SELECT quantile_cont({Q}, 0.05) AS q0, quantile_cont({Q}, 0.5) AS q1, quantile_cont({Q}, 0.99) AS q2 FROM lineitem", "lineitem", lambda l: L.quantiles(l, "l_extendedprice", [0.05, 0.5, 0.99])),
    ("trimmed_mean", f"WITH {CUTS} SELECT avg({Q}) AS trimmed_mean FROM lineitem, q WHERE {Q} BETWEEN lo AND hi", "lineitem", lambda l: L.trimmed_mean(f64(l), "l_extendedprice")),
    ("winsorized_mean", f"WITH {CUTS} SELECT avg(greatest(lo, least({Q}, hi))) AS winsorized_mean FROM lineitem, q", "lineitem", lambda l: L.winsorized_mean(f64(l), "l_extendedprice")),
    ("median_abs_deviation", f"SELECT mad({Q}) * 1.4826 AS median_abs_deviation FROM lineitem", "lineitem", lambda l: L.median_abs_deviation(f64(l), "l_extendedprice")),
    ("mean_abs_deviation", f"SELECT avg(abs({Q} - (SELECT avg({Q}) FROM lineitem))) AS mean_abs_deviation FROM lineitem", "lineitem", lambda l: L.mean_abs_deviation(f64(l), "l_extendedprice")),
    ("rank_transform", f"SELECT {KEY}, percent_rank() OVER (ORDER BY l_extendedprice) AS rank FROM lineitem", "lineitem", lambda l: L.rank_transform(f64(l), "l_extendedprice", "rank").select(*key, "rank")),
    ("concentration", "WITH p AS (SELECT count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_custkey) SELECT -sum(p * log2(p)) AS entropy, -sum(p * ln(p)) / ln(count(*)) AS normalized_entropy, 1 - sum(p * p) AS gini_impurity, sum(p * p) AS herfindahl_index, max(p) AS mode_share FROM p", "orders", lambda o: L.concentration(o, "o_custkey")),
    ("bartlett", f"WITH g AS (SELECT count(*)::DOUBLE AS n, var_samp({Q}) AS v FROM lineitem GROUP BY l_linestatus), t AS (SELECT sum(n - 1) AS f, sum((n - 1) * v) / sum(n - 1) AS p, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS i, count(*) - 1 AS df FROM g) SELECT (f * ln(p) - l) / (1 + (i - 1 / f) / (3 * df)) AS statistic, df FROM t", "lineitem", lambda l: L.bartlett(f64(l), "l_extendedprice", "l_linestatus")),
    ("f_classif_scores", "WITH m AS (SELECT avg(l_quantity) AS m, count(*) AS n FROM lineitem), g AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS a, var_pop(l_quantity) AS v FROM lineitem GROUP BY l_returnflag) SELECT 'l_quantity' AS \"column\", (sum(g.n * (a - m) * (a - m)) / (count(*) - 1)) / (sum(g.n * v) / (any_value(m.n) - count(*))) AS f FROM g, m", "lineitem", lambda l: L.f_classif_scores(l, ["l_quantity"], "l_returnflag")),
    ("f_regression_scores", f"WITH r AS (SELECT corr(l_quantity, {Q}) AS r, count(*) AS n FROM lineitem) SELECT 'l_quantity' AS \"column\", r * r / (1 - r * r) * (n - 2) AS f FROM r", "lineitem", lambda l: L.f_regression_scores(f64(l), ["l_quantity"], "l_extendedprice")),
    ("partial_correlation", f"WITH r AS (SELECT corr({Q}, l_tax) AS a, corr({Q}, l_quantity) AS b, corr(l_tax, l_quantity) AS d FROM lineitem) SELECT (a - b * d) / sqrt((1 - b * b) * (1 - d * d)) AS partial_correlation FROM r", "lineitem", lambda l: L.partial_correlation(f64(l), "l_extendedprice", "l_tax", "l_quantity")),
    ("woe_encode", f"WITH g AS (SELECT l_suppkey, sum({FLAG}::INTEGER) AS p, sum((NOT {FLAG})::INTEGER) AS q FROM lineitem GROUP BY 1), w AS (SELECT l_suppkey, CASE WHEN p > 0 AND q > 0 THEN ln((p / (SELECT sum(p) FROM g)) / (q / (SELECT sum(q) FROM g))) ELSE 0 END AS woe FROM g) SELECT {KEY}, woe FROM lineitem JOIN w USING (l_suppkey)", "lineitem", lambda l: L.woe_encode(l, "l_suppkey", late(), "woe").select(*key, "woe")),
    ("leave_one_out_encode", f"SELECT {KEY}, coalesce((sum(l_quantity) OVER w - l_quantity) / nullif(count(*) OVER w - 1, 0), (SELECT avg(l_quantity) FROM lineitem)) AS loo FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)", "lineitem", lambda l: L.leave_one_out_encode(l, "l_suppkey", "l_quantity", "loo").select(*key, "loo")),
    ("binary_encode", "WITH k AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS k FROM customer) SELECT c_custkey, (k & 1)::INTEGER AS c_mktsegment_0, ((k >> 1) & 1)::INTEGER AS c_mktsegment_1, ((k >> 2) & 1)::INTEGER AS c_mktsegment_2 FROM k", "customer", lambda t: L.binary_encode(t.select("c_custkey", "c_mktsegment"), "c_mktsegment", 3).drop("c_mktsegment")),
    ("group_stats", f"SELECT {KEY}, avg(l_quantity) OVER w AS group_l_quantity_mean, min(l_quantity) OVER w AS group_l_quantity_min, max(l_quantity) OVER w AS group_l_quantity_max FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)", "lineitem", lambda l: L.group_stats(l, "l_suppkey", "l_quantity", ["mean", "min", "max"]).select(*key, *(f"group_l_quantity_{s}" for s in ("mean", "min", "max")))),
    ("group_impute", "SELECT event_id, coalesce(value, avg(value) OVER (PARTITION BY event_type), (SELECT avg(value) FROM events)) AS value FROM events", "events", lambda e: L.group_impute(e, "event_type", "value").select("event_id", "value")),
    ("bin_uniform", f"WITH m AS (SELECT min({Q}) AS lo, max({Q}) AS hi FROM lineitem) SELECT {KEY}, least(floor(({Q} - lo) * 8 / (hi - lo)), 7)::INTEGER AS bin FROM lineitem, m", "lineitem", lambda l: L.bin_uniform(f64(l), "l_extendedprice", 8, "bin").select(*key, "bin")),
    ("bin_quantile", f"WITH q AS (SELECT quantile_cont({Q}, [0.25, 0.5, 0.75]) AS q FROM lineitem) SELECT {KEY}, len([x FOR x IN q IF x <= {Q}])::INTEGER AS bin FROM lineitem, q", "lineitem", lambda l: L.bin_quantile(f64(l), "l_extendedprice", 4, "bin").select(*key, "bin")),
    ("calendar_features", "SELECT event_id, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month, day(ts)::INTEGER AS ts_day, (isodow(ts) - 1)::INTEGER AS ts_dayofweek, dayofyear(ts)::INTEGER AS ts_dayofyear, hour(ts)::INTEGER AS ts_hour, quarter(ts)::INTEGER AS ts_quarter, isodow(ts) > 5 AS ts_is_weekend FROM events", "events", lambda e: L.calendar_features(e.select("event_id", "ts"), "ts").drop("ts")),
    ("cyclical", "SELECT event_id, sin(hour(ts) * 2 * pi() / 24) AS h_sin, cos(hour(ts) * 2 * pi() / 24) AS h_cos FROM events", "events", lambda e: L.cyclical(e.select("event_id", F.hour("ts").alias("h")), "h", 24).drop("h")),
    ("lags", "SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "events", lambda e: L.lags(e, "value", ["user_id"], ["ts", "event_id"], [1, 3]).select("event_id", "value_lag_1", "value_lag_3")),
    ("rolling", "SELECT event_id, avg(value) OVER w AS value_roll_mean, min(value) OVER w AS value_roll_min, max(value) OVER w AS value_roll_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "events", lambda e: L.rolling(e, "value", ["user_id"], ["ts", "event_id"], 5).select("event_id", "value_roll_mean", "value_roll_min", "value_roll_max")),
    ("tfidf", "WITH t AS (SELECT p_partkey AS k, unnest(regexp_extract_all(lower(p_name), '[a-z0-9_][a-z0-9_]+')) AS term FROM part), f AS (SELECT k, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), w AS (SELECT k, term, tf * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM f JOIN d USING (term)) SELECT k AS p_partkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM w", "part", lambda p: L.tfidf(p, "p_partkey", "p_name")),
    ("calibration", f"WITH s AS (SELECT {FLAG}::INTEGER AS y, l_quantity / 51.0::DOUBLE AS s FROM lineitem), b AS (SELECT least(floor(s * 10), 9) AS b, count(*) AS n, abs(avg(s) - avg(y)) AS gap FROM s GROUP BY 1) SELECT sum(n * gap) / sum(n) AS expected_calibration_error, max(gap) AS maximum_calibration_error, (SELECT 1 - avg((s - y) * (s - y)) / (avg(y) * (1 - avg(y))) FROM s) AS brier_skill_score FROM b", "lineitem", lambda l: L.calibration(l, late(), score())),
    ("fairness", GROUPS, "lineitem", lambda l: L.fairness(l, "l_linestatus", late(), c("l_quantity") > 25)),
    ("fairness_gaps", f"SELECT max(selection_rate) - min(selection_rate) AS demographic_parity_difference, min(selection_rate) / max(selection_rate) AS disparate_impact_ratio, max(true_positive_rate) - min(true_positive_rate) AS equal_opportunity_difference, greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate)) AS equalized_odds_difference, max(precision) - min(precision) AS predictive_parity_difference FROM ({GROUPS})", "lineitem", lambda l: L.fairness_gaps(l, "l_linestatus", late(), c("l_quantity") > 25)),
    ("ranked", f"WITH {RANK} SELECT sum(p * ((un - n) - (up - p) + (n - p) / 2)) / any_value(ps * (ns - ps)) AS roc_auc, 2 * sum(p * ((un - n) - (up - p) + (n - p) / 2)) / any_value(ps * (ns - ps)) - 1 AS gini_coefficient, sum(p / ps * ap / an) AS average_precision, max(abs(up / ps - (un - up) / (ns - ps))) AS ks_statistic, max(2 * ap / (an + ps)) AS best_f1, (SELECT s FROM r ORDER BY round(2 * ap / (an + ps), 12) DESC, s LIMIT 1) AS best_threshold FROM r", "lineitem", lambda l: L.ranked(l, late(), score())),
    ("blend", f"SELECT {KEY}, (l_tax * 3 + l_discount) / 4 AS score FROM lineitem", "lineitem", lambda l: l.select(*key, L.blend(c("l_tax"), c("l_discount"), weights=[3.0, 1.0]).cast("double").alias("score"))),
    ("majority", f"SELECT {KEY}, CASE WHEN l_quantity > 25 AND l_tax > 0.04 OR l_quantity > 25 AND l_discount > 0.05 OR l_tax > 0.04 AND l_discount > 0.05 THEN 1 ELSE 0 END AS vote FROM lineitem", "lineitem", lambda l: l.select(*key, L.majority((c("l_quantity") > 25).cast("int"), (c("l_tax") > 0.04).cast("int"), (c("l_discount") > 0.05).cast("int")).alias("vote"))),
    ("packed", "WITH t AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS b FROM (SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS n FROM documents WHERE length(text) > 0)), s AS (SELECT *, unnest(generate_series((b // 2048)::BIGINT, ((b + n - 1) // 2048)::BIGINT)) AS sequence FROM t) SELECT doc_id, sequence, (greatest(b, sequence * 2048) - sequence * 2048)::BIGINT AS \"offset\", (greatest(b, sequence * 2048) - b)::BIGINT AS start, (least(b + n, (sequence + 1) * 2048) - greatest(b, sequence * 2048))::BIGINT AS n FROM s", "documents", lambda d: L.packed(d, "doc_id", F.ceil(F.length("text") / 4), 2048)),
]:
    query(f"learn_{_n}", _rounded(_n, _sql), _tables)(lambda *t, f=_f, n=PLACES.get(_n, 6): rounded(f(*t), n))
