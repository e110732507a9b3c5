"""TPC-H-like queries, in the form that the shared tables' columns allow: SQL on views on one side, the same SQL in DuckDB on the other."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .catalogue import register
from .common import load

c = F.col
#: Query texts over the shared tables; the dialect is common to both engines.
QUERIES = {
    "q03": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-06-15' AND l_shipdate > DATE '1998-06-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10",
    "q04": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority",
    "q05": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "q06": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "q07": "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_nationkey < 3 AND n2.n_nationkey < 3 GROUP BY n1.n_name, n2.n_name, year(l_shipdate)",
    "q08": "SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey GROUP BY year(o_orderdate)",
    "q09": "SELECT n_name AS nation, year(o_orderdate) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity / 10), 2) AS sum_profit FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%' GROUP BY n_name, year(o_orderdate)",
    "q10": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "q12": "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high_line_count, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate > o_orderdate GROUP BY o_orderstatus",
    "q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) t GROUP BY c_count",
    "q14": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey",
    "q15": "WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)",
    "q16": "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#1' AND p_size IN (1, 5, 9, 14, 19, 23, 36, 45) GROUP BY p_brand, p_type, p_size",
    "q17": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)",
    "q18": "SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice",
    "q19": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))",
    "q20": "SELECT s_name FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') GROUP BY l_suppkey HAVING sum(l_quantity) > 100) AND s_nationkey = n_nationkey",
    "q21": "SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 45) GROUP BY s_name",
    "q22": "SELECT c_nationkey AS cntry, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN (1, 3, 5, 7) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey",
}
TABLES = "region nation customer supplier part orders lineitem".split()


@register(
    "tpch_q01",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
)
def q01(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")  # noqa: E741
    price = c("l_extendedprice") * (1 - c("l_discount"))
    aggs = [
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"),
        F.round(F.sum(price * (1 + c("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    ]
    return l.groupBy("l_returnflag", "l_linestatus").agg(*aggs).orderBy("l_returnflag", "l_linestatus")


def _of(name: str, text: str) -> None:
    register(f"tpch_{name}", text)(lambda spark, sf_dir: _view_sql(spark, sf_dir, text))


def _view_sql(spark, sf_dir, text):
    """The text over the tables of a folder, without registering views."""
    views = {t: load(spark, sf_dir, t) for t in TABLES}
    named = re.sub(rf"(?<![.\w])(?<!AS )({'|'.join(TABLES)})(?!\w)(?=\s*(?:,|WHERE|GROUP|LEFT|ON|\)|n1|n2|l1|l2|l3|$))", r"{\1}", text)
    used = {t: v for t, v in views.items() if "{" + t + "}" in named}
    return spark.sql(named, **used)


for _name, _text in QUERIES.items():
    _of(_name, _text)
