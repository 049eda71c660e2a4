"""Shapes of stock procedures over the star-schema tables."""

from __future__ import annotations

from weft.operators import relational as r
from weft.plans.registry import query

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def t(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


@query("""SELECT n_name, count(*) AS brands, CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(supplied) AS BIGINT) AS supplied, max(amount) AS most FROM (
SELECT n_name, coalesce(p_brand, 'none') AS brand, CAST(sum(l_quantity) AS BIGINT) * 10 AS amount, count(s_suppkey) AS supplied FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 25 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal >= 0 GROUP BY 1, 2) x GROUP BY n_name""")
def g1_order_rows(spark, sf_dir):
    return r.order_rows(*t(spark, sf_dir, "lineitem", "orders", "customer", "nation", "part", "supplier"))


@query("""SELECT p_partkey, CAST(coalesce(q, 0) AS BIGINT) AS available FROM part LEFT JOIN (SELECT l_partkey, sum(q) AS q FROM (SELECT l_partkey, l_quantity AS q FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE -l_quantity END FROM lineitem WHERE l_linestatus <> 'F') u GROUP BY 1) s ON l_partkey = p_partkey""")
def g2_available(spark, sf_dir):
    return r.available(*t(spark, sf_dir, "lineitem", "part"))


@query("SELECT p_partkey, CAST(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45) THEN p_size ELSE 1000 END AS BIGINT) AS quantity FROM part")
def g3_guarded(spark, sf_dir):
    return r.guarded(*t(spark, sf_dir, "part", "lineitem"))


@query("""SELECT l_partkey, string_agg(CAST(l_suppkey AS STRING), ',' ORDER BY first_ship, l_suppkey) AS bins, count(*) AS n FROM (SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2) f GROUP BY 1""")
def g4_bins(spark, sf_dir):
    return r.bins(*t(spark, sf_dir, "lineitem"))


@query("""SELECT o_custkey, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, min(o_orderstatus) AS status, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'MULTI' ELSE 'SINGLE' END AS label
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def g5_order_header(spark, sf_dir):
    return r.order_header(*t(spark, sf_dir, "lineitem", "orders"))


@query("SELECT DISTINCT n_name, l_returnflag, 1 AS boxes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def g6_wagons(spark, sf_dir):
    return r.wagons(*t(spark, sf_dir, "lineitem", "orders", "customer", "nation"))


@query("""SELECT c_nationkey, c_custkey, c_mktsegment AS segment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS rn FROM customer) x WHERE rn = 1""")
def g7_preferred(spark, sf_dir):
    return r.preferred(*t(spark, sf_dir, "customer"), "BUILDING")


@query("""SELECT p_partkey, o_orderkey, o_orderdate FROM (SELECT p_partkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY p_partkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey) x WHERE rn = 1""")
def g8_latest(spark, sf_dir):
    return r.latest(*t(spark, sf_dir, "lineitem", "orders", "part"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' ELSE 'English:' || lang END AS label, count(*) AS n FROM documents GROUP BY lang")
def g9_translated(spark, sf_dir):
    return r.translated(*t(spark, sf_dir, "documents"))
