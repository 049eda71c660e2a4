"""An evidence graph derived from the star-schema tables, by the same SQL on either engine.

Regions are pages, nations APIs, customers methods, suppliers parameters, orders procedures, order lines result
columns and parts columns; the relations between them are those of the evidence graph.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import traverse
from weft.operators.index import Steps, stored, version_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

ROW_KEY = "CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING)"

# Lines may repeat; the tables of the other nodes have one row a key.
LINE_KEYS = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}) k"

EDGES = f"""
SELECT src, relation, dst, 'edge:' || src || '|' || relation || '|' || dst AS edge_id, confidence FROM (
SELECT 'page:region.' || CAST(r_regionkey AS STRING) AS src, 'Calls' AS relation, 'api:nation.' || CAST(n_nationkey AS STRING) AS dst, CAST(1.0 AS DOUBLE) AS confidence FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT 'api:nation.' || CAST(c_nationkey AS STRING), 'HandledBy', 'method:customer.' || CAST(c_custkey AS STRING), CAST(1.0 AS DOUBLE) FROM {{customer}}
UNION ALL SELECT 'api:nation.' || CAST(s_nationkey AS STRING), 'UsesParameter', 'param:supplier.' || CAST(s_suppkey AS STRING), CAST(0.9 AS DOUBLE) FROM {{supplier}}
UNION ALL SELECT 'method:customer.' || CAST(o_custkey AS STRING), 'ExecutesSp', 'sp:orders.' || CAST(o_orderkey AS STRING), CAST(0.95 AS DOUBLE) FROM {{orders}}
UNION ALL SELECT 'sp:orders.' || CAST(l_orderkey AS STRING), 'Contains', 'spcol:lineitem.' || {ROW_KEY}, CAST(1.0 AS DOUBLE) FROM {LINE_KEYS}
UNION ALL SELECT 'spcol:lineitem.' || {ROW_KEY}, 'AliasOf', 'column:part.' || CAST(l_partkey AS STRING), CAST(1.0 AS DOUBLE) FROM {LINE_KEYS}
UNION ALL SELECT 'spcol:lineitem.' || {ROW_KEY}, 'ControlledBy', 'param:supplier.' || CAST(l_suppkey AS STRING), CAST(0.8 AS DOUBLE) FROM {LINE_KEYS}
) e"""

NODES = f"""
SELECT 'page:region.' || CAST(r_regionkey AS STRING) AS id, 'Page' AS type, r_name AS name, 'Web' AS layer, 'Known' AS status FROM {{region}}
UNION ALL SELECT 'api:nation.' || CAST(n_nationkey AS STRING), 'Api', n_name, 'Api', 'Known' FROM {{nation}}
UNION ALL SELECT 'method:customer.' || CAST(c_custkey AS STRING), 'Method', c_name, 'Service', CASE WHEN c_acctbal < 0 THEN 'Unknown' ELSE 'Known' END FROM {{customer}}
UNION ALL SELECT 'param:supplier.' || CAST(s_suppkey AS STRING), 'SystemParameter', s_name, 'Config', 'Known' FROM {{supplier}}
UNION ALL SELECT 'sp:orders.' || CAST(o_orderkey AS STRING), 'StoredProcedure', 'order ' || CAST(o_orderkey AS STRING), 'Data', CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Known' END FROM {{orders}}
UNION ALL SELECT 'spcol:lineitem.' || {ROW_KEY}, 'ResultColumn', CAST(l_linenumber AS STRING), 'Data', 'Known' FROM {LINE_KEYS}
UNION ALL SELECT 'column:part.' || CAST(p_partkey AS STRING), 'Column', p_name, 'Data', 'Known' FROM {{part}}"""

# One record for each distinct output, source and condition; returned lines are conditional, a few of zero tax literal.
LINEAGE = f"""
SELECT output, source, transform, expression, condition, 'lineage:' || output || '<-' || coalesce(source, '?') || coalesce('[' || condition || ']', '') AS lineage_id, max(confidence) AS confidence FROM (
SELECT 'spcol:lineitem.' || {ROW_KEY} AS output, CASE WHEN l_tax = 0 THEN NULL ELSE 'column:part.' || CAST(l_partkey AS STRING) END AS source,
CASE WHEN l_tax = 0 AND l_linestatus = 'O' THEN 'Literal' WHEN l_returnflag = 'R' THEN 'Conditional' ELSE 'Direct' END AS transform,
CASE WHEN l_returnflag = 'R' THEN 'CASE WHEN @Flag = R' END AS expression,
CASE WHEN l_returnflag = 'R' THEN '@Flag = R' WHEN l_returnflag = 'A' THEN 'ELSE' END AS condition, 1.0 - l_discount AS confidence FROM {{lineitem}}) l GROUP BY 1, 2, 3, 4, 5"""

# The same records for Spark: grouped by what the texts are made of, which is far smaller than the texts. An output with a null part is null.
LINEAGE_BY_KEY = f"""
SELECT output, source, transform, expression, condition, 'lineage:' || output || '<-' || coalesce(source, '?') || coalesce('[' || condition || ']', '') AS lineage_id, confidence FROM (
SELECT 'spcol:lineitem.' || CAST(k.l_orderkey AS STRING) || '.' || CAST(k.l_linenumber AS STRING) || '.' || CAST(k.l_partkey AS STRING) || '.' || CAST(k.l_suppkey AS STRING) AS output, 'column:part.' || CAST(part AS STRING) AS source, transform,
CASE WHEN condition = '@Flag = R' THEN 'CASE WHEN @Flag = R' END AS expression, condition, confidence FROM (
SELECT k, part, transform, condition, max(confidence) AS confidence FROM (
SELECT CASE WHEN {ROW_KEY} IS NOT NULL THEN struct(l_orderkey, l_linenumber, l_partkey, l_suppkey) END AS k, CASE WHEN l_tax = 0 THEN NULL ELSE l_partkey END AS part,
CASE WHEN l_tax = 0 AND l_linestatus = 'O' THEN 'Literal' WHEN l_returnflag = 'R' THEN 'Conditional' ELSE 'Direct' END AS transform,
CASE WHEN l_returnflag = 'R' THEN '@Flag = R' WHEN l_returnflag = 'A' THEN 'ELSE' END AS condition, 1.0 - l_discount AS confidence FROM {{lineitem}}) l GROUP BY 1, 2, 3, 4) g) r"""

# Runtime rows: each event is an observed value at a JSON node, in the user's scope; every seventh has no scope.
EVIDENCE = """
SELECT 'trace-' || CAST(CAST(ts AS DATE) AS STRING) AS trace_id, event_id, 'json:' || event_type || '.value' AS node_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'U' || CAST(user_id % 50 AS STRING) END AS scope,
CASE event_type WHEN 'click' THEN 'ApiResponse' WHEN 'view' THEN 'QueryResult' ELSE 'Parameter' END AS evidence_type, value, props FROM {events}"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql with each {table} read from sf_dir."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return spark.sql(text, **used)


def plain(sql: str) -> str:
    """sql over views of the tables' own names."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, EDGES)


def said_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as often as the tables say them: for what sorts out repeats itself, without dealing all lines to find them."""
    return frame(spark, sf_dir, EDGES.replace(LINE_KEYS, "{lineitem}"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, NODES)


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, LINEAGE_BY_KEY)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, EVIDENCE)


class Indexed:
    """The graph of sf_dir as sorted tables in the shared folder, each derived when it is first asked for and kept for as long as the files stay as they are."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def version(self) -> str:
        return version_of(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in TABLES if f"{{{t}}}" in EDGES + NODES])

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(self.spark, "nodes", self.version, lambda: nodes(self.spark, self.sf_dir), "id")

    @cached_property
    def down(self) -> Steps:
        return Steps(stored(self.spark, "down", self.version, self._down, "up", "edge_id", dealt=True))

    def _down(self) -> DataFrame:
        """The steps downstream, as often as the tables say them, as a search takes each node once. Bare ends are dealt, and what follows from them is said after that."""
        bare = said_edges(self.spark, self.sf_dir).select("src", "relation", "dst")
        dealt = bare.repartitionByRange(F.coalesce(ids.upstream(bare.src, bare.relation, bare.dst), bare.dst))
        return traverse.downstream_view(dealt.withColumn("edge_id", F.concat(F.lit("edge:"), "src", F.lit("|"), "relation", F.lit("|"), "dst")))

    @cached_property
    def out(self) -> Steps:
        return Steps(stored(self.spark, "out", self.version, lambda: traverse.out_view(edges(self.spark, self.sf_dir)), "up", "edge_id"))
