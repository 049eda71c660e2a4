"""Steps of a whole graph with their records, and searches that carry no ways."""

from pyspark.sql import functions as F

from weft.operators import trace, traverse
from weft.plans import graph_queries
from weft.sources import bench_graph as g


def test_whole_steps_say_what_hops_say(spark, sf_dir):
    edges, lineage = g.edges(spark, sf_dir), g.lineage(spark, sf_dir)
    hops = edges.where(F.col("relation").isin(traverse.LINEAGE_RELATIONS)).select(F.col("edge_id").alias("hop"), F.col("src").alias("parent"), F.col("dst").alias("node_id"), "edge_id", "relation", F.lit(1).alias("depth"), F.lit(False).alias("is_repeat"))
    pick = ["parent", "node_id", "edge_id", "transform", "expression", "condition", "confidence", "lineage_ids"]
    key = lambda r: tuple(map(str, r))
    whole = sorted(map(key, trace.steps_with_lineage(edges, lineage).select(pick).collect()))
    assert whole == sorted(map(key, trace.with_lineage(hops, edges, lineage).select(pick).collect())) and len(whole) > 10_000


def test_hop_lineage_writes_nothing_and_joins_once(spark, sf_dir):
    plan = graph_queries.c15_hop_lineage(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "weft-" not in plan and plan.count("Join LeftOuter") == 1 and "Join LeftSemi" not in plan


def test_impact_without_ways(spark):
    edges = spark.createDataFrame([(f"n:{k}", "Calls", f"n:{k + 1}", f"e:{k}") for k in range(5)] + [("n:0", "Calls", "n:2", "e:x")], "src string, relation string, dst string, edge_id string")
    nodes = spark.createDataFrame([("n:1", "Method", "one", "Service")], "id string, type string, name string, layer string")
    ways, bare = traverse.impact(edges, nodes, "n:5"), traverse.impact(edges, nodes, "n:5", cap=None, ways=False)
    pick = ["node_id", "distance", "type", "name", "layer"]
    assert "path" not in bare.columns and sorted(map(str, bare.select(pick).collect())) == sorted(map(str, ways.select(pick).collect()))
