"""Stored tables by version, and searches over an index against searches over a view."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weft.operators import index, traverse
from weft.sources import bench_graph

EDGE = "src string, relation string, dst string, edge_id string"


def random_edges(spark, seed, n=30, m=90):
    rng = random.Random(seed)
    pairs = {(f"n:{rng.randrange(n)}", rng.choice(["Calls", "HandledBy", "ExecutesSp", "MapsTo", "Contains"]), f"n:{rng.randrange(n)}") for _ in range(m)} | {("n:0", "Calls", "n:1")}
    return spark.createDataFrame([(a, r, b, f"e:{a}|{r}|{b}") for a, r, b in sorted(pairs)], EDGE)


@pytest.mark.parametrize("few", [0, 500])
def test_an_index_finds_what_a_view_finds(spark, few, monkeypatch):
    """few 0: every level joins the whole table; 500: every level is a filter."""
    monkeypatch.setattr(index, "FILTER_ROWS", few)
    edges = random_edges(spark, 3)
    start = spark.createDataFrame([("n:0",)], "node string")
    plain, _ = traverse.breadth_first(traverse.downstream_view(edges), start, carry=("reason",))
    found, _ = traverse.breadth_first(index.Steps.of(traverse.downstream_view(edges)), start, carry=("reason",))
    assert sorted(found.collect()) == sorted(plain.collect()) and plain.count() > 5
    out = index.Steps.of(traverse.out_view(edges))
    assert sorted(traverse.shortest_paths(None, "n:0", out).collect()) == sorted(traverse.shortest_paths(edges, "n:0").collect())
    for a, b in zip(traverse.architecture(None, "n:0", out), traverse.architecture(edges, "n:0"), strict=True):
        assert sorted(a.collect()) == sorted(b.collect())


def test_without_ways_nodes_and_distances_are_the_same(spark):
    steps = traverse.out_view(random_edges(spark, 5))
    start = spark.createDataFrame([("n:0",), ("n:7",)], "node string")
    ways, _ = traverse.breadth_first(steps, start)
    bare, cut = traverse.breadth_first(steps, start, ways=False)
    assert "path" not in bare.columns and not cut
    assert sorted(bare.select("node", "distance").collect()) == sorted(ways.select("node", "distance").collect())
    with pytest.raises(ValueError):
        traverse.breadth_first(steps, start, cap=3, ways=False)


def test_a_chain_longer_than_plans_may_grow(spark):
    chain = spark.range(40).select(F.concat(F.lit("n:"), "id").alias("src"), F.lit("Calls").alias("relation"), F.concat(F.lit("n:"), F.col("id") + 1).alias("dst"), F.concat(F.lit("e:"), "id").alias("edge_id"))
    nodes, edges = traverse.architecture(chain, "n:0")
    assert nodes.count() == 41 and edges.count() == 40 and nodes.agg(F.max("distance")).first()[0] == 40


def test_stored_tables_follow_their_files(spark, tmp_path):
    where = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(where)
    version, made = index.version_of(spark, [where]), []

    def make():
        made.append(1)
        return spark.read.parquet(where).withColumn("up", F.col("id").cast("string"))

    name = f"test{random.randrange(10**9)}"
    assert index.stored(spark, name, version, make, "up").count() == 3
    assert index.stored(spark, name, version, make, "up").count() == 3 and len(made) == 1
    assert index.version_of(spark, [where]) == version
    time.sleep(1.1)
    spark.range(4).write.mode("append").parquet(where)
    changed = index.version_of(spark, [where])
    assert changed != version and index.stored(spark, name, changed, make, "up").count() == 7 and len(made) == 2


def test_a_filter_reaches_the_scan(spark, sf_dir):
    at = bench_graph.Indexed(spark, sf_dir)
    plan = at.down.near(spark.createDataFrame([("column:part.1",), ("column:part.2",)], "node string"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(up, [column:part.1,column:part.2])]" in plan.replace(", column", ",column")


def test_the_index_deals_bare_ends(spark, sf_dir):
    """No id or reason moves: the steps are those of the whole view, and the shuffle's rows have the three columns that say an edge."""
    made = bench_graph.Indexed(spark, sf_dir)._down()
    told = traverse.downstream_view(bench_graph.edges(spark, sf_dir))
    assert sorted(made.distinct().collect()) == sorted(told.select(made.columns).collect())
    dealt = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) == 1 and "edge:" not in made._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
