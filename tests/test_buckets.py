"""What lies in buckets by request is not dealt again."""

import re

from pyspark.sql import functions as F

from weft.operators.shared import bucketed_at, buckets
from weft.plans import rule_queries


def exchanges(df):
    """The shuffles of df's plan, dealt rows or sorted ones alike."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan))


def test_a_table_in_buckets_is_joined_and_grouped_where_it_lies(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    table, _ = bucketed_at(rows.repartition(buckets(spark), "id"), "id")
    both = table.join(table.groupBy("id").agg(F.max("v").alias("m")).hint("merge"), "id")
    assert exchanges(both) == 0 and both.where("v = m").count() == 1000


def test_the_rule_engine_deals_no_hops(spark, sf_dir):
    """Lines are dealt before their hops are made, and the engine works where they lie."""
    assert exchanges(rule_queries.explained(spark, sf_dir).facts) == 0
    assert exchanges(rule_queries.guesses(spark, sf_dir)) == 0


def test_visible_nodes_count_no_degrees(spark):
    """Repeated edges and loops change nothing; a container goes if no drawn edge touches it, and only edges that are drawn are dealt by both ends."""
    from weft.operators import client

    edges = spark.createDataFrame([("a", "Contains", "b"), ("a", "Contains", "b"), ("c", "Contains", "d"), ("e", "Calls", "c"), ("f", "Contains", "f")], "src string, relation string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    shown = client.visible_nodes(nodes, edges, ["Contains"])
    assert sorted(r.id for r in shown.collect()) == ["b", "c", "d", "e", "g"]
    assert "count" not in shown._jdf.queryExecution().optimizedPlan().toString()


def test_no_wide_broadcast_from_packed_files(spark, tmp_path):
    """A packed table of a few hundred KB is tens of MB in the driver, so its size on disk lets no join broadcast it; a session's own lower or negative limit stays."""
    from weft.operators.shared import BROADCAST, dealt_by_size

    rows = spark.range(300_000).select("id", F.concat(F.lit("column:part.long.name."), (F.col("id") % 50_000).cast("string")).alias("node"))
    rows.coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / "t"))
    before = spark.conf.get(BROADCAST)
    try:
        for limit, left in (("10MB", str(256 << 10)), ("64k", "64k"), ("-1", "-1")):
            spark.conf.set(BROADCAST, limit)
            dealt_by_size(spark, [str(tmp_path)])
            assert spark.conf.get(BROADCAST) == left
        spark.conf.set(BROADCAST, "10MB")
        dealt_by_size(spark, [str(tmp_path)])
        table = spark.read.parquet(str(tmp_path / "t"))
        assert "Broadcast" not in table.join(table.withColumnRenamed("node", "other"), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(BROADCAST, before)
