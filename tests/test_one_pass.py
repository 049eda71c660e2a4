"""The rule engine deals its hops once, and shuffles begin with as many partitions as the input is large."""

from weft.operators import shared
from weft.plans import rule_queries
from weft.sources import bench_graph


def test_hop_rows_are_those_of_the_sql(spark, sf_dir):
    made, told = rule_queries.hop_rows(spark, sf_dir), bench_graph.frame(spark, sf_dir, rule_queries.HOPS)
    key = lambda r: tuple(map(str, r))
    assert made.columns == told.columns and sorted(map(key, made.collect())) == sorted(map(key, told.collect()))


def test_facts_deal_hops_once(spark, sf_dir):
    """An exchange each for hops, allowed ids, heads, path, siblings, at most two of a kind."""
    plan = rule_queries.explained(spark, sf_dir).facts._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Exchange") <= 2 and plan.count("Window") == 1
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin") <= 4


def test_shuffles_begin_with_a_partition_for_each_part(spark, tmp_path):
    where = str(tmp_path / "t.parquet")
    spark.range(20_000).write.parquet(where)
    try:
        shared.dealt_by_size(spark, [where], part_bytes=1 << 10)
        many = int(spark.conf.get(shared.INITIAL))
        assert many > 20
        shared.dealt_by_size(spark, [where, str(tmp_path)])
        assert spark.conf.get(shared.INITIAL, None) is None  # a small input keeps the session's own number
    finally:
        spark.conf.unset(shared.INITIAL)
