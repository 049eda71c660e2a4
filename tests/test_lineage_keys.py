"""Records grouped by keys are those of the SQL, with repeated lines and null parts too; their shuffle holds keys, not texts."""

from pyspark.sql import functions as F

from weft.sources import bench_graph as g
from weft.sources import snapshots


def test_records_by_key(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    none = lines.limit(9).withColumn("l_orderkey", F.lit(None).cast(lines.schema["l_orderkey"].dataType))
    odd = lines.limit(40).withColumns({"l_discount": lines.l_discount / 2, "l_tax": lines.l_tax * 0}).union(lines.limit(40)).union(none)
    lines.union(odd).write.parquet(str(tmp_path / "lineitem.parquet"))
    made, told = g.lineage(spark, str(tmp_path)), g.frame(spark, str(tmp_path), g.LINEAGE)
    key = lambda r: tuple(map(str, r))
    rows = sorted(map(key, made.collect()))
    assert made.columns == told.columns and rows == sorted(map(key, told.collect()))
    assert any(r[0] == "None" for r in rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "spcol:lineitem." not in plan[plan.index("\n", plan.index("Aggregate")) :]  # no text is made below the grouping


def test_snapshots_leave_out_ids_that_follow(spark, tmp_path):
    """Ids of one's own, null ones and those of the row come back; only the last are not stored."""
    nodes = spark.createDataFrame([("n",)], "id string")
    edges = spark.createDataFrame([("edge:a|Calls|b", "a", "Calls", "b"), ("own", "a", "Calls", "c"), (None, "a", "Calls", "d"), (None, None, "Calls", "d")], "edge_id string, src string, relation string, dst string")
    records = spark.createDataFrame([("lineage:o<-?", "o", None, None), ("x", "o", "s", "c")], "lineage_id string, output string, source string, condition string")
    snapshots.write_tables(str(tmp_path), nodes, edges, records)
    _, e, r = snapshots.read_tables(spark, str(tmp_path))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(e) == key(edges) and key(r) == key(records) and e.columns == edges.columns
    assert spark.read.parquet(f"{tmp_path}/edges").where("edge_id is null").count() == 2
