"""What a task holds and how often a row is read do not grow with the input."""

from pyspark.sql import functions as F

from weft.operators import shared
from weft.sources import snapshots


def test_documents_are_cleaned_once(spark):
    said = ['{"a": "x // y, ]"} // z', '{"a": "1", }', '{"a": "b"}', '{"a": "\\\\", /* no */ ', None]
    docs = spark.createDataFrame([(str(k), s) for k, s in enumerate(said)], "path string, json string")
    got = {r.path: r.c for r in docs.select("path", snapshots.cleaned(F.col("json")).alias("c")).collect()}
    assert [got[str(k)] for k in range(3)] == ['{"a": "x // y, ]"} ', '{"a": "1" }', '{"a": "b"}'] and got["4"] is None
    read = snapshots.parsed(docs.where("path < 3"), "struct<a:string>")
    assert sorted(r.doc.a for r in read.collect()) == ["1", "b", "x // y, ]"]
    assert read.select("path", "doc.*")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4  # two patterns, one of them inside the other's test


def test_large_input_is_read_and_dealt_in_parts(spark, tmp_path):
    """A task's share has a size of its own, however few cores there are."""
    where = str(tmp_path / "t.parquet")
    spark.range(400_000).coalesce(1).write.option("parquet.block.size", 100_000).parquet(where)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        few = spark.read.parquet(where).rdd.getNumPartitions()
        shared.dealt_by_size(spark, [where], part_bytes=1 << 15)
        assert spark.read.parquet(where).rdd.getNumPartitions() > 4 * few
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8MB"
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
        for c in (shared.INITIAL, shared.ADVISORY, shared.SPLIT):
            spark.conf.unset(c)
