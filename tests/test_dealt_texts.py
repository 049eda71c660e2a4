"""Texts that lie in one small file are read by several tasks."""

from weft.sources import source_text


def test_methods_are_read_by_several_tasks(spark):
    files = spark.createDataFrame([(f"c{k}", f"public class S{k} {{ public int M{k}(int n) {{ return n; }} }}") for k in range(40)] + [("none", None)], "path string, text string").coalesce(1)
    methods = source_text.cs_methods(files)
    assert "REPARTITION_BY_NUM" in methods._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.method for r in methods.collect()) == sorted(f"M{k}" for k in range(40))
    assert source_text.cs_methods(files.limit(0)).count() == 0
