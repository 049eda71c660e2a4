"""A scan of SQL texts reads each text once, in several tasks."""

from weft.sources import source_text as s

TEXT = "CREATE PROCEDURE [dbo].[P{0}] (@A int) AS WITH c AS (SELECT 1 FROM dbo.In) INSERT INTO dbo.Log SELECT dbo.F(x) FROM [dbo].[T] JOIN c ON 1 = 1 JOIN u /* FROM dbo.Not */ WHERE n = 'FROM dbo.Quoted' EXEC inv.Next @A = dbo.AF_GetSystemParameterValue('W')"


def test_texts_are_read_once_by_several_tasks(spark):
    files = spark.createDataFrame([(f"p{n}", TEXT.format(n)) for n in range(200)] + [("none", None), ("empty", "")], "path string, text string").coalesce(1)
    objects = s.sql_objects(files)
    edges = s.sql_edges(objects)
    got = {(r.relation, r.dst) for r in edges.where("src = 'sp:dbo.P7'").collect()}
    assert got == {("Reads", "table:dbo.In"), ("Reads", "table:dbo.T"), ("Reads", "table:dbo.u"), ("CallsFunction", "udf:dbo.F"), ("CallsFunction", "udf:dbo.AF_GetSystemParameterValue"), ("ExecutesSp", "sp:inv.Next"), ("UsesParameter", "param:W")}
    assert edges.count() == 200 * len(got)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("regexp_extract_all(") <= 6  # one search for each kind of fact
    assert len([n for n in objects.rdd.glom().map(len).collect() if n]) > 1
