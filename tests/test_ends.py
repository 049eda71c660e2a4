"""Ends of merged edges are found without merging the edges."""

from weft.plans import assembly_queries


def test_ends_are_dealt_as_ids_alone(spark, sf_dir):
    df = assembly_queries.b7_merge(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "edge:" not in plan and "min(src" not in plan  # neither edge ids nor merged ends are made
    rows = {(r.prefix, r.status): r.n for r in df.collect()}
    assert rows["sp", "Unknown"] > 0 and rows["table", "Unknown"] > 0 and rows["spcol", "Known"] > 0
