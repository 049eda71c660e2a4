"""Evidence of captures: built within its trace, in order, and never dealt row by row."""

import json

import pytest
from pyspark.sql import functions as F

from weft.operators import runtime
from weft.plans import runtime_queries

RESULT = "struct<durationMs:int,rowKey:string,returnColumn:string,rows:array<map<string,string>>>"
SCHEMA = f"trace_id string, fixture_id string, entity_key string, environment string, systemParameters map<string,string>, procedureResults map<string,{RESULT}>, functionResults map<string,{RESULT}>, response string"


@pytest.fixture(scope="module")
def captured(spark):
    lines = [{"k": f"P{n % 3}", "z": None} for n in range(5)] + [None, {}]
    rows = [
        ("t", "f1", "O1", "fixture", {"b": "2", "a": "1"}, {"dbo.Z": (7, "k", None, lines), "dbo.A": (None, None, None, [{"q": "1"}])}, {"f": (3, "k", " r ", [{"r": "5", "k": "o1"}, {"x": "0"}, {"r": "6", "k": "p2"}])},
         '{"rows": [{"materialNumber": "p0", "x": [1, 1.50]}], "token": 1, "": {"é": "\\ud800"}, "e": [], "n": null}'),
        ("t", "f0", "O9", "PROD", {"a": "9"}, {}, None, '{"rows": [true]}'),
        ("none", "f2", "O2", "Test", None, None, None, "no json"),
        ("u", "f3", "O3", "Test", {"a": "3"}, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_evidence_in_order(captured):
    got = [(r.section, r.node_id, r.evidence_type, r.value, r.scope, r.label) for r in runtime.bind(captured, limit=6).where("trace_id = 't'").orderBy("id").collect()]
    cells = [(1, f"spcol:dbo.Z.{c}", "QueryResult", v, f"P{n % 3}", f"P{n % 3}.{c}") for n in range(5) for c, v in (("k", f"P{n % 3}"), ("z", None))]
    assert got == [
        (0, "param:a", "Parameter", "1", None, "a"), (0, "param:a", "Parameter", "9", None, "a"), (0, "param:b", "Parameter", "2", None, "b"), (1, "spcol:dbo.A.q", "QueryResult", "1", None, "q"), (1, "sp:dbo.Z", "Timing", "7", None, "dbo.Z 7 ms"), *cells,
        (2, "udf:f", "Timing", "3", None, "f 3 ms"), (2, "udf:f", "QueryResult", "5", None, "f"), (2, "udf:f", "QueryResult", "6", "p2", "p2.f"),
        (3, "json:rows", "ApiResponse", "true", None, "rows"), (3, "json:rows.materialNumber", "ApiResponse", '"p0"', "p0", "p0.rows.materialNumber"), (3, "json:rows.x", "ApiResponse", "1", "p0", "p0.rows.x"), (3, "json:rows.x", "ApiResponse", "1.50", "p0", "p0.rows.x"),
        (3, "json:é", "ApiResponse", '"?"', None, "é"), (3, "json:n", "ApiResponse", "null", None, "n"),
    ]
    assert {(r.trace_id, r.id) for r in runtime.bind(captured).where("trace_id <> 't'").collect()} == {("u", "ev-001")}


def test_ids_beyond_three_digits(captured):
    many = captured.where("trace_id = 'u'").withColumn("response", F.lit(json.dumps({f"k{n}": n for n in range(1200)})))
    ids = {int(r.label[1:]): r.id for r in runtime.bind(many).where("section = 3").collect()}
    assert ids[0] == "ev-002" and ids[97] == "ev-099" and ids[998] == "ev-1000" and ids[1199] == "ev-1201"


def test_results_of_tools(captured):
    got = {(r.tool, r.key): json.loads(r.result) for r in runtime.tool_results(captured, limit=4).where("tool <> 'read_pick_order_response'").collect()}
    assert got["trace_pick_order", "O1"]["unknowns"] == ["3 rows beyond the limit of 4 were not captured: dbo.Z"] and got["trace_pick_order", "O1"] | {"entityKey": "O9", "environment": "PROD"} == got["trace_pick_order", "O9"]
    total = runtime.bind(captured, limit=4).where("trace_id = 't'")
    assert got["trace_pick_order", "O1"]["evidenceCount"] == total.count()
    free = total.where("scope is null").count()
    assert {k[1]: v["evidenceCount"] - free for k, v in got.items() if k[0] == "trace_material" and k[1].startswith("O1/")} == {"O1/P0": 7, "O1/P1": 2, "O1/P2": 3}
    assert got["trace_pick_order", "O3"]["evidenceCount"] == 1 and got["read_system_parameter", "a"] == {"id": "ev-001", "nodeId": "param:a", "value": "1", "environment": "fixture"}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Window"), plan.count("ArrowEvalPython")


def test_evidence_is_dealt_by_its_captures_alone(captured, spark, sf_dir):
    assert exchanges(runtime.bind(captured)) == (1, 0, 1)
    of_sections = exchanges(runtime_queries.d1_bind(spark, sf_dir))
    assert of_sections[0] <= 3 and of_sections[1:] == (0, 1)  # lines by order, captures by trace; sections stay where they are
    plan = runtime.bind(captured)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".procedureResults), true)") == 1  # the arrays are built once, not once more to filter by their size
