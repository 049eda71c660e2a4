import pytest

from weft import api
from weft.sources import bench_graph as g

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def service(spark):
    return api.Service(g.nodes(spark, SF), g.edges(spark, SF), g.lineage(spark, SF), g.evidence(spark, SF))


def test_entry_points(service):
    assert service.health().first().nodes > 0
    assert service.search("nation.1", 3).count() == 3
    root = service.search("spcol", 1).first().id
    found = service.trace_field(root)
    assert found["hops"].count() == 2 and found["sets"].where("kind = 'node'").count() >= 4
    assert [r.hop for r in found["hops"].orderBy("hop").collect()] == [1, 2] and not found["truncated"].first().truncated
    said = service.explain(root).first()
    assert said.verdict in ("Known", "NeedMoreEvidence") and said.facts and said.steps[0].startswith(f"Took {root} (ResultColumn") and said.note == "explain"
    run = service.traces().first().trace_id
    open_ = service.investigate(root, trace_id=run.upper(), scope="U1", language="zh-CN")
    row = open_["explanation"].first()
    assert row.verdict == "NeedMoreEvidence" and row.confidence <= 0.9 and "没有" in row.unknowns[-1] and open_["values"].count() == 0
    assert set(row.cited) <= {i for f in row.facts for i in f.ids} and row.note == "investigate"
    told = service.impact_summary("param:supplier.1")
    assert told["explanation"].first().affected > 0 and told["facts"].count() >= 1
    assert service.graph("page:region.1", 1)["nodes"].count() > 1
    assert service.traces().count() > 0 and "read_system_parameter" in service.tools()


def test_errors(service):
    for call in (lambda: service.node("none:x"), lambda: service.impact("none:x"), lambda: service.trace_field("nothing"), lambda: service.trace("t")):
        with pytest.raises(api.NotFound):
            call()
    with pytest.raises(api.BadArgument):
        service.search(" ")
