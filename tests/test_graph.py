"""Traversals and traces against small loops in Python, on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import trace, traverse
from weft.schema import RELATIONS

EDGE = "src string, relation string, dst string, edge_id string, confidence double"
NODE = "id string, type string, name string, layer string, status string"


def graph(spark, pairs, statuses=None, types=None):
    edges = [(a, r, b, f"edge:{a}|{r}|{b}", 1.0) for a, r, b in sorted(set(pairs))]
    ids = sorted({x for a, _, b in pairs for x in (a, b)})
    nodes = [(i, (types or {}).get(i, "Method"), i, "Service", (statuses or {}).get(i, "Known")) for i in ids]
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), edges


def steps_down(edges):
    flows = {r[0]: r[1] for r in RELATIONS}
    out = {}
    for a, r, b, e, _ in sorted(edges, key=lambda x: x[3]):
        up, down = (a, b) if flows[r] == "FlowsTo" else (b, a)
        out.setdefault(up, []).append((e, down))
    return out


def queue_search(steps, start, max_depth, cap):
    seen, order, path, cut, k = {start: 0}, [start], {start: [start]}, False, 0
    while k < len(order):
        at = order[k]
        k += 1
        if seen[at] >= max_depth:
            cut = True
            continue
        for _, to in steps.get(at, []):
            if to not in seen:
                if cap and len(seen) > cap:
                    cut = True
                    break
                seen[to], path[to] = seen[at] + 1, path[at] + [to]
                order.append(to)
    return seen, path, cut


@pytest.mark.parametrize("seed", range(4))
def test_impact_against_a_queue(spark, seed):
    rng = random.Random(seed)
    kinds = ["Calls", "MapsTo", "Contains", "DerivedFrom", "OfType"]
    pairs = [(f"n:{rng.randrange(12)}", rng.choice(kinds), f"n:{rng.randrange(12)}") for _ in range(22)]
    edges, nodes, rows = graph(spark, pairs + [("n:0", "Calls", "n:1")])
    seen, path, _ = queue_search(steps_down(rows), "n:1", 16, 500)
    got = {r.node_id: (r.distance, r.path) for r in traverse.impact(edges, nodes, "n:1").collect()}
    assert got == {n: (d, path[n]) for n, d in seen.items() if d}


def test_impact_cap_and_depth(spark):
    pairs = [(f"n:{k:02}", "Calls", "n:root") for k in range(9)] + [("n:far", "Calls", "n:00")]
    edges, nodes, _ = graph(spark, pairs)
    assert [r.node_id for r in traverse.impact(edges, nodes, "n:root", cap=4).collect()] == ["n:00", "n:01", "n:02", "n:03"]
    assert {r.node_id for r in traverse.impact(edges, nodes, "n:root", max_depth=1).collect()} == {f"n:{k:02}" for k in range(9)}
    summary = {r.type: r.n for r in traverse.impact_summary(traverse.impact(edges, nodes, "n:root")).collect()}
    assert summary == {"Method": 10}


def test_subgraph_leaves_out_edges_at_the_rim(spark):
    edges, nodes, _ = graph(spark, [("a", "Calls", "b"), ("c", "Calls", "a"), ("b", "Calls", "c"), ("b", "Calls", "d"), ("a", "Contains", "spcol:x")])
    found, kept, cut = traverse.subgraph(edges, nodes, "a", 1)
    assert {r.node_id for r in found.collect()} == {"a", "b", "c", "spcol:x"} and not cut
    assert {(r.src, r.dst) for r in kept.collect()} == {("a", "b"), ("c", "a"), ("a", "spcol:x")}
    assert {r.node_id for r in traverse.subgraph(edges, nodes, "a", 1, columns=False)[0].collect()} == {"a", "b", "c"}
    assert [r.node_id for r in traverse.subgraph(edges, nodes, "a", 0)[0].collect()] == ["a"]


@pytest.mark.parametrize("seed", range(2))
def test_subgraph_reads_edges_where_they_are(spark, seed, monkeypatch):
    """Without a cap and with repeated edges the rows are those of a plain search, and of the edges nothing is written."""
    rng = random.Random(seed)
    pairs = list({("n:1", "Calls", "n:2"), ("n:3", "Calls", "n:1"), *((f"n:{rng.randrange(40)}", "Calls", f"n:{rng.randrange(40)}") for _ in range(60))})
    edges, nodes, _ = graph(spark, pairs)
    written = []
    real = traverse.kept_at
    monkeypatch.setattr(traverse, "kept_at", lambda df, *by: written.append(df.columns) or real(df, *by))
    found, kept, cut = traverse.subgraph(edges.union(edges), nodes, "n:1", 2, cap=None)
    distance = {"n:1": 0}
    for d in (1, 2):
        for x in [x for x, at in distance.items() if at == d - 1]:
            for a, _, b in pairs:
                for u, v in ((a, b), (b, a)):
                    if u == x:
                        distance.setdefault(v, d)
    assert {r.node_id: r.distance for r in found.collect()} == distance
    want = sorted((a, b, distance[a], distance[b]) for a, _, b in pairs if a in distance and b in distance and min(distance[a], distance[b]) < 2)
    assert sorted((r.src, r.dst, r.d_src, r.d_dst) for r in kept.collect()) == want
    assert not any("up" in columns for columns in written)
    assert len(traverse.subgraph(edges, nodes, "n:1", 2, cap=3)[0].collect()) == 3


def walk(rows, known, root, depth=24):
    """The depth-first walk: each node expanded once, ancestors skipped, in edge order."""
    lineage = set(traverse.LINEAGE_RELATIONS)
    flows = {r[0]: r[1] for r in RELATIONS}
    steps = {}
    for a, r, b, e, _ in rows:
        if r in lineage:
            up = b if flows[r] == "DependsOn" else a
            node = a if up == b else b
            steps.setdefault(node, []).append((("0|" if node == a else "1|") + e, up, e))
    out, done = [], set()

    def go(node, path):
        if node in done or node not in known or len(path) > depth:
            return
        done.add(node)
        for _, up, e in sorted(steps.get(node, [])):
            if up not in path:
                out.append((node, up, e, up in done and bool(steps.get(up)) and up in known))
                go(up, path + [up])

    go(root, [root])
    return [(a, b, e) for a, b, e, _ in out]


@pytest.mark.parametrize("seed", range(4))
def test_trace_against_a_walk(spark, seed):
    rng = random.Random(100 + seed)
    kinds = ["AliasOf", "DerivedFrom", "MapsTo", "ControlledBy"]
    pairs = [("expr:0", "DerivedFrom", "expr:1")] + [(f"expr:{rng.randrange(8)}", rng.choice(kinds), f"expr:{rng.randrange(8)}") for _ in range(12)]
    statuses = {"expr:5": "Unknown", "expr:6": "Pending"}
    edges, nodes, rows = graph(spark, [p for p in pairs if p[0] != p[2]], statuses, {f"expr:{k}": "Expression" for k in range(8)})
    known = {f"expr:{k}" for k in range(8)} - set(statuses)
    got = [(r.parent, r.node_id, r.edge_id) for r in trace.hops(edges, nodes, "expr:0").orderBy("hop").collect()]
    assert got == walk(rows, known, "expr:0")


def test_trace_falls_back_to_the_model(spark):
    pairs = [("model:M", "Contains", "field:M.a"), ("sp:dbo.P", "MapsTo", "model:M"), ("field:O.m", "OfType", "model:M"), ("field:O.m", "EnrichedBy", "method:X")]
    edges, nodes, _ = graph(spark, pairs, types={"field:M.a": "Field", "field:O.m": "Field", "model:M": "Model"})
    got = [(r.node_id, r.relation) for r in trace.hops(edges, nodes, "field:M.a").orderBy("hop").collect()]
    assert got == [("method:X", "EnrichedBy"), ("sp:dbo.P", "MapsTo")]


def test_hops_show_condition_and_budget(spark):
    edges, nodes, rows = graph(spark, [("spcol:a", "AliasOf", "column:b"), ("spcol:a", "ControlledBy", "param:c")])
    lineage = spark.createDataFrame([("spcol:a", "column:b", "l2", "Direct", "x", "@A = 1", 0.5), ("spcol:a", "column:b", "l1", "Conditional", "y", None, 0.7)], "output string, source string, lineage_id string, transform string, expression string, condition string, confidence double")
    out = {r.node_id: r for r in trace.with_lineage(trace.hops(edges, nodes, "spcol:a"), edges, lineage).collect()}
    assert (out["column:b"].transform, out["column:b"].confidence, out["column:b"].lineage_ids) == ("Conditional", 0.7, ["l1", "l2"])
    assert out["param:c"].transform == "Conditional" and out["param:c"].confidence == 1.0
    assert trace.hops(edges, nodes, "spcol:a", budget=1).count() == 1


def test_resolve(spark):
    ids = [("json:rows.qty", "JsonField"), ("field:A.qty", "Field"), ("field:A.zone", "Field"), ("field:B.Zone", "Field"), ("column:dbo.T.only", "Column")]
    nodes = spark.createDataFrame([(i, t, i, "Api", "Known") for i, t in ids], NODE)
    assert trace.resolve(nodes, "QTY") == "json:rows.qty" and trace.resolve(nodes, " rows.qty ") == "json:rows.qty" and trace.resolve(nodes, "only") == "column:dbo.T.only"
    with pytest.raises(trace.AmbiguousField) as e:
        trace.resolve(nodes, "zone")
    assert e.value.candidates == ["field:A.zone", "field:B.Zone"]
    for text in ("", "nothing"):
        with pytest.raises(trace.FieldNotFound):
            trace.resolve(nodes, text)


def test_paths_details_search(spark):
    edges, nodes, _ = graph(spark, [("page:p", "Calls", "api:a"), ("page:p", "Calls", "api:b"), ("api:a", "HandledBy", "method:m"), ("api:b", "HandledBy", "method:m"), ("api:a", "Contains", "json:x")])
    paths = {r.target: r.path for r in traverse.shortest_paths(edges, "page:p").collect()}
    assert paths["method:m"] == ["page:p", "api:a", "method:m"]
    targets = spark.createDataFrame([("method:m", 1), ("api:b", 2)], "target string, seq int")
    assert [r.node_id for r in traverse.execution_path(edges, "page:p", targets).orderBy("step").collect()] == ["page:p", "api:a", "method:m", "api:b"]
    assert trace.entry_point(edges, nodes, "json:x") == "page:p"
    empty = spark.createDataFrame([], "output string, source string, lineage_id string")
    d = traverse.node_details(edges, nodes, empty, "api:a").first()
    assert (d.n_in, d.n_out, d.n_neighbours, d.container, d.n_evidence) == (1, 2, 3, None, 3)
    assert [r.id for r in traverse.search(nodes, "API").collect()] == ["api:a", "api:b"]
    assert {r.node_id for r in traverse.architecture(edges, "page:p")[0].collect()} == {"page:p", "api:a", "api:b", "method:m"}
    assert traverse.missing_edges(edges, edges.where(F.col("src") == "page:p"), ["api"], ["HandledBy"]).count() == 2
