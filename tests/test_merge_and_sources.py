"""Folds against a dict merge, linking, snapshots, runtime rows and explanation rules."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import client, explain, merge, relational, runtime
from weft.schema import NODE
from weft.sources import bench_graph, snapshots, source_text

SEQ = NODE + ", ord int, seq long, policy string"


def node(i, ord_, seq, status, policy, name, description=None, source=None, version=None, **meta):
    return (i, f"T{ord_}", name, None, "Data", status, source, meta or None, description, version, ord_, seq, policy)


def dict_merge(old, new):
    """The store's decision table, row by row."""
    strict = new["policy"] == "Authoritative"
    pick = lambda a, b: a if a is not None else b
    meta = lambda lose, win: {**(lose or {}), **(win or {})}
    rank = {"Unknown": 0, "Pending": 1, "Known": 2}
    if old["status"] == "Unknown" and new["status"] != "Unknown":
        d = pick(new["description"], old["description"]) if strict else pick(old["description"], new["description"])
        return {**new, "description": d, "metadata": meta(old["metadata"], new["metadata"])}
    defined = old["status"] != "Known" and new["status"] == "Known"
    version = pick(new["scanVersion"], old["scanVersion"]) if defined or old["scanVersion"] is None else old["scanVersion"]
    if strict:
        return {**old, "name": new["name"], "status": new["status"], "source": pick(old["source"], new["source"]), "metadata": meta(old["metadata"], new["metadata"]), "description": pick(new["description"], old["description"]), "scanVersion": version}
    own = meta(old["metadata"], new["metadata"]) if defined else meta(new["metadata"], old["metadata"])
    return {**old, "status": max(old["status"], new["status"], key=rank.get), "source": pick(old["source"], new["source"]), "metadata": own, "description": pick(old["description"], new["description"]), "scanVersion": version}


@pytest.mark.parametrize("seed", range(3))
def test_fold_against_dicts(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        maybe = lambda x: x if rng.random() < 0.5 else None
        rows.append(node(f"n{rng.randrange(6)}", rng.randrange(3), k, rng.choice(["Unknown", "Pending", "Known"]), rng.choice(["FillGaps", "Authoritative"]), f"name{k}", maybe(f"d{k}"), maybe((f"p{k}", 1, 2)), maybe(f"v{k}"), **{rng.choice("abc"): str(k)}))
    names = [x.split()[0] for x in SEQ.split(", ")]
    want = {}
    for r in sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda r: (r["ord"], r["seq"])):
        want[r["id"]] = dict_merge(want[r["id"]], r) if r["id"] in want else r
    got = {r.id: r for r in merge.merge_nodes(spark.createDataFrame(rows, SEQ)).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r.name, r.status, r.description, r.scanVersion, r.metadata, r.source and tuple(r.source)) == (w["name"], w["status"], w["description"], w["scanVersion"], w["metadata"], w["source"])


def test_define_never_downgrades(spark):
    rows = [node("a", 0, 0, "Known", "", "first", "text", x="1"), node("a", 0, 1, "Unknown", "", "second", y="2"), node("b", 0, 0, "Unknown", "", "first", "old", reason="r"), node("b", 0, 1, "Known", "", "second", x="1")]
    got = {r.id: r for r in merge.define_nodes(spark.createDataFrame(rows, SEQ)).collect()}
    assert (got["a"].name, got["a"].metadata) == ("first", {"x": "1"})
    assert (got["b"].name, got["b"].description, got["b"].metadata) == ("second", "old", {"reason": "r", "x": "1"})


def test_edge_rules_differ(spark):
    rows = spark.createDataFrame([("e", "a", "Calls", "b", 0.5, "X", "r1", {"k": "1"}, 0, 0), ("e", "a", "Calls", "b", 0.9, "Y", "r2", {"k": "2"}, 0, 1), ("e", "a", "Calls", "b", 0.9, "Z", "r0", {"k": "3"}, 1, 0)], "edge_id string, src string, relation string, dst string, confidence double, evidenceType string, evidenceRef string, metadata map<string,string>, ord int, seq int")
    store = merge.merge_edges(rows).first()
    assert (store.confidence, store.evidenceType, store.evidenceRef, store.refs) == (0.9, "Y", "r2", "r0;r1;r2")
    own = merge.link_edges(rows.where("ord = 0")).first()
    assert (own.evidenceType, own.metadata, own.refs) == ("Y", {"k": "2"}, "r1;r2")


def test_snapshot_documents(spark):
    good = '{"schemaVersion": "1.0", // note\n "nodes": [{"id": "sp:dbo.P", "type": "storedProcedure", "status": "known", "name": "http://x",},], "edges": [{"from": "a", "to": "b", "relationType": "executesSp"}], "lineages": [{"outputFieldId": "o", "transformType": "literal", "condition": "c"}]}'
    docs = spark.createDataFrame([("g", good)], "path string, json string")
    nodes, edges, lineage = (df.first() for df in snapshots.snapshot_parts(docs))
    assert (nodes.type, nodes.status, nodes.name) == ("StoredProcedure", "Known", "http://x")
    assert (edges.edge_id, edges.confidence, lineage.lineage_id) == ("edge:a|ExecutesSp|b", 1.0, "lineage:o<-?[c]")
    twice = '{"schemaVersion": "2.0", "nodes": [{"id": "a"}, {"id": "a"}]}'
    assert {r.fault for r in snapshots.faults(spark.createDataFrame([("t", twice)], "path string, json string")).collect()} == {"schema version 2.0", "duplicate node id a"}
    for bad in ("null", "{broken", ""):
        with pytest.raises(Exception, match="no document in"):
            snapshots.parsed(spark.createDataFrame([("x", bad)], "path string, json string"), snapshots.CASE).collect()
    with pytest.raises(Exception, match="blank setting"):
        snapshots.settings(spark.createDataFrame([("x", '{"values": {"A.B": {"value": " "}}}')], "path string, json string")).collect()


def test_tables_round_trip(spark, tmp_path):
    g = [f(spark, "/root/testdata/sf0.001") for f in (bench_graph.nodes, bench_graph.edges, bench_graph.lineage)]
    snapshots.write_tables(str(tmp_path / "s"), *g)
    back = snapshots.read_tables(spark, str(tmp_path / "s"))
    assert [df.count() for df in back] == [df.count() for df in g]
    files = {r.path.rsplit("/", 1)[1] for r in snapshots.list_files(spark, str(tmp_path), "*.json").collect()}
    assert files and all(f.endswith(".json") for f in files)


def test_json_leaves_in_document_order(spark):
    doc = '{"z": "1", "rows": [{"bin": {"q": 2.5, "none": []}, "materialNumber": "M1", "password": "x"}, {"materialNumber": 7, "note": null}], "a": true, "s": "[1]"}'
    df = spark.createDataFrame([(1, doc), (2, "5"), (3, None), (4, "[]")], "k int, j string")
    got = [(r.path, r.scope, r.value) for r in runtime.json_leaves(df, "j").orderBy("k", "ord").collect()]
    assert got == [("z", None, '"1"'), ("rows.bin.q", "M1", "2.5"), ("rows.materialNumber", "M1", '"M1"'), ("rows.materialNumber", None, "7"), ("rows.note", None, "null"), ("a", None, "true"), ("s", None, '"[1]"')]


def test_json_leaves_at_any_depth(spark):
    bins = '[{"order": {"pickOrderRows": [{"materialNumber": "M1", "destinationWagon": [{"wagon": 1, "storageBin": [{"bin": "B1", "level": {"deep": [[{"end": true}], 7]}}, "B2"]}]}]}}]'
    df = spark.createDataFrame([(1, bins), (2, '{"a": 1}'), (3, '[[[[[[[[[["x"]]]]]]]]]]')], "k int, j string")
    got = [(r.k, r.path, r.scope, r.value) for r in runtime.json_leaves(df, "j").orderBy("k", "ord").collect()]
    at = "order.pickOrderRows.destinationWagon."
    assert got == [
        (1, "order.pickOrderRows.materialNumber", "M1", '"M1"'), (1, f"{at}wagon", "M1", "1"), (1, f"{at}storageBin.bin", "M1", '"B1"'), (1, f"{at}storageBin.level.deep.end", "M1", "true"),
        (1, f"{at}storageBin.level.deep", "M1", "7"), (1, f"{at}storageBin", "M1", '"B2"'), (2, "a", None, "1"), (3, "", None, '"x"'),
    ]


def test_bundle_validation_and_client(spark):
    items = spark.createDataFrame([(1, "Runtime", "r", 0, "x"), (1, "Node", "n2", 1, "x"), (1, "Node", "n1", 2, "x"), (1, "Edge", "n1", 3, "y")], "request_id int, kind string, id string, ord int, text string")
    assert [(r.id, r.kind) for r in explain.bundle(items, 2).orderBy("place").collect()] == [("n1", "Node"), ("n2", "Node")]
    facts = spark.createDataFrame([(1, 1, ["b", "a", "b"]), (1, 2, ["x"]), (1, 3, [])], "request_id int, seq int, ids array<string>")
    kept, gone = explain.validate(facts, spark.createDataFrame([(1, "a"), (1, "b")], "request_id int, id string"))
    assert [(r.seq, r.ids) for r in kept.collect()] == [(1, ["b", "a"])] and sorted(r.seq for r in gone.collect()) == [2, 3]
    notes = spark.createDataFrame([(1, "see Qty-total"), (1, "see quantity")], "request_id int, note string")
    assert [r.note for r in explain.relevant_notes(notes, spark.createDataFrame([(1, "qty")], "request_id int, name string")).collect()] == ["see Qty-total"]
    tree = client.tree_rows(spark.createDataFrame([("a.b.c",), ("a.d",)], "path string"))
    assert {r.node for r in client.tree_filter(tree, "C").collect()} == {"a", "a.b", "a.b.c"}
    gap = explain.verdict(F.lit(1), F.lit(True), F.lit(False))
    assert spark.range(1).select(gap, explain.validated_confidence(F.lit(0.9), gap)).first()[:] == ("NeedMoreEvidence", 0.75)


def test_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet").limit(0) for n in ("lineitem", "orders", "customer", "nation", "part", "supplier")}
    assert relational.order_rows(t["lineitem"], t["orders"], t["customer"], t["nation"], t["part"], t["supplier"]).count() == 0
    assert relational.available(t["lineitem"], spark.read.parquet(f"{sf}/part.parquet")).where("available <> 0").count() == 0


def test_json_leaves_of_odd_texts(spark):
    docs = [(1, '{"a": 1.50, "a": 1e2, "Token": {"x": 1}, "half": "\\ud800", "": {"": 0}}'), (2, "{"), (3, '{"a": NaN}'), (4, ""), (5, '"x"'), (6, '{"e": {}, "l": [[], null]}')]
    got = [(r.k, r.path, r.value) for r in runtime.json_leaves(spark.createDataFrame(docs, "k int, j string"), "j").orderBy("k", "ord").collect()]
    assert got == [(1, "a", "1.50"), (1, "a", "1e2"), (1, "half", '"?"'), (1, "", "0"), (6, "l", "null")]


def test_fold_of_maps(spark):
    rows = [node("a", 0, 0, "Unknown", "FillGaps", "n"), node("b", 0, 0, "Unknown", "FillGaps", "n"), node("b", 1, 0, "Unknown", "FillGaps", "m"), node("c", 0, 0, "Pending", "FillGaps", "n", x="1", y="1"), node("c", 1, 0, "Known", "FillGaps", "m", x="2"), node("c", 2, 0, "Known", "FillGaps", "o", x="3", z="3")]
    got = {r.id: r.metadata for r in merge.merge_nodes(spark.createDataFrame(rows, SEQ)).collect()}
    assert got == {"a": None, "b": {}, "c": {"x": "2", "y": "1", "z": "3"}}
    assert merge.merge_nodes(spark.createDataFrame([], SEQ)).isEmpty() and merge.define_nodes(spark.createDataFrame([], SEQ)).isEmpty()


@pytest.mark.parametrize("seed", range(2))
def test_define_against_a_loop(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(40):
        maybe = lambda x: x if rng.random() < 0.5 else None
        rows.append(node(f"n{rng.randrange(6)}", rng.randrange(3), k, rng.choice(["Unknown", "Pending", "Known"]), "", f"name{k}", maybe(f"d{k}"), maybe((f"p{k}", 1, 2)), maybe(f"v{k}"), **{rng.choice("abc"): str(k)}))
    names, want = [x.split()[0] for x in SEQ.split(", ")], {}
    for r in sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda r: (r["ord"], r["seq"])):
        old = want.get(r["id"])
        if old and old["status"] == "Known" and r["status"] != "Known":
            continue
        want[r["id"]] = r if old is None else {**r, "metadata": {**old["metadata"], **r["metadata"]}, **{c: r[c] if r[c] is not None else old[c] for c in ("description", "source")}}
    for r in merge.define_nodes(spark.createDataFrame(rows, SEQ)).collect():
        w = want.pop(r.id)
        assert (r.name, r.type, r.status, r.description, r.scanVersion, r.metadata, r.source and tuple(r.source)) == (w["name"], w["type"], w["status"], w["description"], w["scanVersion"], w["metadata"], w["source"])
    assert not want


def test_build_modes(spark):
    with pytest.raises(ValueError):
        merge.build({"linker": ()}, "CuratedOnly")


@pytest.mark.parametrize("seed", range(2))
def test_fold_members_by_definition(spark, seed):
    rng, rows, want = random.Random(seed), [], set()
    for request in range(8):
        hops, seen = {(): ("json:root", None, False)}, set()
        for k in range(25):
            up, name = rng.choice([o for o, h in hops.items() if not h[2]]), rng.choice(["udf:dbo.F", "column:c", "param:p"]) + str(rng.randrange(5))
            hops[(*up, f"{k:02}")] = (name, rng.choice(["ControlledBy", "DerivedFrom", "AliasOf", "Reads"]), name in seen)
            seen.add(name)
        rows += [(request, n, relation, repeat, list(o)) for o, (n, relation, repeat) in hops.items()]
        below = {o: [c for c in sorted(hops) if c[: len(o)] == o and c != o] for o in hops}
        tops = {n: o for o, (n, _, repeat) in hops.items() if n.startswith("udf") and not repeat and below[o]}
        shown = {"column:c1"} | {hops[o][0] for o in hops if not any(o in below[t] for t in tops.values())}
        opened = {hops[c][0] for c in below[tops["udf:dbo.F1"]]} - {"udf:dbo.F1"} if "udf:dbo.F1" in tops else set()
        for n, o in tops.items():
            spine = list(dict.fromkeys(hops[c][0] for c in below[o] if hops[c][0] != n and not any(hops[c[:k]][1] in client.CONTROL for k in range(len(o) + 1, len(c) + 1))))
            for name in {hops[c][0] for c in below[o]} - {n}:
                counted = n != "udf:dbo.F1" and name not in shown
                want.add((request, n, name, spine.index(name) + 1 if name in spine else None, counted, counted and name not in opened))
    table = spark.createDataFrame(rows, "request_id int, node_id string, relation string, is_repeat boolean, ords array<string>")
    outside, unfolded = spark.createDataFrame([(r, "column:c1") for r in range(8)], "request_id int, node_id string"), spark.createDataFrame([(r, "udf:dbo.F1") for r in range(8)] * 2, "request_id int, function string")
    got = [tuple(r) for r in client.fold_members(table, outside, unfolded).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(r[5] for r in got)
    assert client.fold_members(table.limit(0), outside, unfolded).isEmpty()


def test_off_path_values_and_highlights(spark):
    rows = spark.createDataFrame([("a", 2, "U1", 2.0), ("a", 1, "u1", 1.0), ("a", 3, None, 3.0), ("b", 1, None, 1.0), ("c", 1, "U2", 1.0)], "node_id string, event_id int, scope string, value double")
    assert [tuple(r) for r in client.off_path_values(rows, rows.where("node_id = 'b'"), "U1").collect()] == [("a", 2, "U1", 2.0)]
    assert {tuple(r) for r in client.off_path_values(rows, rows.limit(0), None).collect()} == {("a", 3, None, 3.0), ("b", 1, None, 1.0)}
    hops = spark.createDataFrame([(1, "n", "e"), (1, "n", "e"), (1, "root", None)], "request_id int, node_id string, edge_id string")
    lit = client.highlights(hops, hops.where("node_id = 'n'"), spark.createDataFrame([(1, ["n", "k"])], "request_id int, path array<string>"))
    assert sorted(tuple(r)[1:] for r in lit.collect()) == [("lit", "e"), ("lit", "k"), ("lit", "n"), ("lit", "root"), ("path", "n")]


def test_methods_of_odd_classes(spark):
    text = """public class A<T> : X, ControllerBase where T : class {
    public A(int n) : base(n) { var x = new B(n); if (n > 1) { Run(n); } else if (n < 2) { return Go(n); } }
    /// <summary>One <see cref="X"/>.</summary>
    /// <param name="s">s</param>
    [Obsolete("no")] [HttpGet("{id}")]
    protected internal override Task<IReadOnlyList<M?>> Get<U>(this string s, params int[] n) where U : class { foreach (var m in n) { yield return Do(m); } }
    ///   <summary>   </summary>
    private protected abstract M.Inner[]? Other(Func<int, string> f = default(Func<int>));
}
class B { int P { get; set; } }"""
    methods = source_text.cs_methods(spark.createDataFrame([("p", text), ("q", None), ("r", ""), ("s", "class")], "path string, text string"))
    got = [tuple(r)[1:] for r in methods.collect()]
    assert got == [
        ("A", "Get", "method:A.Get", "Task<IReadOnlyList<M?>>", "string s, int[] n", "protectedorinternal", False, "Api", 'One <see cref="X"/>.'),
        ("A", "Other", "method:A.Other", "M.Inner[]?", "Func<int, string> f", "protectedandinternal", False, "Api", None),
    ]
    models = spark.createDataFrame([("M",), ("M",), ("Z",)], "model string")
    assert [tuple(r) for r in source_text.cs_return_edges(methods, models).collect()] == [("method:A.Get", "Returns", "model:M", "Task<IReadOnlyList<M?>>")]
