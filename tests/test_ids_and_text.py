from pyspark.sql import functions as F

from weft.functions import ids
from weft.functions import text as T
from weft.schema import PREFIXES, RELATIONS
from weft.sources import source_text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_id_parts(spark):
    at = F.lit("spcol:dbo.Sp.Col")
    assert one(spark, ids.prefix(at), ids.owner_key(at), ids.leaf(at), ids.node_type(at), ids.node_layer(at)) == ("spcol", "dbo.Sp.Col", "Col", "ResultColumn", "Data")
    assert one(spark, ids.prefix(F.lit("none")), ids.node_type(F.lit("x:y")), ids.node_layer(F.lit("x:y"))) == ("", "Method", "Service")
    assert one(spark, ids.display_name(F.lit("api:GET /a.b")), ids.display_name(F.lit("sp:dbo.A.B")), ids.display_name(F.lit("field:A.B"))) == ("GET /a.b", "A.B", "B")
    assert one(spark, ids.edge_id(F.lit("a"), F.lit("Calls"), F.lit("b")), ids.lineage_id(F.lit("a"), F.lit(None).cast("string"), F.lit("x = 1"))) == ("edge:a|Calls|b", "lineage:a<-?[x = 1]")
    assert one(spark, ids.normalised(F.lit("[inv]"), F.lit("[U]")), ids.normalised(F.lit(""), F.lit("T")), ids.route_id(F.lit("get"), F.lit("/x/y/"))) == ("inv.U", "dbo.T", "api:GET /x/y")
    assert len(RELATIONS) == 19 and len(PREFIXES) == 18
    assert one(spark, ids.upstream(F.lit("a"), F.lit("Reads"), F.lit("b")), ids.upstream(F.lit("a"), F.lit("MapsTo"), F.lit("b")), ids.upstream(F.lit("a"), F.lit("Contains"), F.lit("b"))) == ("b", "a", None)


def test_redaction(spark):
    said = "Server=db01;User Id=me; Bearer abc.DEF eyJabcdefgh1.abcdefgh2.abcdefgh3 at 10.1.2.3 on app.corp by a.b@c.org"
    assert one(spark, T.redact(F.lit(said)))[0] == "Server=[redacted];User Id=[redacted]; Bearer [redacted] [redacted] at [redacted] on [redacted] by [redacted]"
    safe = T.redact_members(F.create_map(F.lit("ApiKey"), F.lit("x"), F.lit("note"), F.lit("ip 1.2.3.4"), F.lit("gone"), F.lit(None).cast("string")))
    assert one(spark, safe)[0] == {"ApiKey": "[redacted]", "note": "ip [redacted]", "gone": None}


def test_redacted_json_keeps_numbers_and_odd_text(spark):
    cases = {
        '{"a": 1.10, "b": 1e400, "c": -0, "d": 12345678901234567890, "pwd": 5}': '{"a":1.10,"b":1e400,"c":-0,"d":12345678901234567890,"pwd":"[redacted]"}',
        r'{"a": "\ud800", "b": "\ud83d\ude00"}': r'{"a":"\ud800","b":"😀"}',
        '{"Token": {"x": "1.2.3.4", "host": null}, "user": ["a@b.cd", true]}': '{"Token":{"x":"[redacted]","host":null},"user":["[redacted]",true]}',
        '"pwd=x"': '"pwd=[redacted]"', "[]": "[]", "null": "null", '"١.١.١.١ ü@ü.de"': '"١.١.١.١ ü@ü.de"',
        "NaN": None, "{": None, "": None, "[" * 100_000: None, '{"k": 1, "k": 2}': '{"k":2}',
    }
    rows = spark.createDataFrame([(k, *kv) for k, kv in enumerate([*cases.items(), (None, None)])], "k int, given string, want string")
    for r in rows.withColumn("got", T.redact_json(F.col("given"))).collect():
        assert r.got == r.want, r.given


def test_gateway_rules(spark):
    call = lambda tool, **a: T.denial(F.lit(tool), F.create_map(*[F.lit(x) for kv in a.items() for x in kv]) if a else F.create_map().cast("map<string,string>"))
    whys = one(
        spark, call(" "), call("EXECUTE_SQL", a="b"), call("Trace_pick_order", orderNo="1"), call("trace_material", orderNo="O1"), call("trace_pick_order", orderNo="x" * 101), call("trace_pick_order", orderNo="a..b"),
        call("trace_pick_order", orderNo="1 union 2"), call("trace_pick_order", orderNo="O-1", pickGroup=""), call("trace_pick_order", orderNo="PICK 1"),
    )
    assert whys[0] == "The call names no tool." and "forbidden by policy" in whys[1] and "none of the tools" in whys[2]
    assert whys[3] == "trace_material needs a value for 'materialNo'." and "longer than 100" in whys[4] and "may hold only" in whys[5]
    assert "reads like SQL" in whys[6] and "may hold only" in whys[7] and whys[8] is None


def test_values_and_confidence(spark):
    assert one(spark, T.values_equal(F.lit(" 'TRUE' "), F.lit("1")), T.value_of(F.lit('x = "5"')), T.isnull_default(F.lit("ISNULL(SUM(a), 0)")), T.isnull_default(F.lit("SUM(a)"))) == (True, "5", "0", "")
    conditions = F.array(F.lit("ELSE"), F.lit("@E = 1"))
    assert one(spark, T.active_branch(F.lit("true"), conditions), T.active_branch(F.lit("7"), conditions), T.active_branch(F.lit("7"), F.array(F.lit("@E = 1")))) == ("@E = 1", "ELSE", None)
    c = lambda facts, unknown, runtime, notes, only: T.confidence(F.lit(facts), F.lit(unknown), F.lit(runtime), F.lit(notes), F.lit(only))
    assert one(spark, c(3, 0, True, 0, False), c(0, 0, True, 0, False), c(1, 9, True, 0, False), c(1, 1, False, 1, True)) == (0.95, 0.0, 0.3, 0.55)
    assert one(spark, T.language(F.lit("ZH-tw")), T.language(F.lit(None).cast("string")), T.truncated(F.lit("a" * 200)), T.squeezed(F.lit(" a /* b */ -- c\n d "))) == ("zh", "en", "a" * 117 + "...", "a d")


def test_source_text(spark):
    files = spark.createDataFrame([("a", "CREATE PROC P @x int AS WITH c AS (SELECT * FROM [dbo].[T]) SELECT * INTO #t FROM c JOIN s.U ON 1 = 1 CROSS APPLY dbo.F(@x) f"), ("b", None), ("c", "SELECT 1")], "path string, text string")
    row = source_text.sql_objects(files).first()
    assert (row.kind, row.name, row.parameters, row.reads, row.calls) == ("sp", "dbo.P", ["@x"], ["dbo.T", "s.U"], ["dbo.F"])
    assert {(r.path, r.severity) for r in source_text.diagnostics(files).collect()} == {("b", "Error"), ("c", "Warning")}
    assert one(spark, *[source_text.json_name(F.lit(x)) for x in ("Name", "URLPath", "URL", "X", "idNo")]) == ("name", "urlPath", "url", "x", "idNo")
