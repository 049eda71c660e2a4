"""Runtime captures derived from orders, redaction of texts, and the gateway over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import runtime
from weft.operators.shared import kept
from weft.plans.registry import query
from weft.sources import bench_graph as g

# A capture for each order: two parameters, one procedure with a row for each line, one function with a value for each line, and a response.
CAPTURE_LINES = """SELECT o_orderkey, o_orderstatus, o_orderpriority, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS quantity FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"""
ORDERED = "l_linenumber, l_partkey, l_suppkey, quantity"


def captures(spark, sf_dir):
    rows = g.frame(spark, sf_dir, CAPTURE_LINES)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "quantity")
    each = rows.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = lambda x: x.cast("string")
    part = lambda x: F.concat(F.lit("P"), text(x["l_partkey"]))
    cells = F.transform("lines", lambda x: F.create_map(F.lit("part"), part(x), F.lit("quantity"), text(x["quantity"])))
    values = F.transform("lines", lambda x: F.when(x["quantity"] > 10, F.create_map(F.lit("ReturnValue"), text(x["quantity"]), F.lit("part"), part(x))).otherwise(F.create_map(F.lit("other"), F.lit("-"))))
    rows_json = F.transform("lines", lambda x: F.struct(F.struct(x["l_suppkey"].alias("zone"), F.lit("secret").alias("token")).alias("bin"), part(x).alias("materialNumber"), x["quantity"].alias("quantity")))
    result = lambda rows_, ms, key, column: F.struct(ms.cast("int").alias("durationMs"), F.lit(key).alias("rowKey"), F.lit(column).cast("string").alias("returnColumn"), rows_.alias("rows"))
    return each.select(
        F.concat(F.lit("trace-"), text(F.col("o_orderkey"))).alias("trace_id"), F.concat(F.lit("fx-"), text(F.col("o_orderkey"))).alias("fixture_id"), F.concat(F.lit("O"), text(F.col("o_orderkey"))).alias("entity_key"),
        F.when(F.col("o_orderstatus") == "F", "fixture").when(F.col("o_orderstatus") == "O", "Test").otherwise("PROD").alias("environment"),
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("systemParameters"),
        F.create_map(F.lit("dbo.Lines"), result(cells, F.col("o_orderkey") % 50, "part", None)).alias("procedureResults"),
        F.create_map(F.lit("dbo.Value"), result(values, F.lit(None), "part", " ")).alias("functionResults"),
        F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.array().cast("array<int>").alias("none")).alias("header"), rows_json.alias("rows"), F.lit(True).alias("done"))).alias("response"),
    )


LINES = f"lines AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY {ORDERED}) - 1 AS pos FROM ({g.plain(CAPTURE_LINES)}) x)"
HEADS = "heads AS (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM lines)"
ROWS = f"""{LINES}, {HEADS}, rows_ AS (
SELECT o_orderkey, 0 AS section, 'param:priority' AS node_id, o_orderpriority AS value, NULL AS scope, 0 AS a, 0 AS b FROM heads UNION ALL SELECT o_orderkey, 0, 'param:status', o_orderstatus, NULL, 0, 1 FROM heads
UNION ALL SELECT o_orderkey, 1, 'sp:dbo.Lines', CAST(o_orderkey % 50 AS STRING), NULL, -1, 0 FROM heads
UNION ALL SELECT o_orderkey, 1, 'spcol:dbo.Lines.part', 'P' || CAST(l_partkey AS STRING), 'P' || CAST(l_partkey AS STRING), pos, 0 FROM lines UNION ALL SELECT o_orderkey, 1, 'spcol:dbo.Lines.quantity', CAST(quantity AS STRING), 'P' || CAST(l_partkey AS STRING), pos, 1 FROM lines
UNION ALL SELECT o_orderkey, 2, 'udf:dbo.Value', CAST(quantity AS STRING), 'P' || CAST(l_partkey AS STRING), pos, 0 FROM lines WHERE quantity > 10
UNION ALL SELECT o_orderkey, 3, 'json:header.status', '"' || o_orderstatus || '"', NULL, -1, 0 FROM heads
UNION ALL SELECT o_orderkey, 3, 'json:rows.bin.zone', CAST(l_suppkey AS STRING), 'P' || CAST(l_partkey AS STRING), pos, 0 FROM lines UNION ALL SELECT o_orderkey, 3, 'json:rows.materialNumber', '"P' || CAST(l_partkey AS STRING) || '"', 'P' || CAST(l_partkey AS STRING), pos, 1 FROM lines
UNION ALL SELECT o_orderkey, 3, 'json:rows.quantity', CAST(quantity AS STRING), 'P' || CAST(l_partkey AS STRING), pos, 2 FROM lines UNION ALL SELECT o_orderkey, 3, 'json:done', 'true', NULL, 1000000, 0 FROM heads),
bound AS (SELECT 'trace-' || CAST(o_orderkey AS STRING) AS trace_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY section, a, b) AS n, * FROM rows_)"""


@query(f"WITH {ROWS} SELECT trace_id, section, count(*) AS n, 'ev-' || lpad(CAST(min(n) AS STRING), 3, '0') AS first_id, sha256(string_agg(node_id || '=' || value || '@' || coalesce(scope, ''), ';' ORDER BY n)) AS hash FROM bound GROUP BY trace_id, section")
def d1_bind(spark, sf_dir):
    rows = runtime.bind(captures(spark, sf_dir))
    said = F.struct(F.length("id"), F.col("id"), F.concat("node_id", F.lit("="), "value", F.lit("@"), F.coalesce("scope", F.lit(""))).alias("said"))
    each = rows.groupBy("trace_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(said)).alias("s"))
    return each.select("trace_id", "section", "n", F.col("s")[0]["id"].alias("first_id"), F.sha2(F.array_join(F.transform("s", lambda x: x["said"]), ";"), 256).alias("hash"))


@query(f"""WITH {ROWS} SELECT trace_id, 'ev-' || lpad(CAST(n AS STRING), 3, '0') AS id, CASE WHEN node_id = 'sp:dbo.Lines' THEN 'dbo.Lines ' || value || ' ms' WHEN section = 0 THEN split_part(node_id, ':', 2)
WHEN section = 1 THEN scope || '.' || split_part(node_id, '.', 3) ELSE coalesce(scope || '.', '') || split_part(node_id, ':', 2) END AS label FROM bound""")
def d8_labels(spark, sf_dir):
    return runtime.bind(captures(spark, sf_dir)).select("trace_id", "id", "label")


@query(f"WITH {LINES} SELECT 'trace-' || CAST(o_orderkey AS STRING) AS trace_id, name, count(*) AS n, min(value) AS least, min(scope) AS scope FROM (SELECT o_orderkey, 'part' AS name, 'P' || CAST(l_partkey AS STRING) AS value, 'P' || CAST(l_partkey AS STRING) AS scope FROM lines UNION ALL SELECT o_orderkey, 'quantity', CAST(quantity AS STRING), 'P' || CAST(l_partkey AS STRING) FROM lines) x GROUP BY 1, 2")
def d3_unpivot(spark, sf_dir):
    return runtime.cells(captures(spark, sf_dir)).groupBy("trace_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.min("scope").alias("scope"))


@query(f"WITH {LINES} SELECT 'trace-' || CAST(o_orderkey AS STRING) AS trace_id, CAST(pos AS INT) AS row, CAST(quantity AS STRING) AS value, 'P' || CAST(l_partkey AS STRING) AS scope FROM lines WHERE quantity > 10")
def d4_udf_returns(spark, sf_dir):
    return runtime.returns(captures(spark, sf_dir)).select("trace_id", "row", "value", "scope")


@query(f"WITH {LINES} SELECT 'trace-' || CAST(o_orderkey AS STRING) AS trace_id, CAST(count(*) - 3 AS STRING) || ' rows beyond the limit of 3 were not captured: dbo.Lines' AS unknown FROM lines GROUP BY o_orderkey HAVING count(*) > 3")
def d5_row_limit(spark, sf_dir):
    return runtime.beyond_limit(captures(spark, sf_dir), limit=3).select("trace_id", "unknown")


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) = lower('1-urgent') THEN NULL ELSE o_orderpriority END AS scope FROM orders")
def d6_scope(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", runtime.scoped(F.create_map(F.lit("key"), F.col("o_orderpriority")), F.lit("key"), F.lit("1-Urgent")).alias("scope"))


@query("SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS STRING) AS value FROM events")
def d7_json_leaves(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return runtime.json_leaves(events, "props").select("event_id", "path", "value")


def redact_sql(column: str) -> str:
    for pattern, to in T.REDACTIONS:
        column = f"regexp_replace({column}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return column


@query(f"SELECT 'document' AS kind, doc_id AS id, sha256({redact_sql('text')}) AS hash FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, sha256({redact_sql('text')}) FROM conversations")
def d9_redact_text(spark, sf_dir):
    docs, turns = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "conversations"))
    hash_ = F.sha2(T.redact(F.col("text")), 256).alias("hash")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), hash_).union(turns.select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), hash_))


@query(f"SELECT c_custkey, c_custkey % 2 = 0 AS odd, CASE WHEN c_custkey % 2 = 0 THEN '[redacted]' ELSE c_name END AS said, {redact_sql(chr(39) + 'host=' + chr(39) + ' || c_mktsegment')} AS note FROM customer")
def d10_redact_json(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    members = F.from_json(F.to_json(F.create_map(F.when(F.col("c_custkey") % 2 == 0, "UserName").otherwise("title"), F.col("c_name"), F.lit("note"), F.concat(F.lit("host="), "c_mktsegment"))), "map<string,string>")
    safe = T.redact_members(members)
    return customer.select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("odd"), F.coalesce(F.element_at(safe, F.lit("UserName")), F.element_at(safe, F.lit("title"))).alias("said"), F.element_at(safe, F.lit("note")).alias("note"))


@query("""SELECT c_custkey, '{"outer":{"UserName":"[redacted]","note":"host=[redacted] ' || c_mktsegment || '"},"token":{"deep":["' || c_name || '",{"pwd":null},"[redacted]"]},"list":[[1,2.5,true],"' || c_name || '"],"n":' || CAST(c_custkey AS STRING) || '}' AS json FROM customer""")
def d10_redact_nested(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    text = F.concat(F.lit('{"outer": {"UserName": "'), name, F.lit('", "note": "host=h1 '), segment, F.lit('"}, "token": {"deep": ["'), name, F.lit('", {"pwd": null}, "a.b@c.org"]}, "list": [[1, 2.5, true], "'), name, F.lit('"], "n": '), F.col("c_custkey").cast("string"), F.lit("}"))
    return customer.select("c_custkey", T.redact_json(text).alias("json"))


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS sensitive, count(*) AS n FROM events GROUP BY event_type")
def d11_sensitive(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.when(F.col("user_id") % 3 == 0, "AccessToken").otherwise(F.col("event_type"))
    return events.groupBy("event_type").agg(F.count_if(T.is_sensitive(key)).alias("sensitive"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'trace-' || CAST(o_orderkey AS STRING) AS trace_id FROM orders WHERE 'o' || CAST(o_orderkey AS STRING) = 'o7' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def d12_trace_order(spark, sf_dir):
    return runtime.by_entity(captures(spark, sf_dir), " o7 ").select("trace_id")


@query(f"""WITH {ROWS} SELECT trace_id || ':p1' AS trace_id, count(*) AS n FROM bound WHERE scope IS NULL OR lower(scope) = 'p1' GROUP BY trace_id UNION ALL SELECT trace_id, 0 FROM bound GROUP BY trace_id HAVING count(*) FILTER (lower(scope) = 'p1') = 0""")
def d13_trace_material(spark, sf_dir):
    own, unseen = runtime.by_material(kept(runtime.bind(captures(spark, sf_dir)).select("trace_id", "scope")), "p1")
    return own.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).union(unseen.select("trace_id", F.lit(0).cast("long")))


@query("SELECT 'fx-' || CAST(o_orderkey AS STRING) AS fixture_id, CASE WHEN o_orderstatus = 'F' THEN 'fixture' ELSE 'Test' END AS environment, o_orderpriority AS value FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY fixture_id LIMIT 1")
def d14_read_param(spark, sf_dir):
    return runtime.read_parameter(captures(spark, sf_dir), "priority")


@query("SELECT 'fx-' || CAST(o_orderkey AS STRING) AS fixture_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 3 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def d15_read_response(spark, sf_dir):
    return runtime.read_response(captures(spark, sf_dir), " FX-3 ", "$.header.status").withColumnRenamed("value", "status")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'fixture' WHEN 'O' THEN 'Test' ELSE 'PROD' END AS environment, o_orderstatus IN ('F', 'O') AS allowed, count(*) AS n FROM orders GROUP BY ALL")
def d16_env_gate(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    env = F.when(F.col("o_orderstatus") == "F", "fixture").when(F.col("o_orderstatus") == "O", "Test").otherwise("PROD")
    return orders.select(env.alias("environment")).groupBy("environment", runtime.allowed(F.col("environment")).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'trace-' || CAST(o_orderkey AS STRING) AS trace_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def d17_preload(spark, sf_dir):
    return captures(spark, sf_dir).where(runtime.allowed(F.col("environment")) & F.col("trace_id").isNotNull()).select("trace_id")


# A gateway call for each event, hostile ones among them.
CALLS = """SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Execute_SQL' WHEN 2 THEN 'drop_all' WHEN 3 THEN 'trace_material' WHEN 4 THEN 'read_system_parameter' ELSE 'trace_pick_order' END AS tool,
CASE event_id % 5 WHEN 0 THEN 'P1' WHEN 1 THEN ' ' WHEN 2 THEN 'a; b' WHEN 3 THEN '../x' ELSE 'x select y' END AS arg, 'k' || CAST(user_id % 9 AS STRING) AS key FROM {events}"""


def calls(spark, sf_dir):
    rows = g.frame(spark, sf_dir, CALLS)
    named = F.when(F.col("tool") == "trace_material", F.create_map(F.lit("orderNo"), F.lit("O1"), F.lit("materialNo"), F.col("arg"))).when(F.col("tool") == "read_system_parameter", F.create_map(F.lit("name"), F.col("arg"), F.lit("token"), F.lit("t"))).otherwise(F.create_map(F.lit("orderNo"), F.col("arg")))
    return rows.select("seq", "tool", named.alias("arguments"), "key", "arg")


WHY = f"""CASE WHEN tool = '' THEN 'The call names no tool.' WHEN tool = 'Execute_SQL' THEN '''Execute_SQL'' is forbidden by policy: this runtime only reads; it runs no free SQL and changes no data.'
WHEN tool = 'drop_all' THEN '''drop_all'' is none of the tools: {', '.join(T.TOOLS)}.' WHEN arg = ' ' THEN tool || ' needs a value for ''' || a || '''.'
WHEN arg IN ('a; b', '../x') THEN 'The value of ''' || a || ''' may hold only letters, digits, spaces and _ . : -, and no two dots together.' WHEN arg = 'x select y' THEN 'The value of ''' || a || ''' reads like SQL.' END"""
CALL_ROWS = f"calls AS (SELECT *, CASE tool WHEN 'trace_material' THEN 'materialNo' WHEN 'read_system_parameter' THEN 'name' ELSE 'orderNo' END AS a FROM ({g.plain(CALLS)}) x), judged AS (SELECT *, {WHY} AS why FROM calls)"


@query(f"WITH {CALL_ROWS} SELECT seq, tool, why FROM judged")
def d18_validate(spark, sf_dir):
    return calls(spark, sf_dir).select("seq", "tool", T.denial(F.col("tool"), F.col("arguments")).alias("why"))


@query(f"""WITH {CALL_ROWS}, data AS (SELECT 'trace_pick_order' AS tool, 'k' || CAST(n_nationkey AS STRING) AS key, n_name AS result, CASE WHEN n_nationkey % 3 = 0 THEN 'PROD' ELSE 'uat' END AS env FROM nation)
SELECT seq, 'audit-' || lpad(CAST(seq AS STRING), CAST(greatest(4, length(CAST(seq AS STRING))) AS INT), '0') AS audit_id, CASE WHEN why IS NOT NULL THEN 'denied' WHEN env IS NULL THEN 'no data' WHEN env = 'PROD' THEN 'access denied' ELSE 'ok' END AS outcome, coalesce(why, CASE WHEN env = 'PROD' THEN 'environment not allowed: PROD' END) AS reason,
CASE WHEN why IS NULL AND env = 'uat' THEN result END AS result FROM judged LEFT JOIN data USING (tool, key)""")
def d19_invoke(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    data = nation.select(F.lit("trace_pick_order").alias("tool"), F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("result"), F.when(F.col("n_nationkey") % 3 == 0, "PROD").otherwise("uat").alias("environment"))
    return runtime.invoke(calls(spark, sf_dir), data).select("seq", "audit_id", "outcome", "reason", "result")


@query(f"""WITH {ROWS}, env AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fixture' WHEN 'O' THEN 'Test' ELSE 'PROD' END AS environment FROM heads),
more AS (SELECT o_orderkey, count(*) - 3 AS beyond FROM lines GROUP BY o_orderkey), unknowns AS (SELECT o_orderkey, CASE WHEN beyond > 0 THEN '["' || CAST(beyond AS STRING) || ' rows beyond the limit of 3 were not captured: dbo.Lines","' || CAST(beyond AS STRING) || ' rows beyond the limit of 3 were not captured: dbo.Value"]' ELSE '[]' END AS u FROM more),
shown AS (SELECT b.* FROM bound b WHERE section IN (0, 3) OR a < 3), per AS (SELECT o_orderkey, scope, count(*) AS n FROM shown WHERE scope IS NOT NULL GROUP BY 1, 2), total AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (scope IS NULL) AS free FROM shown GROUP BY 1),
first_ AS (SELECT arg_min(o_orderkey, 'fx-' || CAST(o_orderkey AS STRING)) AS o_orderkey FROM env WHERE environment <> 'PROD'), k AS (SELECT *, CAST(o_orderkey AS STRING) AS o FROM env JOIN unknowns USING (o_orderkey) JOIN total USING (o_orderkey))
SELECT 'trace_pick_order' AS tool, 'O' || o AS key, environment, '{{"traceId":"trace-' || o || '","entityKey":"O' || o || '","environment":"' || environment || '","evidenceCount":' || CAST(n AS STRING) || ',"unknowns":' || u || '}}' AS result FROM k
UNION ALL SELECT 'trace_material', 'O' || o || '/' || scope, environment, '{{"traceId":"trace-' || o || ':' || scope || '","entityKey":"O' || o || '","scope":"' || scope || '","evidenceCount":' || CAST(per.n + free AS STRING) || ',"unknowns":' || u || '}}' FROM k JOIN per USING (o_orderkey)
UNION ALL SELECT 'read_system_parameter', name, environment, '{{"id":"' || id || '","nodeId":"param:' || name || '","value":"' || CASE name WHEN 'priority' THEN o_orderpriority ELSE o_orderstatus END || '","environment":"' || environment || '"}}' FROM first_ JOIN env USING (o_orderkey) JOIN heads USING (o_orderkey), (VALUES ('priority', 'ev-001'), ('status', 'ev-002')) p(name, id)""")
def d20_results(spark, sf_dir):
    return runtime.tool_results(captures(spark, sf_dir), limit=3).where("tool <> 'read_pick_order_response'")


@query(f"WITH {CALL_ROWS} SELECT seq, CASE WHEN tool = 'read_system_parameter' THEN '[redacted]' END AS token, CASE WHEN a = 'name' THEN arg END AS name FROM judged")
def d21_audit_args(spark, sf_dir):
    safe = T.redact_members(F.col("arguments"))
    return calls(spark, sf_dir).select("seq", F.element_at(safe, F.lit("token")).alias("token"), F.element_at(safe, F.lit("name")).alias("name"))


@query("SELECT lower(trace) AS trace_id, ts AS observed_at FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 't' END || CAST(user_id AS STRING) AS trace, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1")
def a12_trace_store(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    saved = events.select(F.concat(F.when(F.col("event_id") % 2 == 0, "T").otherwise("t"), F.col("user_id").cast("string")).alias("trace_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"))
    return runtime.latest_traces(saved).select(F.lower("trace_id").alias("trace_id"), "observed_at")


@query("SELECT event_id AS seq, event_type AS tool FROM events ORDER BY event_id DESC LIMIT 50")
def a13_audit_recent(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return runtime.recent_audit(events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("tool")), 50)


@query("SELECT 'trace-' || CAST(o_orderkey AS STRING) AS trace_id, CASE o_orderstatus WHEN 'F' THEN 'fixture' WHEN 'O' THEN 'Test' ELSE 'PROD' END AS environment, CAST(count(*) AS INT) AS n_rows FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def a7_fixtures(spark, sf_dir):
    from weft.sources import snapshots

    own = captures(spark, sf_dir)
    doc = F.to_json(F.struct(F.col("fixture_id").alias("fixtureId"), F.col("entity_key").alias("entityKey"), "environment", F.col("trace_id").alias("traceId"), "systemParameters", "response", "procedureResults", "functionResults"))
    read = snapshots.fixtures(own.select(F.col("fixture_id").alias("path"), doc.alias("json")))
    return read.select("trace_id", "environment", F.size(F.element_at("procedureResults", F.lit("dbo.Lines"))["rows"]).alias("n_rows"))
