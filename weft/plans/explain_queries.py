"""Explanation rules over hops of the bench graph: one request for each order's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import client, explain, rules
from weft.plans.registry import query
from weft.sources import bench_graph as g

# Each order is a request whose hops are its lines: a part it aliases or, for returned lines, a supplier that controls it.
HOPS = """SELECT o_orderkey AS request_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS hop, 'spcol:line.' || CAST(l_linenumber AS STRING) AS parent,
CASE WHEN l_returnflag = 'R' THEN 'param:supplier.' || CAST(l_suppkey AS STRING) WHEN l_returnflag = 'A' THEN 'udf:dbo.F' || CAST(l_suppkey % 3 AS STRING) ELSE 'column:part.' || CAST(l_partkey AS STRING) END AS node_id, CASE WHEN l_returnflag = 'R' THEN 'ControlledBy' WHEN l_returnflag = 'A' THEN 'ComputedBy' ELSE 'AliasOf' END AS relation,
CASE WHEN l_tax > 0.04 THEN 'ISNULL(SUM(x), ' || CAST(CAST(l_quantity AS INT) AS STRING) || ')' END AS expression, CASE WHEN l_linestatus = 'F' THEN '@F = 1' END AS condition, CAST(CAST(l_quantity AS INT) AS STRING) AS literal, CAST(CAST(l_quantity AS INT) % 4 AS STRING) AS observed, l_quantity > 25 AS captured, l_linenumber AS depth
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"""
H = f"h AS ({g.plain(HOPS)})"


def hops(spark, sf_dir):
    return g.frame(spark, sf_dir, HOPS).withColumns({"edge_id": F.concat(F.lit("edge:"), "parent", F.lit("|"), "relation", F.lit("|"), "node_id"), "is_repeat": F.lit(False)})


LEAF = "regexp_extract(split_part({0}, ':', 2), '[^.]*$')"


@query(f"WITH {H} SELECT request_id, count(*) AS n, max(depth) AS depth, string_agg(node_id, ',' ORDER BY hop) AS path FROM h GROUP BY 1")
def e1_hops(spark, sf_dir):
    each = hops(spark, sf_dir).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("hop", "node_id"))).alias("p"))
    return each.select("request_id", "n", "depth", F.array_join(F.transform("p", lambda x: x["node_id"]), ",").alias("path"))


@query("SELECT o_orderkey, v AS note FROM (SELECT o_orderkey, unnest(string_split('@Status = ' || o_orderstatus || '; @Priority = ' || o_orderpriority || '; ', '; ')) AS v FROM orders) x WHERE v <> ''")
def e2_notes(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    said = F.concat(F.lit("@Status = "), "o_orderstatus", F.lit("; @Priority = "), "o_orderpriority", F.lit("; "))
    return orders.select("o_orderkey", F.explode(rules.hop_notes(said)).alias("note"))


@query("WITH GRAPH SELECT output, count(*) AS n, min(lineage_id) AS first_id FROM lineage WHERE source IS NULL AND transform = 'Literal' GROUP BY output")
def e3_literals(spark, sf_dir):
    return g.lineage(spark, sf_dir).where("source is null and transform = 'Literal'").groupBy("output").agg(F.count(F.lit(1)).alias("n"), F.min("lineage_id").alias("first_id"))


ITEMS = "SELECT request_id, 'Node' AS kind, node_id AS id, hop AS ord, relation AS text FROM h UNION ALL SELECT request_id, 'Edge', 'edge:' || parent || '|' || relation || '|' || node_id, 100 + hop, relation FROM h UNION ALL SELECT request_id, 'Runtime', 'ev-' || observed, 200 + hop, observed FROM h"


def items(spark, sf_dir):
    h = hops(spark, sf_dir)
    nodes = h.select("request_id", F.lit("Node").alias("kind"), F.col("node_id").alias("id"), F.col("hop").cast("long").alias("ord"), F.col("relation").alias("text"))
    edges = h.select("request_id", F.lit("Edge"), "edge_id", (F.col("hop") + 100).cast("long"), "relation")
    return nodes.union(edges).union(h.select("request_id", F.lit("Runtime"), F.concat(F.lit("ev-"), "observed"), (F.col("hop") + 200).cast("long"), "observed"))


@query(f"WITH {H}, i AS ({ITEMS}) SELECT request_id, kind, count(DISTINCT id) AS n FROM i GROUP BY 1, 2")
def e4_items(spark, sf_dir):
    return explain.bundle(items(spark, sf_dir)).groupBy("request_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH GRAPH SELECT trace_id, scope, count(*) AS n FROM evidence WHERE scope IS NOT NULL AND starts_with(node_id, 'json:') GROUP BY 1, 2")
def e5_context(spark, sf_dir):
    return g.evidence(spark, sf_dir).where(F.col("scope").isNotNull() & F.col("node_id").startswith("json:")).groupBy("trace_id", "scope").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {H}, i AS ({ITEMS}), o AS (SELECT DISTINCT request_id, kind, id FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE kind WHEN 'Node' THEN 0 WHEN 'Edge' THEN 1 ELSE 3 END, id) AS place FROM o) SELECT request_id, kind, id, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def e6_cap(spark, sf_dir):
    return explain.bundle(items(spark, sf_dir), 5).select("request_id", "kind", "id", "place")


@query(f"WITH {H}, i AS (SELECT DISTINCT request_id, kind, id FROM ({ITEMS}) x) SELECT request_id, kind, count(*) AS n FROM i WHERE kind = 'Node' OR id IN ('ev-0', 'ev-1') GROUP BY 1, 2")
def e7_allowed(spark, sf_dir):
    own = items(spark, sf_dir).select("request_id", "kind", "id").distinct()
    given = own.where(F.col("id").isin("ev-0", "ev-1")).select("request_id", "id")
    return explain.allow(own, given).groupBy("request_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {H}, w AS (SELECT DISTINCT request_id, lower(CASE WHEN node_id LIKE 'udf:%' THEN substr(node_id, 9) ELSE 'x' END) AS word FROM h) SELECT o_orderkey AS request_id, count(*) AS n FROM orders JOIN w ON w.request_id = o_orderkey WHERE word IN ('f' || CAST(o_orderkey % 3 AS STRING)) GROUP BY 1")
def e8_notes_filter(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    notes = orders.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("dbo.F"), (F.col("o_orderkey") % 3).cast("string"), F.lit(" was slow, see F_9")).alias("note"))
    names = hops(spark, sf_dir).select("request_id", F.when(F.col("node_id").startswith("udf:"), F.substring("node_id", 9, 50)).otherwise("x").alias("name"))
    return explain.relevant_notes(notes, names).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH GRAPH SELECT 'node' AS kind, id, type || ' ''' || name || ''' [' || status || ']' || CASE WHEN status <> 'Known' THEN ' - not scanned' ELSE '' END AS text FROM nodes
UNION ALL SELECT 'edge', edge_id, src || ' -' || relation || '-> ' || dst || CASE WHEN relation = 'ControlledBy' THEN ' when @Flag = 1' ELSE '' END || CASE WHEN relation = 'UsesParameter' THEN ' via @P' ELSE '' END || ' (Linker r1)' FROM edges
UNION ALL SELECT 'lineage', lineage_id, output || ' <- ' || coalesce(source, CASE WHEN transform = 'Literal' THEN '<literal>' ELSE '<unknown>' END) || ' [' || transform || ']' || coalesce(' ' || expression, '') || coalesce(' when ' || condition, '') FROM lineage
UNION ALL SELECT 'runtime', CAST(event_id AS STRING), coalesce(scope || '.value', node_id) || ' = ' || CASE WHEN event_id % 9 = 0 THEN 'null' ELSE CAST(event_id % 10 AS STRING) END || ' (' || evidence_type || ', Test, ' || substr(trace_id, 7) || ' 00:00:00Z) on ' || node_id FROM evidence""")
def e9_describe(spark, sf_dir):
    none, c = F.lit(None).cast("string"), F.col
    nodes = g.nodes(spark, sf_dir).select(F.lit("node").alias("kind"), "id", explain.describe_node(c("type"), c("name"), c("status"), none, F.lit("not scanned")).alias("text"))
    condition, variable = F.when(c("relation") == "ControlledBy", "@Flag = 1"), F.when(c("relation") == "UsesParameter", "@P")
    edges = g.edges(spark, sf_dir).select(F.lit("edge"), "edge_id", explain.describe_edge(c("src"), c("relation"), c("dst"), condition, variable, F.lit("Linker"), F.lit("r1")))
    lineage = g.lineage(spark, sf_dir).select(F.lit("lineage"), "lineage_id", explain.describe_lineage(c("output"), c("source"), c("transform"), c("expression"), c("condition")))
    value = F.when(c("event_id") % 9 != 0, (c("event_id") % 10).cast("string"))
    text = explain.describe_runtime(F.concat("scope", F.lit(".value")), c("node_id"), value, c("evidence_type"), F.lit("Test"), F.to_timestamp(F.substring("trace_id", 7, 10)))
    runtime = g.evidence(spark, sf_dir).select(F.lit("runtime"), c("event_id").cast("string"), text)
    return nodes.union(edges).union(lineage).union(runtime)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '@S = ''f''' WHEN o_orderstatus = 'O' THEN '@S = \"O\"' ELSE 'ELSE' END AS branch, upper(o_orderstatus) = 'F' AS same FROM orders")
def e12_active_branch(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    conditions = F.array(F.lit("x > 2"), F.lit("ELSE"), F.lit("@S = 'f'"), F.lit('@S = "O"'))
    return orders.select("o_orderkey", T.active_branch(F.col("o_orderstatus"), conditions).alias("branch"), T.values_equal(F.lit(" 'f' "), F.col("o_orderstatus")).alias("same"))


@query(f"WITH {H}, t AS (SELECT request_id, 'dbo.F ' || literal || ' ms = ' || literal AS said, 0 AS is_value FROM h UNION ALL SELECT request_id, 'dbo.F = ' || observed, 1 FROM h WHERE captured), k AS (SELECT request_id, max(is_value) AS v FROM t GROUP BY 1) SELECT request_id, count(*) AS n FROM t JOIN k USING (request_id) WHERE is_value = v GROUP BY 1")
def e16_return_texts(spark, sf_dir):
    h = hops(spark, sf_dir)
    said = h.select("request_id", F.concat(F.lit("dbo.F "), "literal", F.lit(" ms = "), "literal").alias("said")).union(h.where("captured").select("request_id", F.concat(F.lit("dbo.F = "), "observed")))
    each = said.groupBy("request_id").agg(F.collect_list("said").alias("said"))
    return each.select("request_id", F.size(explain.return_texts(F.col("said"))).cast("long").alias("n"))


@query("WITH GRAPH SELECT trace_id, lower(scope) AS scope, CAST(min(CASE WHEN node_id = 'json:click.value' THEN value END) AS DOUBLE) AS click, CAST(min(CASE WHEN node_id = 'json:view.value' THEN value END) AS DOUBLE) AS view FROM evidence WHERE scope IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (node_id = 'json:click.value') > 0 AND count(*) FILTER (node_id = 'json:view.value') > 0")
def e17_row_context(spark, sf_dir):
    found = explain.row_context(g.evidence(spark, sf_dir).withColumn("node_id", F.regexp_replace("node_id", r"\.value$", "")), "json:", ["click", "view"])
    return found.select("trace_id", "scope", F.col("click").cast("double").alias("click"), F.col("view").cast("double").alias("view"))


@query(f"""WITH {H}, s AS (SELECT request_id, count(*) FILTER (relation = 'AliasOf') AS facts, count(*) FILTER (relation = 'ControlledBy') AS gaps, bool_or(captured) AS runtime, count(*) FILTER (observed = '3') AS notes, count(*) FILTER (observed = '0') AS open_ FROM h GROUP BY 1)
SELECT request_id, CASE WHEN facts = 0 THEN 'Unknown' WHEN gaps > 0 OR open_ > 0 THEN 'NeedMoreEvidence' ELSE 'Known' END AS verdict,
CASE WHEN facts = 0 THEN 0.0 ELSE greatest(least(95 - 20 * gaps - CASE WHEN runtime THEN 0 ELSE 5 END - 5 * notes, 95), 30) / 100.0 END AS confidence FROM s""")
def e19_confidence(spark, sf_dir):
    h = hops(spark, sf_dir)
    s = h.groupBy("request_id").agg(F.count_if(F.col("relation") == "AliasOf").alias("facts"), F.count_if(F.col("relation") == "ControlledBy").alias("gaps"), F.bool_or("captured").alias("runtime"), F.count_if(F.col("observed") == "3").alias("notes"), F.count_if(F.col("observed") == "0").alias("open_"))
    c = F.col
    return s.select("request_id", explain.verdict(c("facts"), c("gaps") > 0, c("open_") > 0).alias("verdict"), T.confidence(c("facts"), c("gaps"), c("runtime"), c("notes"), F.lit(False)).alias("confidence"))


@query(f"WITH {H} SELECT request_id, node_id, 'Impact reaches ' || {LEAF.format('node_id')} AS text FROM (SELECT DISTINCT request_id, node_id FROM h) x")
def e21_impact_text(spark, sf_dir):
    from weft.functions import ids

    return hops(spark, sf_dir).select("request_id", "node_id").distinct().select("request_id", "node_id", F.concat(F.lit("Impact reaches "), ids.leaf(F.col("node_id"))).alias("text"))


@query(f"WITH {H} SELECT request_id, hop AS seq, CASE WHEN relation = 'ControlledBy' AND observed <> '1' THEN 'hypothesis' ELSE 'fact' END AS what, CASE WHEN relation = 'ControlledBy' THEN CASE WHEN observed = '1' THEN 1 ELSE 0 END ELSE 1 + CASE WHEN observed = '1' THEN 1 ELSE 0 END END AS n_ids FROM h")
def e22_validate(spark, sf_dir):
    h = hops(spark, sf_dir)
    facts = h.select("request_id", F.col("hop").alias("seq"), F.array("node_id", F.concat(F.lit("ev-"), "observed")).alias("ids"))
    allowed = h.where("relation <> 'ControlledBy'").select("request_id", F.col("node_id").alias("id")).union(h.select("request_id", F.lit("ev-1")))
    kept, downgraded = explain.validate(facts, allowed)
    return kept.select("request_id", "seq", F.lit("fact").alias("what"), F.size("ids").alias("n_ids")).union(downgraded.select("request_id", "seq", F.lit("hypothesis"), F.lit(0)))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'zh' ELSE 'en' END AS lang FROM documents")
def e23_lang(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.language(F.when(F.col("doc_id") % 5 == 0, "ZH-cn").otherwise(F.col("lang"))).alias("lang"))


@query(f"WITH {H} SELECT request_id, count(DISTINCT substr(node_id, 13)) AS n, string_agg(DISTINCT substr(node_id, 8), ',' ORDER BY substr(node_id, 8)) AS columns FROM h WHERE node_id LIKE 'column:%' GROUP BY 1")
def e13_base_columns(spark, sf_dir):
    return explain.base_columns(hops(spark, sf_dir)).select("request_id", F.size("columns").cast("long").alias("n"), F.array_join("columns", ",").alias("columns"))


@query(f"WITH {H}, t AS (SELECT *, 'f' || CAST(hop AS STRING) AS o FROM h) SELECT a.request_id, a.node_id AS function, count(DISTINCT b.node_id) AS hidden, 1 AS depth FROM t a JOIN t b ON a.request_id = b.request_id AND b.hop > a.hop AND b.hop <= a.hop + 2 WHERE a.node_id LIKE 'udf:%' AND a.hop % 3 = 1 GROUP BY 1, 2")
def i1_fold(spark, sf_dir):
    """Every third hop holds the two after it."""
    h = hops(spark, sf_dir)
    top = F.concat(F.lit("f"), (F.col("hop") - (F.col("hop") - 1) % 3).cast("string"))
    ords = F.when((F.col("hop") - 1) % 3 == 0, F.array(top)).otherwise(F.array(top, F.concat(F.lit("s"), F.col("hop").cast("string"))))
    return client.fold_plan(h.withColumn("ords", ords))


@query(f"""WITH {H}, t AS (SELECT request_id, hop, node_id, (hop - 1) // 3 AS f, (hop - 1) % 3 AS l, max(CASE WHEN relation = 'ControlledBy' THEN (hop - 1) % 3 END) OVER (PARTITION BY request_id, (hop - 1) // 3 ORDER BY hop) AS cut FROM h),
pair AS (SELECT a.request_id, a.node_id AS function, b.node_id, b.hop, coalesce(b.cut, -1) <= a.l AS spine FROM t a JOIN t b ON a.request_id = b.request_id AND a.f = b.f AND b.l > a.l WHERE a.node_id LIKE 'udf:%'),
held AS (SELECT request_id, function, node_id, min(CASE WHEN spine THEN hop END) AS first FROM pair WHERE function <> node_id GROUP BY 1, 2, 3),
shown AS (SELECT request_id, node_id FROM h WHERE hop = 3 UNION SELECT request_id, node_id FROM h WHERE (request_id, hop) NOT IN (SELECT (request_id, hop) FROM pair)),
opened AS (SELECT DISTINCT request_id, node_id FROM held WHERE request_id % 3 = 0 AND function = 'udf:dbo.F1')
SELECT request_id, function, node_id, CASE WHEN first IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY request_id, function ORDER BY first NULLS LAST) AS INT) END AS place, counted, counted AND opened.node_id IS NULL AS hidden
FROM (SELECT held.*, NOT (request_id % 3 = 0 AND function = 'udf:dbo.F1') AND shown.node_id IS NULL AS counted FROM held LEFT JOIN shown USING (request_id, node_id)) x LEFT JOIN opened USING (request_id, node_id)""")
def i1_members(spark, sf_dir):
    """Hops in chains of three; every third request has F1 unfolded, and the third hop's node is shown."""
    h = hops(spark, sf_dir)
    places = F.transform(F.sequence(F.col("hop") - (F.col("hop") - 1) % 3, F.col("hop")), lambda k: F.lpad(k.cast("string"), 6, "0"))
    unfolded = h.where("request_id % 3 = 0 AND node_id = 'udf:dbo.F1'").select("request_id", F.col("node_id").alias("function"))
    return client.fold_members(h.withColumn("ords", places), h.where("hop = 3"), unfolded)


@query(f"""WITH {H} SELECT DISTINCT request_id, 'lit' AS kind, node_id AS id FROM h UNION SELECT request_id, 'lit', 'edge:' || parent || '|' || relation || '|' || node_id FROM h
UNION SELECT request_id, 'path', 'sp:orders.' || CAST(request_id AS STRING) FROM h UNION SELECT request_id, 'lit', unnest(['page:p', parent]) FROM h WHERE relation = 'AliasOf'""")
def i10_highlights(spark, sf_dir):
    h = hops(spark, sf_dir)
    path = h.select("request_id", F.concat(F.lit("sp:orders."), F.col("request_id").cast("string")).alias("node_id"))
    return client.highlights(h, path, h.where("relation = 'AliasOf'").select("request_id", F.array(F.lit("page:p"), "parent").alias("path")))


@query(f"""WITH {H}, p AS (SELECT DISTINCT request_id, 0 AS phase, 1 AS at_, 'sp:x' AS nodes FROM h UNION ALL SELECT request_id, 1, -depth, string_agg(DISTINCT node_id, ',' ORDER BY node_id) FROM h GROUP BY request_id, depth)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY phase, at_) AS INT) AS step, nodes FROM p""")
def i2_replay(spark, sf_dir):
    h = hops(spark, sf_dir)
    path = h.select("request_id", F.lit(1).alias("seq"), F.lit("sp:x").alias("node_id")).distinct()
    return client.replay_plan(path, h).select("request_id", "step", F.array_join("nodes", ",").alias("nodes"))
