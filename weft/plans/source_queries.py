"""Facts from source texts that the tables' rows are turned into: a procedure for each part, a class and a controller for each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import ids
from weft.functions.text import squeezed, truncated
from weft.operators.shared import kept
from weft.plans.registry import query
from weft.sources import bench_graph as g
from weft.sources import source_text as s
from weft.sources import token_rows

SQL_TEXTS = """SELECT 'p' || CAST(p_partkey AS STRING) AS path, CASE WHEN p_partkey % 11 = 0 THEN '-- nothing here' WHEN p_partkey % 13 = 0 THEN 'CREATE PROCEDURE dbo.Broken AS SELECT (1' ELSE
'/* ' || p_name || ' */ CREATE ' || CASE WHEN p_size % 2 = 0 THEN 'PROCEDURE' ELSE 'FUNCTION' END || ' [dbo].[Obj' || CAST(p_partkey AS STRING) || '] (@OrderNo int, @Zone nvarchar(10)) AS
BEGIN
  DECLARE @Enabled bit = dbo.AF_GetSystemParameterValue(''WMS_' || CAST(p_size AS STRING) || ''')  -- FROM dbo.NotRead
  IF @Enabled = 1 SELECT a.x, sales.Rate' || CAST(p_size % 5 AS STRING) || '(a.y) AS y FROM dbo.T' || CAST(p_size AS STRING) || ' a INNER JOIN [inv].[U' || CAST(p_size % 7 AS STRING) || '] u ON u.id = a.id WHERE a.note = ''FROM dbo.Quoted''
  INSERT INTO dbo.Log' || CAST(p_size % 3 AS STRING) || ' SELECT x FROM #tmp
  EXEC dbo.Next' || CAST(p_size % 4 AS STRING) || ' @OrderNo
END' END AS text FROM {part}"""

GOOD = "p_partkey % 11 <> 0 AND p_partkey % 13 <> 0"


def sql_texts(spark, sf_dir):
    return g.frame(spark, sf_dir, SQL_TEXTS)


@query(f"""WITH o AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'sp' ELSE 'udf' END || ':dbo.Obj' || CAST(p_partkey AS STRING) AS src, p_size AS z FROM part WHERE {GOOD})
SELECT src, 'Reads' AS relation, 'table:dbo.T' || CAST(z AS STRING) AS dst FROM o UNION ALL SELECT src, 'Reads', 'table:inv.U' || CAST(z % 7 AS STRING) FROM o UNION ALL SELECT src, 'CallsFunction', 'udf:dbo.AF_GetSystemParameterValue' FROM o
UNION ALL SELECT src, 'CallsFunction', 'udf:sales.Rate' || CAST(z % 5 AS STRING) FROM o UNION ALL SELECT src, 'ExecutesSp', 'sp:dbo.Next' || CAST(z % 4 AS STRING) FROM o UNION ALL SELECT src, 'UsesParameter', 'param:WMS_' || CAST(z AS STRING) FROM o""")
def a9_sql_scan(spark, sf_dir):
    return s.sql_edges(s.sql_objects(sql_texts(spark, sf_dir)))


@query(f"SELECT 'p' || CAST(p_partkey AS STRING) AS path, CASE WHEN p_size % 2 = 0 THEN 'sp' ELSE 'udf' END AS kind, 'dbo.Obj' || CAST(p_partkey AS STRING) AS name, '@OrderNo,@Zone' AS parameters, 'dbo.Log' || CAST(p_size % 3 AS STRING) AS writes FROM part WHERE {GOOD} UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'sp', 'dbo.Broken', '', '' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 = 0")
def f1_objects(spark, sf_dir):
    return s.sql_objects(sql_texts(spark, sf_dir)).select("path", "kind", "name", F.array_join("parameters", ",").alias("parameters"), F.array_join("writes", ",").alias("writes"))


@query("SELECT 'p' || CAST(p_partkey AS STRING) AS path, 'Error' AS severity, CASE WHEN p_partkey % 11 = 0 THEN 'empty file' ELSE 'brackets do not close' END AS message FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0")
def f2_diagnostics(spark, sf_dir):
    return s.diagnostics(sql_texts(spark, sf_dir))


@query(f"SELECT 'p' || CAST(p_partkey AS STRING) AS path, '@Enabled = 1' AS label FROM part WHERE {GOOD}")
def f26_branch_labels(spark, sf_dir):
    return s.branch_labels(sql_texts(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '/\\*[\\s\\S]*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents) x")
def f31_normalised_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", truncated(squeezed(F.col("text"))).alias("text"))


@query(f"SELECT 'WMS_' || CAST(p_size AS STRING) AS parameter, count(*) AS objects, count(DISTINCT p_size % 2) AS kinds FROM part WHERE {GOOD} GROUP BY 1")
def f30_parameter_usage(spark, sf_dir):
    rows = s.sql_objects(sql_texts(spark, sf_dir)).select("name", "kind", F.explode("variables").alias("parameter"))
    return rows.groupBy("parameter").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("kind").alias("kinds"))


CS_TEXTS = """SELECT 'c' || CAST(c_custkey AS STRING) AS path, 'namespace Demo; // class Hidden { }
public class Order' || CAST(c_custkey AS STRING) || ' { public int Number { get; set; } public List<Row' || CAST(c_custkey AS STRING) || '> Rows { get; set; } public string? URLPath { get; set; } public Row' || CAST(c_custkey AS STRING) || ' Main { get; set; } }
[Route("api/[controller]")] [ApiController] public class Pick' || CAST(c_nationkey AS STRING) || 'Controller { [HttpGet("orders/{id}")] public async Task<Order> GetOrder(int id) { return await _q.QueryAsync<Order' || CAST(c_custkey AS STRING) || '>("dbo.GetOrder' || CAST(c_custkey % 5 AS STRING) || '", p, commandType: CommandType.StoredProcedure); }
[HttpPost("/raw/[action]")] public Task Save(int id) { return _q.ExecuteAsync("[inv].[Save]", p); } }' AS text FROM {customer}"""


def cs_texts(spark, sf_dir):
    return g.frame(spark, sf_dir, CS_TEXTS)


@query("""WITH c AS (SELECT CAST(c_custkey AS STRING) AS k FROM customer) SELECT 'Order' || k AS model, field, kind, json_name, CASE WHEN type = 'Row' THEN 'Row' || k ELSE type END AS type FROM c, (VALUES ('Number', 'scalar', 'number', 'int'), ('Rows', 'collection', 'rows', 'Row'), ('URLPath', 'scalar', 'urlPath', 'string'), ('Main', 'model', 'main', 'Row')) f(field, kind, json_name, type)""")
def a10_cs_scan(spark, sf_dir):
    return s.cs_models(cs_texts(spark, sf_dir)).select("model", "field", "kind", "json_name", "type")


@query("SELECT DISTINCT 'Pick' || CAST(c_nationkey AS STRING) || 'Controller' AS controller, method, CASE method WHEN 'GetOrder' THEN 'api:GET /api/pick' || CAST(c_nationkey AS STRING) || '/orders/{id}' ELSE 'api:POST /raw/save' END AS api FROM customer, (VALUES ('GetOrder'), ('Save')) m(method)")
def h6_endpoints(spark, sf_dir):
    return s.cs_endpoints(cs_texts(spark, sf_dir)).distinct()


@query("SELECT 'c' || CAST(c_custkey AS STRING) AS path, 'Order' || CAST(c_custkey AS STRING) AS model, 'sp:dbo.GetOrder' || CAST(c_custkey % 5 AS STRING) AS procedure, 1.0 AS confidence FROM customer UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), NULL, 'sp:inv.Save', 0.8 FROM customer")
def h9_procedure_calls(spark, sf_dir):
    return s.cs_procedure_calls(cs_texts(spark, sf_dir))


@query("SELECT DISTINCT p_brand AS name, 'dbo.' || p_brand AS object FROM part")
def h14_object_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct()
    return part.select(F.col("p_brand").alias("name"), ids.normalised(F.lit(" "), F.concat(F.lit("["), "p_brand", F.lit("]"))).alias("object"))


# Models that nest and come back to their own type, one set a customer.
NESTED = """SELECT 'c' || CAST(c_custkey AS STRING) AS path, CAST(c_custkey AS STRING) AS k, c_custkey % 2 = 1 AS is_array, 'public class Order' || CAST(c_custkey AS STRING) || ' { public int Number { get; set; } public List<Row' || CAST(c_custkey AS STRING) || '> Rows { get; set; } }
public class Row' || CAST(c_custkey AS STRING) || ' { public string? PartName { get; set; } public Bin' || CAST(c_custkey AS STRING) || ' Bin { get; set; } public Order' || CAST(c_custkey AS STRING) || ' Back { get; set; } }
public class Bin' || CAST(c_custkey AS STRING) || ' { public Guid[] IDs { get; set; } }' AS text FROM {customer}"""


@query("""WITH c AS (SELECT CAST(c_custkey AS STRING) AS k FROM customer), e(src, relation, dst) AS (VALUES ('model:Order', 'Contains', 'field:Order?.Number'), ('model:Order', 'Contains', 'field:Order?.Rows'), ('model:Row', 'Contains', 'field:Row?.PartName'), ('model:Row', 'Contains', 'field:Row?.Bin'), ('model:Row', 'Contains', 'field:Row?.Back'), ('model:Bin', 'Contains', 'field:Bin?.IDs'),
('field:Order?.Rows', 'OfType', 'model:Row?'), ('field:Row?.Bin', 'OfType', 'model:Bin?'), ('field:Row?.Back', 'OfType', 'model:Order?'))
SELECT CASE WHEN relation = 'Contains' THEN src || k ELSE replace(src, '?', k) END AS src, relation, replace(dst, '?', k) AS dst FROM c, e""")
def h3_model_edges(spark, sf_dir):
    return s.cs_model_edges(s.cs_models(g.frame(spark, sf_dir, NESTED)))


@query("""WITH c AS (SELECT CAST(c_custkey AS STRING) AS k, CASE WHEN c_custkey % 2 = 1 THEN '$[]' ELSE '$' END AS root FROM customer), f(json_id, field, tail, expression) AS (VALUES ('json:number', 'field:Order?.Number', '.number', 'Number -> number (camelCase)'),
('json:rows.partName', 'field:Row?.PartName', '.rows[].partName', 'PartName -> partName (camelCase)'), ('json:rows.bin.iDs', 'field:Bin?.IDs', '.rows[].bin.iDs[]', 'IDs -> iDs (camelCase)'))
SELECT 'api:GET /orders/' || k AS api, json_id, replace(field, '?', k) AS field_id, root || tail AS json_path, expression, 0.95 AS confidence FROM c, f""")
def h7_response_fields(spark, sf_dir):
    texts = g.frame(spark, sf_dir, NESTED)
    roots = texts.select(F.concat(F.lit("api:GET /orders/"), "k").alias("api"), F.concat(F.lit("Order"), "k").alias("model"), "is_array")
    return s.response_fields(roots, s.cs_models(texts))


# A call in each class by a property that settings bind to a procedure, to something else, or not at all.
CONFIGURED = """SELECT 'c' || CAST(c_custkey AS STRING) AS path, 'public class Q { private readonly Site' || CAST(c_custkey AS STRING) || ' _site; public Task Run() { return _db.QueryAsync<Row>(_site.PickProcedure, p); } }' AS text,
'Site' || CAST(c_custkey AS STRING) || '.PickProcedure' AS name, CASE c_custkey % 3 WHEN 0 THEN '[inv].[Pick' || CAST(c_nationkey AS STRING) || ']' WHEN 1 THEN 'select 1' END AS value FROM {customer}"""


@query("""SELECT 'c' || CAST(c_custkey AS STRING) AS path, 'Site' || CAST(c_custkey AS STRING) || '.PickProcedure' AS said, CASE WHEN c_custkey % 3 = 0 THEN 'sp:inv.Pick' || CAST(c_nationkey AS STRING) END AS procedure, CASE WHEN c_custkey % 3 = 0 THEN 0.9 ELSE 0.5 END AS confidence FROM customer
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'Setting Site' || CAST(c_custkey AS STRING) || '.PickProcedure is no SQL object name: select 1', NULL, NULL FROM customer WHERE c_custkey % 3 = 1""")
def h10_configured(spark, sf_dir):
    texts = g.frame(spark, sf_dir, CONFIGURED)
    found, bad = s.cs_configured_calls(texts, texts.select("name", "value").where("value is not null"))
    return found.withColumnRenamed("key", "said").unionByName(bad.select("path", F.col("message").alias("said")), allowMissingColumns=True)


# A class that only holds values, a controller and a service for each customer.
METHODS = """SELECT 'c' || CAST(c_custkey AS STRING) AS path, '// class Hidden { public void No() { } }
public class Row' || CAST(c_custkey AS STRING) || ' { public int Id { get; set; } }
[Route("x")] public class Pick' || CAST(c_custkey AS STRING) || 'Api : Base {
  /// <summary>
  /// Reads the
  ///   rows.
  /// </summary>
  [HttpGet("rows")]
  public async Task<ActionResult<List<Row' || CAST(c_custkey AS STRING) || '>>> GetRows([FromQuery] int id, Dictionary<string, int> map = null) { if (id > 0) { return await Load(id); } return new Row(id) { }; }
  private static string Name(string? s) => s;
}
public class Store' || CAST(c_custkey AS STRING) || ' { public Store' || CAST(c_custkey AS STRING) || '(int n) { }
  internal Row' || CAST(c_custkey AS STRING) || '[] All() { return rows; }
  void Plain(int n,
    string s) { } }' AS text FROM {customer}"""


@query("""WITH c AS (SELECT CAST(c_custkey AS STRING) AS k FROM customer), m(class, method, return_type, parameters, accessibility, is_async, layer, description, returns) AS (VALUES
('Pick#Api', 'GetRows', 'Task<ActionResult<List<Row#>>>', 'int id, Dictionary<string, int> map', 'public', true, 'Api', 'Reads the rows.', 'model:Row#'), ('Pick#Api', 'Name', 'string', 'string? s', 'private', false, 'Api', NULL, NULL),
('Store#', 'All', 'Row#[]', '', 'internal', false, 'Service', NULL, 'model:Row#'), ('Store#', 'Plain', 'void', 'int n, string s', 'private', false, 'Service', NULL, NULL))
SELECT 'c' || k AS path, replace(class, '#', k) AS class, method, 'method:' || replace(class, '#', k) || '.' || method AS method_id, replace(return_type, '#', k) AS return_type, parameters, accessibility, is_async, layer, description, replace(returns, '#', k) AS returns FROM c, m""")
def h5_methods(spark, sf_dir):
    texts = g.frame(spark, sf_dir, METHODS)
    methods = kept(s.cs_methods(texts))  # read twice
    returns = s.cs_return_edges(methods, s.cs_models(texts)).select(F.col("src").alias("method_id"), F.col("dst").alias("returns"))
    return methods.join(returns, "method_id", "left")


# Nested branches around assignments, a procedure for each part: a third has an ELSE IF, quoted words and CASE inside try to mislead.
NESTED_SQL = """SELECT 'n' || CAST(p_partkey AS STRING) AS path, '/* IF 1 = 1 */ CREATE PROCEDURE dbo.N' || CAST(p_partkey AS STRING) || ' @Zone int AS
BEGIN
  DECLARE @Use bit = ' || CAST(p_size % 2 AS STRING) || ', @Other int, @Text nvarchar(20) = N''IF BEGIN END''
  IF EXISTS (SELECT 1 FROM dbo.T' || CAST(p_size AS STRING) || ' WHERE x = 1)
  BEGIN
    SET @Use = 1;
    IF @Zone = ' || CAST(p_size AS STRING) || '
    BEGIN
      BEGIN TRAN
      IF @Zone > 3 SET @Other = CASE WHEN @Zone = 4 THEN 5 ELSE 6 END
      ELSE SELECT @Other = MAX(f.y), @Use = 0 FROM dbo.F f WHERE @Zone = f.z
      COMMIT
    END
  END
' || CASE WHEN p_partkey % 3 = 0 THEN '  ELSE IF @Zone = 9 BEGIN SET @Use = NULL END
' ELSE '' END || '  ELSE BEGIN SET @Other = 8 END
END' AS text FROM {part}"""

NESTED_ROWS = """a AS (SELECT 'n' || CAST(p_partkey AS STRING) AS path, p_partkey AS k, 'EXISTS (SELECT 1 FROM dbo.T' || CAST(p_size AS STRING) || ' WHERE x = 1)' AS e, '@Zone = ' || CAST(p_size AS STRING) AS z, CAST(p_size % 2 AS STRING) AS first FROM part),
r AS (SELECT path, 1 AS n, '@Use' AS variable, 'declare' AS kind, first AS value, '' AS guards FROM a UNION ALL SELECT path, 2, '@Text', 'declare', 'N''IF BEGIN END''', '' FROM a UNION ALL SELECT path, 3, '@Use', 'set', '1', e FROM a
UNION ALL SELECT path, 4, '@Other', 'set', 'CASE WHEN @Zone = 4 THEN 5 ELSE 6 END', e || ' AND ' || z || ' AND @Zone > 3' FROM a UNION ALL SELECT path, 5, '@Other', 'select', 'MAX(f.y)', e || ' AND ' || z || ' AND NOT (@Zone > 3)' FROM a
UNION ALL SELECT path, 6, '@Use', 'select', '0', e || ' AND ' || z || ' AND NOT (@Zone > 3)' FROM a UNION ALL SELECT path, 7, '@Use', 'set', 'NULL', 'NOT (' || e || ') AND @Zone = 9' FROM a WHERE k % 3 = 0
UNION ALL SELECT path, 8, '@Other', 'set', '8', 'NOT (' || e || ')' || CASE WHEN k % 3 = 0 THEN ' AND NOT (@Zone = 9)' ELSE '' END FROM a)"""


@query(f"WITH {NESTED_ROWS} SELECT path, variable, kind, value, guards FROM r")
def f10_guarded_assignments(spark, sf_dir):
    """Guard stacks three deep, with NOT (label) under ELSE, around DECLARE, SET and SELECT of local variables (F3, F10, F18)."""
    rows = token_rows.sql_assignments(g.frame(spark, sf_dir, NESTED_SQL))
    return rows.select("path", "variable", "kind", "value", F.array_join("guards", " AND ").alias("guards"))


@query(f"WITH {NESTED_ROWS} SELECT path, variable, variable || ' = ' || string_agg(value || CASE WHEN guards <> '' THEN ' WHEN ' || guards ELSE '' END, ' -> ' ORDER BY n) AS note FROM r GROUP BY path, variable")
def f25_variable_notes(spark, sf_dir):
    return token_rows.variable_notes(token_rows.sql_assignments(g.frame(spark, sf_dir, NESTED_SQL)))


NESTED_CS = """SELECT 'm' || CAST(c_custkey AS STRING) AS path, 'public class Service' || CAST(c_custkey AS STRING) || ' { // if (Hidden) { Never(); }
  public async Task<Details> GetDetails(string no) {
    var order = await _query.GetHeader(no);
    if (order.IsMulti && order.Size > ' || CAST(c_nationkey AS STRING) || ') { rows = GetMulti(order); if (order.Note == ")}") Log("if (x) {"); }
' || CASE WHEN c_custkey % 2 = 0 THEN '    else if (order.IsSingle) rows = GetSingle(order);
' ELSE '' END || '    else { rows = GetRows(order); }
    return Build(rows);
  }
  public int Short(Order o) => Count(o);
}' AS text FROM {customer}"""

CS_CASES = """c AS (SELECT 'm' || CAST(c_custkey AS STRING) AS path, c_custkey % 2 = 0 AS two, 'order.IsMulti && order.Size > ' || CAST(c_nationkey AS STRING) AS multi, 'order.Note == ")}"' AS deep FROM customer)"""


@query(f"""WITH {CS_CASES} SELECT path, 'GetDetails' AS method, 'GetHeader' AS callee, CAST(NULL AS STRING) AS condition, CAST(NULL AS STRING) AS branch FROM c UNION ALL SELECT path, 'GetDetails', 'GetMulti', multi, 'then' FROM c UNION ALL SELECT path, 'GetDetails', 'Log', deep, 'then' FROM c
UNION ALL SELECT path, 'GetDetails', 'GetSingle', 'order.IsSingle', 'then' FROM c WHERE two UNION ALL SELECT path, 'GetDetails', 'GetRows', CASE WHEN two THEN 'order.IsSingle' ELSE multi END, 'else' FROM c UNION ALL SELECT path, 'GetDetails', 'Build', NULL, NULL FROM c UNION ALL SELECT path, 'Short', 'Count', NULL, NULL FROM c""")
def h13_guarded_calls(spark, sf_dir):
    return token_rows.cs_guarded_calls(g.frame(spark, sf_dir, NESTED_CS)).select("path", "method", "callee", "condition", "branch")


@query(f"""WITH {CS_CASES} SELECT path, 'GetDetails' AS method, 'IsMulti' AS member, multi AS condition, true AS has_else FROM c UNION ALL SELECT path, 'GetDetails', 'Size', multi, true FROM c UNION ALL SELECT path, 'GetDetails', 'Note', deep, false FROM c UNION ALL SELECT path, 'GetDetails', 'IsSingle', 'order.IsSingle', true FROM c WHERE two""")
def h12_branch_reads(spark, sf_dir):
    return token_rows.cs_branch_reads(g.frame(spark, sf_dir, NESTED_CS))


ARMS_SQL = """SELECT 'u' || CAST(p_partkey AS STRING) AS path, 'CREATE PROCEDURE dbo.U' || CAST(p_partkey AS STRING) || ' AS -- SELECT none, of, this
SELECT TOP 5 a.Number' || CAST(p_size AS STRING) || ', [Zone Name] = z.name, CASE WHEN a.x IN (1, 2) THEN ''p, q'' ELSE NULL END AS Kind FROM dbo.A a, dbo.Z z WHERE a.y IN (SELECT y, w FROM dbo.B)
UNION ALL SELECT b.no, (SELECT MAX(k), 2 FROM dbo.K), ''' || p_brand || ''' FROM (SELECT no, zone FROM dbo.B) b
' || CASE WHEN p_partkey % 2 = 0 THEN 'UNION SELECT ' || CAST(p_partkey AS STRING) || ', NULL, 3;
' ELSE '' END || 'SELECT DISTINCT COUNT(*) total' AS text FROM {part}"""


@query("""WITH p AS (SELECT 'u' || CAST(p_partkey AS STRING) AS path, CAST(p_partkey AS STRING) AS k, CAST(p_size AS STRING) AS z, p_brand AS b, p_partkey % 2 = 0 AS third FROM part)
SELECT path, CAST(1 AS INT) AS query, CAST(1 AS INT) AS position, 'Number' || z AS name, 'a.Number' || z || ' | b.no' || CASE WHEN third THEN ' | ' || k ELSE '' END AS items FROM p UNION ALL SELECT path, 1, 2, 'Zone Name', '[Zone Name] = z.name | (SELECT MAX(k), 2 FROM dbo.K)' || CASE WHEN third THEN ' | NULL' ELSE '' END FROM p
UNION ALL SELECT path, 1, 3, 'Kind', 'CASE WHEN a.x IN (1, 2) THEN ''p, q'' ELSE NULL END AS Kind | ''' || b || '''' || CASE WHEN third THEN ' | 3' ELSE '' END FROM p UNION ALL SELECT path, 2, 1, 'total', 'COUNT(*) total' FROM p""")
def f12_arms(spark, sf_dir):
    """Columns of queries with up to three arms, aligned by position and named by the first."""
    found = token_rows.sql_result_columns(token_rows.sql_arms(g.frame(spark, sf_dir, ARMS_SQL)))
    return found.select("path", "query", "position", "name", F.array_join("items", " | ").alias("items"))
