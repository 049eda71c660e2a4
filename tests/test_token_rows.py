"""Guards of calls and assignments in nested texts, from rows of tokens."""

from weft.sources import token_rows as t

CS = '''class Service {
  // if (Hidden) { Never(); }
  public async Task<Details> GetDetails(string no) {
    var order = await _query.GetHeader(no);
    if (order.IsMulti && order.Rows.Count > 0) { rows = GetMulti(order); if (order.Deep == ")}") Note("if (x) {"); }
    else if (order.IsSingle) rows = GetSingle(order);
    else { rows = GetRows(order); }
    int Local(int x) { return Twice(x); }
    return Build(rows);
  }
  public int Short(Order o) => Count(o);
}'''

SQL = """CREATE PROCEDURE dbo.P @Zone int AS
BEGIN
  DECLARE @Use bit = 0, @Other int, @Name nvarchar(10) = N'IF BEGIN'
  IF EXISTS (SELECT 1 FROM dbo.T WHERE x = 1)
  BEGIN
    SET @Use = 1
    IF @Zone = 2
    BEGIN
      BEGIN TRAN
      IF @Zone > 3 SET @Other = CASE WHEN @Zone = 4 THEN 5 ELSE 6 END
      ELSE SET @Other = 7
    END
    ELSE SELECT @Use = MAX(f.y), @Other = (SELECT 2) FROM dbo.F f WHERE @Zone = f.z
  END
  ELSE IF @Zone = 9 BEGIN SET @Use = NULL; END
  ELSE BEGIN SET @Use = 8 END
  SET @Other = 10 -- IF 1 = 1
END"""


def test_calls_with_their_innermost_guards(spark):
    files = spark.createDataFrame([("a", CS), ("b", None), ("c", ""), ("d", "class X { void M() { if (a) { F(); ")], "path string, text string")
    got = {(r.method, r.callee, r.condition, r.branch) for r in t.cs_guarded_calls(files).where("path = 'a'").collect()}
    multi, deep, single = "order.IsMulti && order.Rows.Count > 0", 'order.Deep == ")}"', "order.IsSingle"
    assert got == {
        ("GetDetails", "GetHeader", None, None), ("GetDetails", "GetMulti", multi, "then"), ("GetDetails", "Note", deep, "then"), ("GetDetails", "GetSingle", single, "then"), ("GetDetails", "GetRows", single, "else"),
        ("Local", "Twice", None, None), ("GetDetails", "Build", None, None), ("Short", "Count", None, None),
    }
    reads = {(r.method, r.member, r.condition, r.has_else) for r in t.cs_branch_reads(files).where("path = 'a'").collect()}
    assert reads == {("GetDetails", "IsMulti", multi, True), ("GetDetails", "Count", multi, True), ("GetDetails", "Deep", deep, False), ("GetDetails", "IsSingle", single, True)}
    assert t.cs_guarded_calls(files.limit(0)).count() == 0


def test_assignments_with_their_guards(spark):
    files = spark.createDataFrame([("p", SQL), ("q", None), ("r", "SELECT 1"), ("s", "BEGIN IF @a = 1 SET @b = (2")], "path string, text string")
    rows = t.sql_assignments(files)
    got = [(r.variable, r.kind, r.value, r.guards) for r in rows.where("path = 'p'").orderBy("i").collect()]
    exists = "EXISTS (SELECT 1 FROM dbo.T WHERE x = 1)"
    assert got == [
        ("@Use", "declare", "0", []), ("@Name", "declare", "N'IF BEGIN'", []), ("@Use", "set", "1", [exists]), ("@Other", "set", "CASE WHEN @Zone = 4 THEN 5 ELSE 6 END", [exists, "@Zone = 2", "@Zone > 3"]), ("@Other", "set", "7", [exists, "@Zone = 2", "NOT (@Zone > 3)"]),
        ("@Use", "select", "MAX(f.y)", [exists, "NOT (@Zone = 2)"]), ("@Other", "select", "(SELECT 2)", [exists, "NOT (@Zone = 2)"]), ("@Use", "set", "NULL", [f"NOT ({exists})", "@Zone = 9"]), ("@Use", "set", "8", [f"NOT ({exists})", "NOT (@Zone = 9)"]), ("@Other", "set", "10", []),
    ]
    notes = {r.variable: r.note for r in t.variable_notes(rows.where("path = 'p'")).collect()}
    assert notes["@Name"] == "@Name = N'IF BEGIN'" and notes["@Use"].startswith(f"@Use = 0 -> 1 WHEN {exists} -> MAX(f.y) WHEN {exists} AND NOT (@Zone = 2) -> NULL WHEN ")
    assert t.sql_assignments(files.limit(0)).count() == 0


ARMS = """CREATE PROCEDURE dbo.U AS
SELECT TOP 5 a.Number, [Zone Name] = z.name, CASE WHEN a.x IN (1, 2) THEN 'p, q' ELSE NULL END AS Kind, COUNT(*) total FROM dbo.A a, dbo.Z z WHERE a.y IN (SELECT y, w FROM dbo.B)
UNION ALL SELECT b.no, b.zone, 'x', 1 FROM (SELECT no, zone FROM dbo.B) b
EXCEPT SELECT 1, NULL, (SELECT MAX(k), 2 FROM dbo.K), 3;
SELECT DISTINCT @x AS only"""


def test_arms_by_position(spark):
    files = spark.createDataFrame([("u", ARMS), ("v", None), ("w", "no list here, at all")], "path string, text string")
    arms = t.sql_arms(files)
    got = [(r.query, r.arm, r.position, r.item, r.alias) for r in arms.orderBy("query", "arm", "position").collect()]
    assert [g[:4] for g in got] == [
        (1, 1, 1, "a.Number"), (1, 1, 2, "[Zone Name] = z.name"), (1, 1, 3, "CASE WHEN a.x IN (1, 2) THEN 'p, q' ELSE NULL END AS Kind"), (1, 1, 4, "COUNT(*) total"),
        (1, 2, 1, "b.no"), (1, 2, 2, "b.zone"), (1, 2, 3, "'x'"), (1, 2, 4, "1"), (1, 3, 1, "1"), (1, 3, 2, "NULL"), (1, 3, 3, "(SELECT MAX(k), 2 FROM dbo.K)"), (1, 3, 4, "3"), (2, 1, 1, "@x AS only"),
    ]
    columns = {(r.query, r.position): (r.name, r["items"]) for r in t.sql_result_columns(arms).collect()}
    assert columns[1, 1] == ("Number", ["a.Number", "b.no", "1"]) and columns[1, 2][0] == "Zone Name" and columns[1, 3][0] == "Kind" and columns[1, 4] == ("total", ["COUNT(*) total", "1", "3"]) and columns[2, 1][0] == "only"


def test_small_files_are_not_broadcast(spark):
    """The files of marks are far smaller than their rows, so no join may rest on their size."""
    files = spark.createDataFrame([("a", CS), ("b", CS)], "path string, text string")
    procedures = spark.createDataFrame([("p", SQL), ("u", ARMS)], "path string, text string")
    for rows in (t.cs_guarded_calls(files), t.cs_branch_reads(files), t.sql_assignments(procedures), t.sql_arms(procedures)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
