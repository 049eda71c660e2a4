"""Facts from T-SQL and C# text, by patterns over whole files: what a text defines, reads, calls and maps.

These are extractions with Spark's own regular expressions, one row in, facts out; there is no grammar here. Facts
that need name scopes or expression trees are out of reach on purpose (see the README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import ids
from weft.functions.text import squeezed
from weft.operators.shared import kept

NAME = r"(?:\[?(\w+)\]?\.)?\[?([#\w]+)\]?"

# Readers of system parameters, and the calls whose text argument names a procedure.
PARAMETER_READERS = ["AF_GetSystemParameterValue", "AF_GetSystemParameterValueInt", "AF_GetSystemParameterValueBit"]
QUERY_CALLS = ["Query", "QueryAsync", "QueryFirst", "QueryFirstAsync", "QueryFirstOrDefault", "QueryFirstOrDefaultAsync", "QuerySingle", "QuerySingleAsync", "QuerySingleOrDefault", "QuerySingleOrDefaultAsync", "QueryMultiple", "QueryMultipleAsync", "Execute", "ExecuteAsync", "ExecuteScalar", "ExecuteScalarAsync"]


PART_CHARS = 8_000_000  # of the texts that one task reads


def names(text: Column, before: str) -> Column:
    """Distinct normalised object names that follow the pattern before. The text is searched once; each find is then taken apart."""
    pattern = rf"(?i){before}{NAME}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: ids.normalised(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2))))


def sql_objects(files: DataFrame) -> DataFrame:
    """files (path, text): path, kind, name, parameters, and arrays reads, calls, executes, writes, variables of each CREATE text."""
    head = rf"(?i)CREATE (?:OR ALTER )?(PROCEDURE|PROC|FUNCTION) {NAME}"
    # each step is a column of its own: arrays take their inputs row by row without sharing, so a text would be squeezed anew for each use
    rows = dealt(files).select("path", squeezed(F.col("text")).alias("sql"))
    rows = rows.withColumns({"kind": F.upper(F.regexp_extract("sql", head, 1)), "own": ids.normalised(F.regexp_extract("sql", head, 2), F.regexp_extract("sql", head, 3)), "body": F.regexp_replace("sql", r"'[^']*'", "''")})
    body = F.col("body")
    # a comma between FROM items is not a WITH list, so only names with AS ( count
    ctes = F.transform(F.regexp_extract_all(body, F.lit(r"(?i)(?:WITH|,) (\w+)(?: ?\([^)]*\))? AS \("), F.lit(1)), lambda c: F.concat(F.lit("dbo."), c))
    found = rows.where("kind <> ''").withColumns({
        "written": names(body, r"(?:INSERT(?: INTO)?|UPDATE|DELETE FROM|INTO) "), "read": names(body, r"\b(?:FROM|JOIN|APPLY) "), "ctes": ctes, "executes": names(body, r"\bEXEC(?:UTE)? "),
        "called": F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b(\w+\.\w+) ?\("), F.lit(1))),
    })
    no_temporary = lambda c: F.filter(c, lambda n: ~F.contains(n, F.lit("#")))
    return found.select(
        "path", F.when(F.col("kind") == "FUNCTION", "udf").otherwise("sp").alias("kind"), F.col("own").alias("name"),
        F.array_distinct(F.regexp_extract_all(F.regexp_extract("sql", r"(?i)^.*?\bAS\b", 0), F.lit(r"(@\w+)"), F.lit(1))).alias("parameters"),
        F.array_except(no_temporary(F.array_except(F.array_except("read", "written"), "ctes")), "called").alias("reads"), F.array_except("called", F.array("own")).alias("calls"), "executes",
        no_temporary("written").alias("writes"),
        F.array_distinct(F.regexp_extract_all("sql", F.lit(rf"(?i)(?:{'|'.join(PARAMETER_READERS)})\s*\(\s*N?'([^']+)'"), F.lit(1))).alias("variables"),
    )


def sql_edges(objects: DataFrame) -> DataFrame:
    """(src, relation, dst) facts of sql_objects rows, all from one reading of each."""
    facts = [("reads", "Reads", "table:"), ("calls", "CallsFunction", "udf:"), ("executes", "ExecutesSp", "sp:"), ("variables", "UsesParameter", "param:")]
    none = F.array().cast("array<struct<relation:string,dst:string>>")
    each = [F.coalesce(F.transform(column, lambda n: F.struct(F.lit(relation).alias("relation"), F.concat(F.lit(prefix), n).alias("dst"))), none) for column, relation, prefix in facts]
    rows = objects.select(F.concat("kind", F.lit(":"), "name").alias("src"), F.concat(*each).alias("facts"))
    return rows.select("src", F.explode_outer("facts").alias("f")).where("f is not null").select("src", "f.*").distinct()


def diagnostics(files: DataFrame) -> DataFrame:
    """(path, severity, message) of texts that are empty, define nothing or leave brackets open; the scan of the others goes on."""
    bare = F.regexp_replace(squeezed(F.coalesce("text", F.lit(""))), r"'[^']*'", "")
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("("))) - (F.length(bare) - F.length(F.replace(bare, F.lit(")"))))
    message = F.when(bare == "", "empty file").when(opened != 0, "brackets do not close").when(~F.rlike(bare, F.lit(r"(?i)\bCREATE ")), "defines no object")
    return files.select("path", F.when(message == "defines no object", "Warning").otherwise("Error").alias("severity"), message.alias("message")).where("message is not null")


def branch_labels(files: DataFrame) -> DataFrame:
    """(path, label): conditions of IF and searched CASE branches, squeezed and cut to 120 characters."""
    from weft.functions.text import truncated

    text = squeezed(F.col("text"))
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)\bIF (@\w+ ?(?:=|<>|<|>) ?[^ ]+) "), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)\bWHEN (.+?) THEN"), F.lit(1)))
    return files.select("path", F.explode(F.array_distinct(found)).alias("label")).select("path", truncated(F.col("label")).alias("label"))


def json_name(name: Column) -> Column:
    """Camel case where a run of capitals at the start counts as one word (URLPath: urlPath)."""
    run = F.regexp_extract(name, r"^([A-Z]+)(?=[A-Z][a-z]|[^A-Za-z]|$)", 1)
    return F.when(F.length(run) > 0, F.concat(F.lower(run), F.substring(name, F.length(run) + 1, F.length(name)))).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, F.length(name))))


def cs_models(files: DataFrame) -> DataFrame:
    """(model, field, type, kind, json_name) of the public properties of each class without methods."""
    text = F.regexp_replace(F.col("text"), r"//[^\n]*", "")
    classes = files.select("path", F.explode(F.split(text, r"(?=\bclass\s+\w)")).alias("part")).where(F.rlike("part", F.lit(r"^class\s")))
    prop = r"public\s+(?:virtual\s+|required\s+)?([\w<>\[\]?.]+)\s+(\w+)\s*\{\s*get;"
    pairs = F.arrays_zip(F.regexp_extract_all("part", F.lit(prop), F.lit(1)).alias("type"), F.regexp_extract_all("part", F.lit(prop), F.lit(2)).alias("field"))
    rows = classes.where(~F.rlike("part", F.lit(r"public\s+[\w<>\[\]?., ]+\s+\w+\s*\("))).select(F.regexp_extract("part", r"^class\s+(\w+)", 1).alias("model"), F.explode(pairs).alias("p")).select("model", "p.field", "p.type")
    inner = F.regexp_replace(F.regexp_replace("type", r"^(?:Task|ActionResult|List|IList|IEnumerable|IReadOnlyList|Nullable)<(.+)>$", "$1"), r"\[\]$|\?$", "")
    scalar = inner.isin("string", "int", "long", "short", "byte", "bool", "decimal", "double", "float", "DateTime", "DateTimeOffset", "Guid", "object", "char")
    many = F.rlike("type", F.lit(r"^(?:List|IList|IEnumerable|IReadOnlyList)<|\[\]$"))
    return rows.select("model", "field", inner.alias("type"), F.when(many, "collection").when(scalar, "scalar").otherwise("model").alias("kind"), json_name(F.col("field")).alias("json_name"))


def cs_endpoints(files: DataFrame) -> DataFrame:
    """(controller, method, api) of attribute routes: [controller] and [action] filled in, a method route from / on its own."""
    text = F.regexp_replace(F.col("text"), r"//[^\n]*", "")
    classes = files.select(F.explode(F.split(text, r'(?=\[Route\("[^"]*"\)\]\s*(?:\[\w+\]\s*)*public\s+class)')).alias("part")).where(F.rlike("part", F.lit(r"\bclass\s+\w+Controller\b")))
    verb = r'\[Http(Get|Post|Put|Delete|Patch)(?:\("([^"]*)"\))?\]\s*public\s+[\w<>\[\]?., ]+\s+(\w+)\s*\('
    each = F.arrays_zip(*[F.regexp_extract_all("part", F.lit(verb), F.lit(k)).alias(n) for k, n in ((1, "verb"), (2, "route"), (3, "method"))])
    rows = classes.select(F.regexp_extract("part", r"class\s+(\w+)Controller", 1).alias("name"), F.regexp_extract("part", r'^\[Route\("([^"]*)"\)\]', 1).alias("base"), F.explode(each).alias("e"))
    full = F.when(F.col("e.route").startswith("/") | F.col("e.route").startswith("~/"), F.regexp_replace("e.route", "^~", "")).otherwise(F.concat_ws("/", F.nullif("base", F.lit("")), F.nullif("e.route", F.lit(""))))
    filled = F.replace(F.replace(full, F.lit("[controller]"), F.lower("name")), F.lit("[action]"), F.lower("e.method"))
    return rows.select(F.concat("name", F.lit("Controller")).alias("controller"), F.col("e.method").alias("method"), ids.route_id(F.col("e.verb"), filled).alias("api"))


def cs_procedure_calls(files: DataFrame) -> DataFrame:
    """(path, model, procedure, confidence): calls of QUERY_CALLS with a literal name, 1.0 where the text says it is a procedure, else 0.8."""
    call = rf'\.(?:{"|".join(QUERY_CALLS)})(?:<([\w.]+)>)?\s*\(\s*"([\w.\[\]]+)"([^;]*);'
    each = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(call), F.lit(k)).alias(n) for k, n in ((1, "model"), (2, "name"), (3, "rest"))])
    rows = files.select("path", F.explode(each).alias("c"))
    last, owner = F.substring_index("c.name", ".", -1), F.when(F.contains("c.name", F.lit(".")), F.substring_index("c.name", ".", 1)).otherwise(F.lit(""))
    return rows.select("path", F.nullif("c.model", F.lit("")).alias("model"), F.concat(F.lit("sp:"), ids.normalised(owner, last)).alias("procedure"), F.when(F.contains("c.rest", F.lit("CommandType.StoredProcedure")), 1.0).otherwise(0.8).alias("confidence"))


# Types that stand for what they hold.
WRAPPERS = ["Task", "ValueTask", "ActionResult", "Ok", "OkObjectResult", "List", "IList", "IEnumerable", "ICollection", "IReadOnlyList", "IReadOnlyCollection", "HashSet", "ISet", "Nullable"]


def unwrapped(type_: Column, depth: int = 4) -> Column:
    """The type inside wrappers, arrays and nullable marks."""
    for _ in range(depth):
        type_ = F.regexp_replace(F.regexp_replace(type_, r"(?:\[\]|\?)+$", ""), rf"^(?:{'|'.join(WRAPPERS)})<(.+)>$", "$1")
    return F.regexp_replace(type_, r"(?:\[\]|\?)+$", "")


def dealt(files: DataFrame) -> DataFrame:
    """(path, text) of texts, dealt by path over as many parts as the texts need: their files may be one small split, and Spark would merge such small parts."""
    own = files.where("text is not null").select("path", "text")
    size = own.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return own.repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_CHARS), "path")


def cs_methods(files: DataFrame) -> DataFrame:
    """(path, class, method, method_id, return_type, parameters, accessibility, is_async, layer, description) of the methods of each class.

    A method without an access word is private; the description is its documentation's summary on one line. Constructors are none;
    local functions count as methods, and tuples as return types are not seen.
    """
    parts = F.split(F.regexp_replace(F.col("text"), r"(?<!/)//(?!/)[^\n]*", ""), r"(?=\bclass\s+\w)")
    each = dealt(files).select("path", parts.alias("parts")).select("path", F.explode(F.transform("parts", lambda p, k: F.struct(p.alias("part"), F.get("parts", k - 1).alias("before")))).alias("c"))
    marked = r"\[(?:ApiController|Route)\b[^\]]*\]\s*(?:\[[^\]]*\]\s*)*(?:\w+\s+)*$"
    controller = F.rlike("c.part", F.lit(r"^class\s+\w*Controller\b|^class\s+\w+(?:<[^>]*>)?\s*:\s*(?:[\w<>]+,\s*)*Controller(?:Base)?\b")) | F.coalesce(F.rlike("c.before", F.lit(marked)), F.lit(False))
    access = r"public|private|protected|internal"
    word = rf"{access}|static|virtual|override|async|sealed|abstract|new|extern|unsafe|partial"
    no_type = rf"{word}|return|await|else|throw|using|case|in|is|as|and|or|not|when|var|goto|yield|class|get|set"
    generic = r"<(?:[^<>(){};]++|<(?:[^<>(){};]++|<[^<>(){};]*>)*>)*>"
    pattern = (
        rf"((?:[ \t]*///[^\n]*\n)*)\s*(?:\[[^\]\n]*\]\s*)*(?<![\w.])((?:(?:{word})\s+)*)((?!(?:{no_type})\b)[\w.]+(?:{generic})?\??(?:\[\])?\??)\s+"
        rf"((?!(?:if|for|foreach|while|switch|catch|lock|using|async)\b)\w+)\s*(?:<[\w, ]+>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:where [^{{;=]+)?(?:\{{|=>|;)"
    )
    found = F.arrays_zip(*[F.regexp_extract_all("c.part", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "doc"), (2, "words"), (3, "type"), (4, "method"), (5, "parameters"))])
    rows = each.where(F.rlike("c.part", F.lit(r"^class\s"))).select("path", F.regexp_extract("c.part", r"^class\s+(\w+)", 1).alias("class"), controller.alias("controller"), F.explode(found).alias("m"))
    plain = F.trim(F.regexp_replace("m.parameters", r"\s+", " "))
    for noise in (r"(^|, ?)\[[^\]]+\] ?", r"() ?= ?[^,]+", r"(^|, ?)(?:this|ref|out|in|params) "):
        plain = F.regexp_replace(plain, noise, "$1")
    said = F.split(F.regexp_extract("m.doc", r"(?s)<summary>(.*?)</summary>", 1), "\n")
    summary = F.array_join(F.filter(F.transform(said, lambda line: F.trim(F.regexp_replace(F.trim(line), "^/+", ""))), lambda line: line != ""), " ")
    has = lambda name: F.rlike("m.words", F.lit(rf"\b{name}\b"))
    first = F.nullif(F.regexp_extract("m.words", rf"\b({access})\b", 1), F.lit(""))
    seen = F.when(has("protected") & has("internal"), "protectedorinternal").when(has("protected") & has("private"), "protectedandinternal").otherwise(F.coalesce(first, F.lit("private")))
    return rows.select(
        "path", "class", "m.method", F.concat_ws(".", F.concat(F.lit("method:"), "class"), "m.method").alias("method_id"), F.regexp_replace("m.type", r"\s+", " ").alias("return_type"), plain.alias("parameters"),
        seen.alias("accessibility"), has("async").alias("is_async"), F.when(F.col("controller"), "Api").otherwise("Service").alias("layer"), F.nullif(summary, F.lit("")).alias("description"),
    )


def cs_return_edges(methods: DataFrame, models: DataFrame) -> DataFrame:
    """(src, relation, dst, declared_type): cs_methods rows whose return type, unwrapped, is one of the models (model)."""
    rows = methods.select(F.col("method_id").alias("src"), unwrapped(F.col("return_type")).alias("model"), F.col("return_type").alias("declared_type"))
    return rows.join(models.select("model").distinct(), "model").select("src", F.lit("Returns").alias("relation"), F.concat(F.lit("model:"), "model").alias("dst"), "declared_type").distinct()


def cs_model_edges(models: DataFrame) -> DataFrame:
    """(src, relation, dst) of cs_models rows: each model contains its fields, and a field is of the model its type names, if there is one."""
    own, field = F.concat(F.lit("model:"), "model"), F.concat_ws(".", F.concat(F.lit("field:"), "model"), "field")
    known = models.select(F.col("model").alias("type")).distinct()
    typed = models.join(known, "type").select(field.alias("src"), F.lit("OfType").alias("relation"), F.concat(F.lit("model:"), "type").alias("dst"))
    return models.select(own.alias("src"), F.lit("Contains").alias("relation"), field.alias("dst")).union(typed).distinct()


def response_fields(roots: DataFrame, models: DataFrame) -> DataFrame:
    """(api, json_id, field_id, json_path, expression, confidence): the JSON fields that responses serialise to.

    roots: api, model, is_array. A member whose type is a model is opened in its place, unless it is open already, so that recursive types end.
    A round is one join of the open members with the models; there are as many as models nest.
    """
    named = models.select(F.col("model").alias("type"), "field", F.col("type").alias("inner"), "json_name", (F.col("kind") == "collection").alias("many")).distinct()
    known = models.select(F.col("model").alias("inner"), F.lit(True).alias("opens")).distinct()
    named = kept(named.join(known, "inner", "left"))
    open_ = roots.select("api", F.lit("").alias("path"), F.when(F.col("is_array"), "$[]").otherwise("$").alias("json_path"), F.col("model").alias("type"), F.array("model").alias("seen"))
    leaves = None
    while True:
        members = kept(open_.join(named, "type").select(
            "api", F.concat_ws(".", F.nullif("path", F.lit("")), "json_name").alias("path"), F.concat("json_path", F.lit("."), "json_name", F.when(F.col("many"), "[]").otherwise("")).alias("json_path"),
            F.concat(F.lit("field:"), "type", F.lit("."), "field").alias("field_id"), F.concat("field", F.lit(" -> "), "json_name", F.lit(" (camelCase)")).alias("expression"), "inner", "opens", "seen",
        ))
        found = members.where("opens is null").select("api", F.concat(F.lit("json:"), "path").alias("json_id"), "field_id", "json_path", "expression", F.lit(0.95).alias("confidence"))
        leaves = found if leaves is None else leaves.union(found)
        open_ = members.where("opens").where(~F.array_contains("seen", F.col("inner"))).select("api", "path", "json_path", F.col("inner").alias("type"), F.concat("seen", F.array("inner")).alias("seen"))
        if open_.isEmpty():
            return leaves


def cs_configured_calls(files: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of QUERY_CALLS whose procedure is a property of a member (_site.PickProcedure), by the value that settings (name, value) bind to Type.Property.

    Found: (path, key, procedure, confidence): 0.9 for a value that names an SQL object, 0.5 and no procedure where none is bound.
    Warnings: (path, message) of values that are no object names. The member's type is what its declaration in the same text says.
    """
    call = rf'\.(?:{"|".join(QUERY_CALLS)})(?:<[\w.]+>)?\s*\(\s*(\w+)\.(\w+)\s*[,)]'
    each = F.arrays_zip(F.regexp_extract_all("text", F.lit(call), F.lit(1)).alias("member"), F.regexp_extract_all("text", F.lit(call), F.lit(2)).alias("property"))
    member = r"\b(?:private|protected|public|internal)\s+(?:static\s+)?(?:readonly\s+)?(\w+)\s+(\w+)\s*;"
    types = F.arrays_zip(F.regexp_extract_all("text", F.lit(member), F.lit(2)).alias("member"), F.regexp_extract_all("text", F.lit(member), F.lit(1)).alias("type"))
    rows = files.select("path", F.explode(each).alias("c"), types.alias("types"))
    of = F.get(F.filter("types", lambda t: t["member"] == F.col("c.member")), F.lit(0))["type"]
    rows = rows.select("path", F.concat_ws(".", F.coalesce(of, "c.member"), "c.property").alias("key")).join(settings.select(F.col("name").alias("key"), "value"), "key", "left")
    object_ = r"^\s*(?:\[?(\w+)\]?\.)?\[?(\w+)\]?\s*$"
    good = F.rlike("value", F.lit(object_))
    name = F.when(good, F.concat(F.lit("sp:"), ids.normalised(F.regexp_extract("value", object_, 1), F.regexp_extract("value", object_, 2))))
    found = rows.select("path", "key", name.alias("procedure"), F.when(good, 0.9).otherwise(0.5).alias("confidence"))
    bad = rows.where(F.col("value").isNotNull() & ~good).select("path", F.concat(F.lit("Setting "), "key", F.lit(" is no SQL object name: "), "value").alias("message"))
    return found, bad
