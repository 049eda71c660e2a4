"""Runtime observations: nested captures flattened to evidence rows, scoped, gated, stored and audited."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators.shared import kept

ROW_LIMIT = 200
AUDIT_RING = 1000
SCOPE_KEY = "materialNumber"
SENSITIVE = frozenset(T.SENSITIVE_KEYS)
QUOTE, LITERALS = json.JSONEncoder(ensure_ascii=False).encode, {True: "true", False: "false", None: "null"}

CELL = "map<string,string>"
LEAVES = "array<struct<ord:array<int>,path:string,scope:string,value:string>>"
ITEMS = "array<struct<s:int,a:string,b:int,c:string,value:string,scope:string>>"
RESULTS = f"map<string,struct<durationMs:int,rowKey:string,returnColumn:string,rows:array<{CELL}>>>"


class Number(str):
    """The text of a JSON number."""


def _no_number(text: str):
    raise ValueError(text)


DECODE = json.JSONDecoder(object_pairs_hook=tuple, parse_int=Number, parse_float=Number, parse_constant=_no_number).decode


def _leaves(text: str | None, scope_key: str, places: list, ends: list, paths: list, scopes: list, values: list) -> None:
    """Adds place, path, scope and value of the scalars below the root of one document to the lists; ends says where a place ends in places, which is
    flat, as one tuple a leaf takes half of the time. Objects are tuples of members, so that repeated ones stay."""
    try:
        root = DECODE(text) if text else None
    except ValueError:
        return
    open_ = [("", None, (), False, iter(((0, root),)))]  # the root is opened as the only entry of nothing
    while open_:
        path, scope, at, keyed, rest = open_[-1]
        for n, value in rest:
            inner = path
            if keyed:
                key, value = value
                inner = f"{path}.{key}" if path else key
            kind = type(value)
            if kind is tuple:
                if len(open_) > 1 and not keyed:
                    scope = next((v for k, v in value if k == scope_key and type(v) is str), scope)
                value = [(k, v) for k, v in value if k.lower() not in SENSITIVE]
            elif kind is not list:
                if len(open_) > 1:
                    places.extend(at)
                    places.append(n)
                    ends.append(len(places))
                    paths.append(inner)
                    scopes.append(scope)
                    values.append(value if kind is Number else QUOTE(value) if kind is str else LITERALS[value])
                continue
            open_.append((inner, scope, (*at, n) if len(open_) > 1 else (), kind is tuple, enumerate(value)))
            break
        else:
            open_.pop()


def _utf8(text: str | None) -> str | None:
    """Half surrogate pairs, which JSON can escape and UTF-8 cannot hold, as question marks."""
    return text and text.encode("utf-8", "replace").decode()


def _strings(texts: list) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeError:
        return pa.array(map(_utf8, texts), pa.string())


def _leaves_of(texts: pa.Array, scope_key: str) -> pa.Array:
    """The leaves of each text, as columns; a text that is no JSON has none."""
    places, ends, paths, scopes, values, of_text = [], [0], [], [], [], [0]
    for text in texts.to_pylist():
        _leaves(text, scope_key, places, ends, paths, scopes, values)
        of_text.append(len(paths))
    place = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), pa.StructArray.from_arrays([place, _strings(paths), _strings(scopes), _strings(values)], ["ord", "path", "scope", "value"]))


def leaves_of(document: Column, scope_key: str = SCOPE_KEY) -> Column:
    """The leaves of a JSON text, in its order. Whole columns go to Spark as they are, not value by value."""

    def read(texts: pa.Array) -> pa.Array:
        return _leaves_of(texts, scope_key)

    return F.arrow_udf(read, LEAVES)(document)


def _utf8(text: str | None) -> str | None:
    """Half surrogate pairs, which JSON can escape and UTF-8 cannot hold, as question marks."""
    return text if not text or text.isascii() else text.encode("utf-8", "replace").decode()


def json_leaves(docs: DataFrame, column: str, scope_key: str = SCOPE_KEY) -> DataFrame:
    """docs' other columns with path, scope, ord and value (JSON text) of every scalar below the root of a JSON column, in document order.

    Array positions are not part of a path. An object inside an array whose scope_key is a string gives its subtree that scope.
    Sensitive members are left out, nulls and repeated members stay, empty containers give nothing, and so does what is no JSON.
    Numbers keep their text. A document is read once, within its task; no depth is left out and no round of joins is needed.
    """
    keys = [c for c in docs.columns if c != column]
    return docs.select(*keys, F.inline(leaves_of(F.col(column), scope_key))).select(*keys, "path", "scope", "ord", "value")


def scoped(row: Column, row_key: Column, entity_key: Column) -> Column:
    """The row's key value as its scope; none if it is the entity itself, in any case."""
    value = F.element_at(row, row_key)
    return F.when(F.lower(value) != F.lower(entity_key), value)


def result_rows(fixtures: DataFrame, column: str, limit: int = ROW_LIMIT) -> DataFrame:
    """(trace_id, entity_key, owner, duration, rows beyond the limit, and each row kept with its place, map and scope)."""
    each = fixtures.select("trace_id", "entity_key", F.explode(column).alias("owner", "r"))
    first = F.slice(F.col("r.rows"), 1, limit)
    return each.select(
        "trace_id", "entity_key", "owner", F.col("r.durationMs").alias("duration"), F.col("r.returnColumn").alias("return_column"), F.col("r.rowKey").alias("row_key"),
        F.greatest(F.size("r.rows") - limit, F.lit(0)).alias("beyond"), first.alias("rows"),
    )


def cells(fixtures: DataFrame, column: str = "procedureResults", limit: int = ROW_LIMIT) -> DataFrame:
    """Procedure rows unpivoted: trace_id, owner, row, name, value, scope."""
    rows = result_rows(fixtures, column, limit).select("*", F.posexplode("rows").alias("row", "cell"))
    return rows.select("trace_id", "owner", "row", scoped(F.col("cell"), F.col("row_key"), F.col("entity_key")).alias("scope"), F.explode("cell").alias("name", "value"))


def returns(fixtures: DataFrame, column: str = "functionResults", limit: int = ROW_LIMIT) -> DataFrame:
    """Function rows: the return column's value, rows without it skipped."""
    rows = result_rows(fixtures, column, limit).select("*", F.posexplode("rows").alias("row", "cell"))
    name = F.coalesce(F.nullif(F.trim("return_column"), F.lit("")), F.lit("ReturnValue"))
    return rows.where(F.map_contains_key("cell", name)).select("trace_id", "owner", "row", scoped(F.col("cell"), F.col("row_key"), F.col("entity_key")).alias("scope"), F.element_at("cell", name).alias("value"))


def read_response(fixtures: DataFrame, fixture_id: str, path: str) -> DataFrame:
    """(fixture_id, value) at a JSON path of the response of a capture, named in any case; null where the response lacks it."""
    own = fixtures.where(F.lower("fixture_id") == fixture_id.strip().lower())
    return own.select("fixture_id", F.get_json_object("response", path).alias("value"))


def _item(section: int, a: Column, b: Column, c: Column, value: Column, scope: Column) -> Column:
    return F.struct(F.lit(section).alias("s"), a.alias("a"), b.alias("b"), c.alias("c"), value.alias("value"), scope.alias("scope"))


def _or_none(items: Column) -> Column:
    return F.coalesce(items, F.array().cast(ITEMS))


def _results(f: Column, column: str, section: int, limit: int) -> Column:
    """The items of one capture's results: owners by name, timing first, rows in order, columns by name."""
    no_scope, none = F.lit(None).cast("string"), F.lit("")
    of_row = lambda e, cell: scoped(cell, e["r"]["rowKey"], f["entity_key"])

    def cells(e):
        rows = F.transform(F.slice(e["r"]["rows"], 1, limit), lambda cell, n: F.struct(n.alias("n"), F.sort_array(F.map_entries(cell)).alias("cell"), of_row(e, cell).alias("scope")))
        return F.flatten(F.transform(rows, lambda x: _or_none(F.transform(x["cell"], lambda c: _item(section, e["k"], x["n"], c["key"], c["value"], x["scope"])))))

    def values(e):
        name = F.coalesce(F.nullif(F.trim(e["r"]["returnColumn"]), F.lit("")), F.lit("ReturnValue"))
        rows = F.filter(F.transform(F.slice(e["r"]["rows"], 1, limit), lambda cell, n: F.struct(n.alias("n"), cell.alias("cell"))), lambda x: F.map_contains_key(x["cell"], name))
        return F.transform(rows, lambda x: _item(section, e["k"], x["n"], none, F.element_at(x["cell"], name), of_row(e, x["cell"])))

    def own(e):
        ms = e["r"]["durationMs"]
        timing = F.when(ms.isNotNull(), F.array(_item(section, e["k"], F.lit(-1), none, ms.cast("string"), no_scope)))
        return F.concat(_or_none(timing), _or_none(cells(e) if section == 1 else values(e)))

    named = F.transform(F.sort_array(F.map_keys(f[column])), lambda k: F.struct(k.alias("k"), F.element_at(f[column], k).alias("r")))
    return _or_none(F.flatten(F.transform(named, own)))


def by_trace(fixtures: DataFrame, limit: int = ROW_LIMIT, also: tuple[str, ...] = ()) -> DataFrame:
    """(trace_id, captures, items): a row for each trace, with its evidence as one array in bind()'s order.

    An item is section, owner, row, name, value and scope. A capture's own order is that of its evidence, so only several captures of one trace are
    sorted, and what is dealt by trace are the captures, which are far smaller than their evidence.
    """
    one = F.struct("entity_key", "systemParameters", "procedureResults", "functionResults", *also)
    read = fixtures.withColumn("leaves", leaves_of(F.col("response")))  # before they are dealt: what comes from Python has no known dealing
    each = read.groupBy("trace_id").agg(F.collect_list(one).alias("captures"), F.flatten(F.collect_list("leaves")).alias("leaves"))
    no_scope, none = F.lit(None).cast("string"), F.lit("")

    def items(f):
        named = F.transform(F.sort_array(F.map_entries(f["systemParameters"])), lambda p: _item(0, p["key"], F.lit(-1), none, p["value"], no_scope))
        return F.concat(_or_none(named), _results(f, "procedureResults", 1, limit), _results(f, "functionResults", 2, limit))

    each = each.select("trace_id", "captures", F.flatten(F.transform("captures", items)).alias("own"), "leaves")
    in_order = lambda c: F.when(F.size("captures") > 1, F.sort_array(c)).otherwise(F.col(c))
    return each.select("trace_id", "captures", F.concat(in_order("own"), F.transform(in_order("leaves"), lambda x: _item(3, none, F.lit(0), x["path"], x["value"], x["scope"]))).alias("items"))


def evidence_id(place: Column) -> Column:
    text = place.cast("string")
    return F.concat(F.lit("ev-"), F.when(place < 100, F.lpad(text, 3, "0")).otherwise(text))


def bind(fixtures: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """Evidence rows of captures (trace_id, entity_key, systemParameters, procedureResults, functionResults, response).

    Sections in order: parameters by name; procedures by name, timing first, rows in order, columns by name; functions alike; response
    leaves in document order. Ids count within a trace.
    """
    rows = by_trace(fixtures, limit).select("trace_id", F.posexplode_outer("items").alias("pos", "x")).where("pos is not null").select("trace_id", "pos", "x.*")  # a plain explode would build the arrays once more to filter by their size
    section, timing = F.col("s"), F.col("s").isin(1, 2) & (F.col("b") == -1)
    prefix = F.when(section == 0, "param:").when(section == 3, "json:").when(section == 2, "udf:").when(timing, "sp:").otherwise("spcol:")
    node = F.when(section == 3, F.col("c")).when((section == 1) & ~timing, F.concat("a", F.lit("."), "c")).otherwise(F.col("a"))
    kind = F.when(section == 0, "Parameter").when(section == 3, "ApiResponse").when(timing, "Timing").otherwise("QueryResult")
    label = F.when(section == 0, F.col("a")).when(timing, F.concat_ws(" ", "a", "value", F.lit("ms"))).otherwise(F.concat_ws(".", "scope", F.when(section == 2, F.col("a")).otherwise(F.col("c"))))
    return rows.select("trace_id", evidence_id(F.col("pos") + 1).alias("id"), section.alias("section"), F.concat(prefix, node).alias("node_id"), kind.alias("evidence_type"), "value", "scope", label.alias("label"))


def beyond_limit(fixtures: DataFrame, column: str = "procedureResults", limit: int = ROW_LIMIT) -> DataFrame:
    """(trace_id, owner, unknown) for results with more rows than are kept."""
    return result_rows(fixtures, column, limit).where("beyond > 0").select("trace_id", "owner", _beyond(F.col("beyond"), F.col("owner"), limit).alias("unknown"))


def _beyond(more: Column, owner: Column, limit: int) -> Column:
    return F.concat(more.cast("string"), F.lit(f" rows beyond the limit of {limit} were not captured: "), owner)


def unknown_texts(captures: Column, limit: int) -> Column:
    """beyond_limit's texts of all results of an array of captures."""
    cut = lambda f, column: F.transform(F.filter(F.map_entries(f[column]), lambda e: F.size(e["value"]["rows"]) > limit), lambda e: _beyond(F.size(e["value"]["rows"]) - limit, e["key"], limit))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(captures, lambda f: F.concat(F.coalesce(cut(f, "procedureResults"), none), F.coalesce(cut(f, "functionResults"), none))))


def allowed(environment: Column) -> Column:
    return F.coalesce(F.upper(environment).isin(T.ENVIRONMENTS), F.lit(False))


def by_entity(traces: DataFrame, key: str) -> DataFrame:
    return traces.where(F.lower("entity_key") == key.strip().lower())


def by_material(evidence: DataFrame, material: str) -> tuple[DataFrame, DataFrame]:
    """Evidence with no scope or the material's, under the trace id of both; and (trace_id) of traces that never saw the scope."""
    match = F.lower("scope") == material.strip().lower()
    seen = evidence.groupBy("trace_id").agg(F.count_if(match).alias("n"))
    own = evidence.where(F.col("scope").isNull() | match).withColumn("trace_id", F.concat("trace_id", F.lit(":"), F.lit(material.strip())))
    return own, seen.where("n = 0").select("trace_id")


def read_parameter(fixtures: DataFrame, name: str) -> DataFrame:
    """The parameter's value in the first allowed capture (by fixture_id) that has it."""
    has = fixtures.where(allowed(F.col("environment")) & F.map_contains_key("systemParameters", F.lit(name)))
    return has.select("fixture_id", "environment", F.element_at("systemParameters", F.lit(name)).alias("value")).orderBy("fixture_id").limit(1)


def latest_traces(saved: DataFrame) -> DataFrame:
    """Of several saves of a trace id, in any case, the last one; newest observation first, then by id."""
    last = saved.groupBy(F.lower("trace_id").alias("key")).agg(F.max_by(F.struct("trace_id", "observed_at"), "seq").alias("t"))
    return last.select("t.trace_id", "t.observed_at").orderBy(F.col("observed_at").desc(), "trace_id")


def recent_audit(audit: DataFrame, count: int, ring: int = AUDIT_RING) -> DataFrame:
    return audit.orderBy(F.col("seq").desc()).limit(min(max(count, 1), ring))


def tool_results(fixtures: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """(tool, key, environment, result): what the gateway's tools return for captures, as the JSON objects of each tool.

    trace_pick_order by entity: trace id, entity, environment, evidence count, unknowns. trace_material by entity/scope: the same with the scope
    and the evidence of it or of none. read_system_parameter by name: the value in the first allowed capture that has it, with its evidence id.
    read_pick_order_response by fixture: the response. Calls without a row here have no data.
    """
    each = by_trace(fixtures, limit, ("environment", "fixture_id"))
    # the scopes of a trace in order: a run of equal ones is a group, which begins where the one before differs; so no evidence row leaves its trace
    scopes = F.filter(F.transform("items", lambda x: F.struct(F.lower(x["scope"]).alias("key"), x["scope"].alias("shown"))), lambda x: x["key"].isNotNull())
    each = each.select(
        "trace_id", F.size("items").cast("long").alias("n"), F.sort_array(scopes).alias("scopes"), F.sort_array(unknown_texts(F.col("captures"), limit)).alias("unknowns"),
        F.transform("captures", lambda f: F.struct(f["entity_key"].alias("entity_key"), f["environment"].alias("environment"), f["fixture_id"].alias("fixture_id"))).alias("heads"),
        F.transform(F.filter("items", lambda x: x["s"] == 0), lambda x, k: F.struct(k.alias("k"), x["a"].alias("name"), x["value"].alias("value"))).alias("parameters"),
    )
    begins = F.filter(F.transform("scopes", lambda x, k: F.when((k == 0) | (F.get("scopes", k - 1)["key"] != x["key"]), k)), lambda k: k.isNotNull())
    each = each.withColumn("begins", begins)
    groups = F.transform("begins", lambda k, j: F.struct(F.get("scopes", k)["shown"].alias("shown"), (F.coalesce(F.get("begins", j + 1), F.size("scopes")) - k).cast("long").alias("n")))
    each = kept(each.select("trace_id", "heads", "unknowns", "n", (F.col("n") - F.size("scopes")).alias("free"), "parameters", groups.alias("groups")))
    own = each.select("trace_id", "unknowns", "n", "free", "groups", F.inline("heads"))
    head = [F.col("trace_id").alias("traceId"), F.col("entity_key").alias("entityKey")]
    orders = own.select(F.lit("trace_pick_order").alias("tool"), F.col("entity_key").alias("key"), "environment", F.to_json(F.struct(*head, "environment", F.col("n").alias("evidenceCount"), "unknowns")).alias("result"))
    scoped_ = own.select("trace_id", "entity_key", "environment", "unknowns", "free", F.inline("groups"))
    trace_of = F.concat_ws(":", "trace_id", "shown").alias("traceId")
    materials = scoped_.select(F.lit("trace_material"), F.concat_ws("/", "entity_key", "shown"), "environment", F.to_json(F.struct(trace_of, head[1], F.col("shown").alias("scope"), (F.col("n") + F.col("free")).alias("evidenceCount"), "unknowns")))
    seen = each.select("parameters", F.inline("heads")).where(allowed(F.col("environment"))).select("fixture_id", "environment", F.inline("parameters"))
    first = seen.groupBy("name").agg(F.min_by(F.struct("k", "value", "environment"), F.struct("fixture_id", "k")).alias("e"))
    parameters = first.select(F.lit("read_system_parameter"), "name", "e.environment", F.to_json(F.struct(evidence_id(F.col("e.k") + 1).alias("id"), F.concat(F.lit("param:"), "name").alias("nodeId"), F.col("e.value").alias("value"), F.col("e.environment").alias("environment"))))
    responses = fixtures.select(F.lit("read_pick_order_response"), "fixture_id", "environment", "response")
    return orders.union(materials).union(parameters).union(responses)


def invoke(calls: DataFrame, data: DataFrame) -> DataFrame:
    """Decisions over calls (seq, tool, arguments, key) with the data there is (tool, key, result, environment): one row for each call.

    outcome: denied by policy, access denied by environment, no data, or ok; with the audit id, reason and redacted arguments.
    """
    why = T.denial(F.col("tool"), F.col("arguments"))
    got = calls.withColumn("why", why).join(data.withColumnRenamed("environment", "env"), ["tool", "key"], "left")
    outcome = F.when(F.col("why").isNotNull(), "denied").when(F.col("env").isNull(), "no data").when(~allowed(F.col("env")), "access denied").otherwise("ok")
    return got.select(
        "seq", F.format_string("audit-%04d", F.col("seq")).alias("audit_id"), "tool", outcome.alias("outcome"), F.coalesce("why", F.when(outcome == "access denied", F.concat(F.lit("environment not allowed: "), "env"))).alias("reason"),
        F.when(outcome == "ok", F.col("result")).alias("result"), T.redact_members(F.col("arguments")).alias("arguments"),
    )
