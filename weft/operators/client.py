"""Shapes a client draws: folds, replays, visible nodes, trees, groups by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import ids


# Relations by which a value only decides a branch or a filter.
CONTROL = ["ControlledBy", "UsesParameter", "Reads"]


def below_functions(hops: DataFrame) -> DataFrame:
    """(request_id, function, node_id, ords, level, on_spine): the hops below each function that a trace goes on into.

    hops: request_id, node_id, ords (one hop each in a request) and, where there are any, relation and is_repeat. A hop finds those above it by the
    prefixes of its ords: a join on equal keys over hops times depth. A hop is on the spine if no control relation leads from the function to it.
    """
    repeat = F.col("is_repeat") if "is_repeat" in hops.columns else F.lit(False)
    control = F.coalesce(F.col("relation").isin(CONTROL), F.lit(False)) if "relation" in hops.columns else F.lit(False)
    function = F.when((ids.prefix(F.col("node_id")) == "udf") & ~repeat, F.col("node_id"))
    tops = hops.select("request_id", F.col("ords").alias("top"), function.alias("function"), control.alias("control")).where("function is not null or control")
    prefixes = F.transform(F.sequence(F.lit(0), F.size("ords")), lambda n: F.slice("ords", F.lit(1), n))
    met = hops.select("request_id", "node_id", "ords", F.explode(prefixes).alias("top")).join(tops, ["request_id", "top"])
    holder = F.when(F.col("function").isNotNull() & (F.size("top") < F.size("ords")), F.struct(F.size("top").alias("at"), "function"))
    each = met.groupBy("request_id", "node_id", "ords").agg(F.max(F.when(F.col("control"), F.size("top"))).alias("cut"), F.collect_list(holder).alias("holders"))
    rows = each.select("request_id", "node_id", "ords", F.coalesce("cut", F.lit(-1)).alias("cut"), F.explode("holders").alias("h"))
    return rows.select("request_id", "h.function", "node_id", "ords", (F.size("ords") - F.col("h.at")).alias("level"), (F.col("cut") <= F.col("h.at")).alias("on_spine"))


def fold_plan(hops: DataFrame) -> DataFrame:
    """For each function among hops (see below_functions): how many nodes lie below it and how deep."""
    return below_functions(hops).groupBy("request_id", "function").agg(F.countDistinct("node_id").alias("hidden"), F.max("level").alias("depth"))


def fold_members(hops: DataFrame, outside: DataFrame, unfolded: DataFrame) -> DataFrame:
    """(request_id, function, node_id, place, counted, hidden): the nodes that each function holds, itself left out.

    outside: (request_id, node_id) shown in any case, such as the field and the execution path; nodes of hops below no function are shown too.
    unfolded: (request_id, function). place: the node's rank on the function's spine in the order of a walk, null off it. counted: among
    the nodes a folded function tells; hidden: not drawn, as no unfolded function holds the node either.
    """
    from pyspark.sql import Window

    below = below_functions(hops)
    held = below.where("function <> node_id").groupBy("request_id", "function", "node_id").agg(F.min(F.when(F.col("on_spine"), F.col("ords"))).alias("first"))
    free = hops.join(below.select("request_id", "ords").distinct(), ["request_id", "ords"], "left_anti").select("request_id", "node_id")
    shown = outside.select("request_id", "node_id").union(free).distinct().withColumn("shown", F.lit(True))
    open_ = unfolded.select("request_id", "function").distinct().withColumn("open", F.lit(True))
    opened = held.join(open_, ["request_id", "function"], "left_semi").select("request_id", "node_id").distinct().withColumn("opened", F.lit(True))
    rows = held.join(open_, ["request_id", "function"], "left").join(shown, ["request_id", "node_id"], "left").join(opened, ["request_id", "node_id"], "left")
    rank = F.row_number().over(Window.partitionBy("request_id", "function").orderBy(F.col("first").asc_nulls_last()))  # the hops of one trace
    counted = F.col("open").isNull() & F.col("shown").isNull()
    return rows.select("request_id", "function", "node_id", F.when(F.col("first").isNotNull(), rank).alias("place"), counted.alias("counted"), (counted & F.col("opened").isNull()).alias("hidden"))


def highlights(hops: DataFrame, path: DataFrame, key_paths: DataFrame) -> DataFrame:
    """(request_id, kind, id), each once: nodes and edges that a trace's hops light, nodes of its execution path (request_id, node_id), nodes on an impact's key paths (request_id, path)."""
    lit = hops.select("request_id", F.lit("lit").alias("kind"), F.explode(F.array_compact(F.array("node_id", "edge_id"))).alias("id"))
    way = path.select("request_id", F.lit("path"), "node_id")
    return lit.union(way).union(key_paths.select("request_id", F.lit("lit"), F.explode("path"))).distinct()


def off_path_values(evidence: DataFrame, found: DataFrame, scope: str | None) -> DataFrame:
    """(node_id, event_id, scope, value): for each node that found (node_id) does not show yet its first observed value, by id, with no scope or exactly this one."""
    own = evidence.where(F.col("scope").isNull() | (F.col("scope") == F.lit(scope))).join(found.select("node_id").distinct(), "node_id", "left_anti")
    return own.groupBy("node_id").agg(F.min_by(F.struct("event_id", "scope", "value"), "event_id").alias("r")).select("node_id", "r.*")


def replay_plan(path: DataFrame, hops: DataFrame) -> DataFrame:
    """(request_id, step, nodes): the execution path node by node, then the hops' layers from the deepest to the field."""
    first = path.select("request_id", F.lit(0).alias("phase"), F.col("seq").alias("at"), F.array("node_id").alias("nodes"))
    layers = hops.groupBy("request_id", "depth").agg(F.array_sort(F.collect_set("node_id")).alias("nodes")).select("request_id", F.lit(1).alias("phase"), (-F.col("depth")).alias("at"), "nodes")
    from pyspark.sql import Window

    return first.union(layers).select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("phase", "at")).alias("step"), "nodes")


def visible_nodes(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> DataFrame:
    """Nodes (id) left when hidden relations are not drawn: a container that has edges but none of the drawn ones goes. Edges may be said several times."""
    drawn = edges.where(~F.col("relation").isin(hidden)).select(F.explode(F.array("src", "dst")).alias("id"))
    holds = edges.where("relation = 'Contains'").select(F.col("src").alias("id")).distinct()  # so each has edges
    gone = holds.join(drawn, "id", "left_anti")
    return nodes.join(gone, "id", "left_anti")


def tree_rows(paths: DataFrame) -> DataFrame:
    """(path, parent, name, depth, is_leaf) of every prefix of dotted paths (path)."""
    parts = F.split("path", r"\.")
    every = paths.select("path", parts.alias("parts")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.slice("parts", 1, n))).alias("p"))
    rows = every.select(F.array_join("p", ".").alias("node"), F.array_join(F.slice("p", 1, F.size("p") - 1), ".").alias("parent"), F.element_at("p", -1).alias("name"), F.size("p").alias("depth"), (F.array_join("p", ".") == F.col("path")).alias("is_leaf"))
    return rows.groupBy("node", "parent", "name", "depth").agg(F.max("is_leaf").alias("is_leaf"))


def tree_filter(rows: DataFrame, text: str) -> DataFrame:
    """tree_rows kept if the node or one below it has text in its name, in any case."""
    hits = rows.where(F.contains(F.lower("name"), F.lit(text.lower()))).select(F.split("node", r"\.").alias("p"))
    ups = hits.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), "."))).alias("node")).distinct()
    return rows.join(ups, "node", "left_semi")


def by_distance(affected: DataFrame) -> DataFrame:
    return affected.groupBy("distance").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_id"), F.countDistinct("relation").alias("n_relations"))


def live_values(evidence: DataFrame, scope: str) -> DataFrame:
    """For each node its first row (by id) with no scope or this one."""
    own = evidence.where(F.col("scope").isNull() | (F.lower("scope") == scope.lower()))
    return own.groupBy("node_id").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("r")).select("node_id", "r.event_id", "r.value")


def chip_nodes(items: DataFrame, chips: DataFrame) -> DataFrame:
    """(id, node_id) of evidence chips: the item's node, else the id itself unless it is an edge or a lineage record."""
    own = chips.join(items.select("id", F.col("node_id").alias("item_node")), "id", "left")
    return own.select("id", F.coalesce("item_node", F.when(~F.col("id").startswith("edge:") & ~F.col("id").startswith("lineage:"), F.col("id"))).alias("node_id"))


def scopes(evidence: DataFrame) -> DataFrame:
    """(scope, traces, fields): the scopes to choose from, with the runs and the fields that have values in them."""
    return evidence.where("scope is not null").groupBy("scope").agg(F.countDistinct("trace_id").alias("traces"), F.countDistinct("node_id").alias("fields"))
