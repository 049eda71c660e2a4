"""Breadth-first queries over edges (src, relation, dst, edge_id, ...): level by level, a join of the frontier with the edges.

A level keeps, for each new node, the least key of the ways that reach it; a key is the array of edge ids from the
start, so comparing keys gives the order in which a queue would discover nodes, without numbering them.
Frontiers that were counted and are small are broadcast; others are joined as Spark sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators.index import Steps
from weft.operators.shared import forget, kept_at
from weft.schema import LAYERS, RELATIONS

SUBGRAPH_DEPTH, SUBGRAPH_NODES = 8, 400
IMPACT_DEPTH, IMPACT_NODES = 16, 500
KEY_PATHS = 12
BROADCAST_ROWS = 10_000
BARE_ROWS = 500_000  # of nodes without ways, some 100 bytes each in a broadcast
COMPACT = 8  # levels after which a search writes what it found as one table


def of_class(column: int):
    return [r[0] for r in RELATIONS if r[column]]


LINEAGE_RELATIONS, EXECUTION_RELATIONS, ARCHITECTURE_RELATIONS = of_class(2), of_class(3), of_class(4)


def relation_table(spark) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "relation string, direction string, is_lineage boolean, is_execution boolean, is_architecture boolean")


def flow_view(edges: DataFrame) -> DataFrame:
    """(edge_id, relation, up, down) of the directed edges: up is what down depends on."""
    way = (edges.src, edges.relation, edges.dst)
    return edges.select("edge_id", "relation", ids.upstream(*way).alias("up"), ids.downstream(*way).alias("down")).where("up is not null")


def downstream_view(edges: DataFrame) -> DataFrame:
    """flow_view with structural steps: a member reaches its container, a model the fields typed as it; and why."""
    way = (edges.src, edges.relation, edges.dst)
    up, down = F.coalesce(ids.upstream(*way), edges.dst), F.coalesce(ids.downstream(*way), edges.src)
    said = F.when(edges.relation == "Contains", "contains the changed member").when(edges.relation == "OfType", "is typed as the changed model")
    said = said.when(up == edges.src, F.concat(ids.verb(edges.relation), F.lit(" (data flows into it)"))).otherwise(F.concat(ids.verb(edges.relation), F.lit(" it")))
    return edges.select("edge_id", "relation", up.alias("up"), down.alias("down"), said.alias("reason"))


def undirected_view(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends; a loop once."""
    there = edges.select("edge_id", "relation", F.col("src").alias("up"), F.col("dst").alias("down"))
    return there.union(edges.where("src <> dst").select("edge_id", "relation", F.col("dst").alias("up"), F.col("src").alias("down")))


def out_view(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Each edge from its source, of these relations or of all."""
    own = edges if relations is None else edges.where(F.col("relation").isin(relations))
    return own.select("edge_id", "relation", F.col("src").alias("up"), F.col("dst").alias("down"))


def small(df: DataFrame, rows: int, limit: int = BARE_ROWS) -> DataFrame:
    """df, broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= limit else df


def breadth_first(steps: DataFrame | Steps, start: DataFrame, max_depth: int | None = None, cap: int | None = None, carry: tuple[str, ...] = (), by: tuple[str, ...] = (), until: DataFrame | None = None, ways: bool = True) -> tuple[DataFrame, bool]:
    """start: node. Rows (node, distance, parent, via, key, path, carry...) of all reached nodes; whether cap or depth cut it.

    steps: up, down, edge_id and the carried columns, which are those of the step that reached the node; a view is written first, an index is read as it
    is. max_depth None: until nothing is new. cap: nodes in all, the start too. A frontier of at most BROADCAST_ROWS rows, or BARE_ROWS without ways (each level is counted), is
    broadcast. by: columns of start that keep several searches apart; until: rows (by..., node) after whose last no level is searched. ways False: no key
    and no path, for searches in any order; a row then has the same size at every depth.
    """
    spark, paths = start.sparkSession, []
    at = [*by, "node"]
    if cap and not ways:
        raise ValueError("a cap needs the order of discovery")

    def keep(df):
        table, path = kept_at(df)
        paths.append(path)
        return table

    if not isinstance(steps, Steps):
        steps = Steps(keep(steps.select("up", "down", "edge_id", *carry)))
        near = lambda level, size: steps.table
    else:
        near = steps.near
    none = F.array().cast("array<string>")
    empty = [F.lit(None).cast(steps.table.schema[c].dataType).alias(c) for c in carry]
    kept_ways = ["key", "path"] if ways else []
    level = keep(start.select(*at, F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via"), *([none.alias("key"), F.array("node").alias("path")] if ways else []), *empty))
    found, count, depth, cut = level, level.count(), 0, False
    size = count
    open_ = until.count() if until is not None else None
    while max_depth is None or depth < max_depth:
        if until is not None:
            open_ -= until.join(level.select(*at), at, "left_semi").count()
            if not open_:
                break
        depth += 1
        front = level.select(*by, F.col("node").alias("up"), *kept_ways)
        front = small(front, size, BROADCAST_ROWS if ways else BARE_ROWS)
        grown = [F.concat("key", F.array("edge_id")).alias("key"), F.concat("path", F.array("down")).alias("path")] if ways else []
        least = F.struct("key", "parent", "via", "path", *carry) if ways else F.struct("via", "parent", *carry)
        new = (
            near(level, size).join(front, "up")
            .select(*by, F.col("down").alias("node"), F.col("up").alias("parent"), F.col("edge_id").alias("via"), *grown, *carry)
            .groupBy(*at).agg(F.min(least).alias("best"))
            .join(found.select(*at), at, "left_anti")
            .select(*at, F.lit(depth).alias("distance"), *[f"best.{c}" for c in ("parent", "via", *kept_ways, *carry)])
        )
        if cap:
            new = new.orderBy("key", "node").limit(cap - count + 1)  # one more shows the cut
        new = keep(new)
        size = new.count()
        if cap and size > cap - count:
            cut, size = True, cap - count
            new = new.orderBy("key", "node").limit(size)
        if not size:
            break
        found, level, count = found.union(new), new, count + size
        if cut:
            break
        if depth % COMPACT == 0:  # one table again, so that long chains do not grow the plan
            found = keep(found)
    else:
        cut = True
    out = kept_at(found)[0]
    forget(spark, paths)
    return out, cut


def impact(edges: DataFrame | None, nodes: DataFrame, origin: str, max_depth: int = IMPACT_DEPTH, cap: int | None = IMPACT_NODES, steps: Steps | None = None, ways: bool = True) -> DataFrame:
    """What a change of origin reaches: node_id, distance, parent, via_edge, reason, path and the node's type, name, layer; nearest first. steps: an index of downstream_view(edges).
    ways False: without path and order, so that a row has the same size at every depth and nothing is sorted."""
    depth = min(max(max_depth, 1), IMPACT_DEPTH)
    found, _ = breadth_first(steps or downstream_view(edges), nodes.sparkSession.createDataFrame([(origin,)], "node string"), depth, cap + 1 if cap else None, carry=("reason",), ways=ways)
    rank = layer_rank(F.col("layer"))
    reached = found.where("distance > 0")
    named = nodes.select(F.col("id").alias("node"), "type", "name", "layer").join(reached.select("node"), "node", "left_semi")  # few nodes then meet the join, not all
    rows = (
        reached.join(named, "node", "left")
        .select(F.col("node").alias("node_id"), "distance", "parent", F.col("via").alias("via_edge"), "reason", *(["path"] if ways else []), F.coalesce("type", ids.node_type(F.col("node"))).alias("type"), "name", F.coalesce("layer", ids.node_layer(F.col("node"))).alias("layer"))
    )
    return rows.orderBy("distance", rank, "node_id") if ways else rows


def layer_rank(layer: Column) -> Column:
    return F.coalesce(ids.lookup({x: k for k, x in enumerate(LAYERS)}, layer), F.lit(len(LAYERS)))


def impact_summary(affected: DataFrame) -> DataFrame:
    return affected.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def key_paths(affected: DataFrame, limit: int = KEY_PATHS) -> DataFrame:
    """Paths to pages, APIs and JSON fields, in that order, then by id."""
    order = ids.lookup({"Page": 0, "Api": 1, "JsonField": 2}, F.col("type"))
    return affected.where(order.isNotNull()).orderBy(order, "node_id").limit(limit)


def subgraph(edges: DataFrame, nodes: DataFrame, root: str, depth: int = 3, columns: bool = True, cap: int | None = SUBGRAPH_NODES) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (node_id, distance) and edges (with d_src and d_dst, their ends' distances) within depth steps of root, whichever way they point.

    An edge is kept if one of its ends was expanded: edges between two nodes at the last level are left out. Without columns
    no node that stands for a column is entered, but the root may be one. cap None: all nodes. The levels read edges where they are, which may say one
    edge several times; of those only what touches an expanded node is dealt.
    """
    depth = min(max(depth, 0), SUBGRAPH_DEPTH)
    spark = edges.sparkSession
    steps = undirected_view(edges)
    if not columns:
        steps = steps.where(~ids.is_column_level(F.col("down")))
    if cap is None:
        steps = steps.withColumn("edge_id", F.lit(None).cast("string"))  # no way is shown, so no id is made of all the edges that a level passes by
    found, cut = breadth_first(Steps(steps), spark.createDataFrame([(root,)], "node string"), depth, cap, ways=cap is not None) if depth else (spark.createDataFrame([(root, 0)], "node string, distance int"), False)
    at = found.select("node", "distance")
    sizes = {r.open: r["count"] for r in at.groupBy((F.col("distance") < depth).alias("open")).count().collect()}
    n, opened = sum(sizes.values()), at.where(F.col("distance") < depth)
    end = lambda df, c: df.select(F.col("node").alias(c), F.col("distance").alias(f"d_{c}"))
    rows = edges.select("edge_id", "src", "relation", "dst")
    for c in ("src", "dst"):
        rows = rows.join(small(opened.select(F.col("node").alias(c), F.lit(True).alias(f"open_{c}")), sizes.get(True, 0)), c, "left")
    near = rows.where("open_src or open_dst").select("edge_id", "src", "relation", "dst").distinct()
    ends = near.join(small(end(at, "src"), n), "src").join(small(end(at, "dst"), n), "dst")
    full = cut and cap is not None and n >= cap
    return at.select(F.col("node").alias("node_id"), "distance"), ends.select("edge_id", "src", "relation", "dst", "d_src", "d_dst"), full


def architecture(edges: DataFrame | None, root: str, index: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges reached from root along architecture relations, however far. index: one of out_view(edges)."""
    steps = (index or Steps.of(out_view(edges, ARCHITECTURE_RELATIONS))).along(ARCHITECTURE_RELATIONS)
    found, _ = breadth_first(steps, steps.table.sparkSession.createDataFrame([(root,)], "node string"), ways=False)
    at = found.select(F.col("node").alias("node_id"), "distance")
    return at, steps.table.join(at.select(F.col("node_id").alias("up")), "up", "left_semi").select("edge_id", F.col("up").alias("src"), "relation", F.col("down").alias("dst"))


def shortest_paths(edges: DataFrame | None, entry: str, index: Steps | None = None) -> DataFrame:
    """(target, distance, path) from entry to every node along execution relations; ties by discovery. index: one of out_view(edges)."""
    steps = index.along(EXECUTION_RELATIONS) if index else out_view(edges, EXECUTION_RELATIONS)
    found, _ = breadth_first(steps, (index.table if index else edges).sparkSession.createDataFrame([(entry,)], "node string"))
    return found.select(F.col("node").alias("target"), "distance", "path")


def execution_path(edges: DataFrame | None, entry: str, targets: DataFrame, index: Steps | None = None) -> DataFrame:
    """(step, node_id): shortest paths to the targets (target, seq), one after another by seq, each node where it first occurs."""
    rows = shortest_paths(edges, entry, index).join(targets, "target").select("seq", F.posexplode("path").alias("pos", "node_id"))
    first = rows.groupBy("node_id").agg(F.min(F.struct("seq", "pos")).alias("at")).select("node_id", "at.seq", "at.pos")
    return numbered(first, "seq", "pos").select(F.col("place").alias("step"), "node_id")


def numbered(rows: DataFrame, by: str, then: str) -> DataFrame:
    """rows with place, 1, 2, ... in the order of by, then: numbered within ranges of by, which go on from the counts of the ranges before."""
    dealt = kept_at(rows.repartitionByRange(by).sortWithinPartitions(by, then).withColumn("part", F.spark_partition_id()))[0]
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(by, then))
    return dealt.join(F.broadcast(before), "part").withColumn("place", (own + F.col("before")).cast("int")).drop("part", "before")


def containers(edges: DataFrame) -> DataFrame:
    """(node_id, container): the first Contains edge into a node, by edge id."""
    return edges.where("relation = 'Contains'").groupBy(F.col("dst").alias("node_id")).agg(F.min_by("src", "edge_id").alias("container"))


def node_details(edges: DataFrame, nodes: DataFrame, lineage: DataFrame, node_id: str) -> DataFrame:
    """Counts and ids around one node: edges in and out, distinct neighbours, lineage records as output and source, container, evidence ids in order."""
    near = edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    out, into = F.col("src") == node_id, F.col("dst") == node_id
    facts = near.select("edge_id", out.alias("is_out"), into.alias("is_in"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), F.when(into & (F.col("relation") == "Contains"), F.struct("edge_id", "src")).alias("held"))
    lin = lineage.where((F.col("output") == node_id) | (F.col("source") == node_id))
    each = facts.agg(
        F.count_if("is_in").alias("n_in"), F.count_if("is_out").alias("n_out"), F.countDistinct("other").alias("n_neighbours"), F.min("held").alias("held"),
        F.array_sort(F.collect_set(F.when(F.col("is_in"), F.col("edge_id")))).alias("in_ids"), F.array_sort(F.collect_set(F.when(F.col("is_out"), F.col("edge_id")))).alias("out_ids"),
    )
    own = lin.agg(F.count_if(F.col("output") == node_id).alias("n_as_output"), F.count_if(F.col("source") == node_id).alias("n_as_source"), F.array_sort(F.collect_set("lineage_id")).alias("lineage_ids"))
    ids_in_order = F.array_distinct(F.concat("in_ids", "out_ids", "lineage_ids"))
    return (
        nodes.where(F.col("id") == node_id).crossJoin(F.broadcast(each)).crossJoin(F.broadcast(own))  # one row each
        .select("id", "type", "name", "layer", "status", "n_in", "n_out", "n_neighbours", F.col("held.src").alias("container"), "n_as_output", "n_as_source", F.size(ids_in_order).alias("n_evidence"), F.sha2(F.array_join(ids_in_order, ","), 256).alias("evidence_hash"))
    )


def search(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes whose id, name or qualified name holds text in any case; short names first."""
    names = [F.col(c) for c in ("id", "name", "qualifiedName") if c in nodes.columns]
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))
    return nodes.where(hit).orderBy(F.length("name"), "id").limit(min(max(limit, 1), 100))


def missing_edges(expected: DataFrame, actual: DataFrame, prefixes: list[str] | None = None, relations: list[str] | None = None) -> DataFrame:
    """Expected edges that actual lacks, by id; only those from the given prefixes and relations."""
    if prefixes:
        expected = expected.where(ids.prefix(F.col("src")).isin(prefixes))
    if relations:
        expected = expected.where(F.col("relation").isin(relations))
    return expected.join(actual.select("edge_id"), "edge_id", "left_anti")


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges out of and into a node, in edge-id order within each side."""
    out = edges.where(F.col("src") == node_id).select(F.lit("out").alias("side"), "edge_id")
    into = edges.where(F.col("dst") == node_id).select(F.lit("in").alias("side"), "edge_id")
    return out.union(into)
