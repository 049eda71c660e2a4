"""One field's trace: where a value comes from. The walk itself is that of many requests, in walks.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators.shared import kept
from weft.operators.traverse import LINEAGE_RELATIONS
from weft.operators.walks import TRACE_DEPTH, TRACE_HOPS, Adjacency, links, recorded, walks

# Types a short field name is looked up in, in this order.
RESOLVED_TYPES = ["JsonField", "Field", "ResultColumn", "IntermediateColumn", "Column"]
MOST_CANDIDATES = 20  # that an ambiguous name lists


class AmbiguousField(ValueError):
    def __init__(self, text: str, candidates: list[str]):
        super().__init__(f"'{text}' is ambiguous: {', '.join(candidates)}")
        self.candidates = candidates


class FieldNotFound(LookupError):
    pass


def candidates(nodes: DataFrame, text: str) -> DataFrame:
    """(rank, id) of the nodes text may mean: 0 its id, 1 a JSON path, 2.. a leaf name in any case, by type."""
    text = text.strip()
    type_rank = ids.lookup({t: k + 2 for k, t in enumerate(RESOLVED_TYPES)}, F.col("type"))
    rank = F.when(F.col("id") == text, 0).when(F.col("id") == f"json:{text}", 1).when(F.lower(ids.leaf(F.col("id"))) == text.lower(), type_rank)
    return nodes.select(rank.alias("rank"), "id").where("rank is not null")


def resolve(nodes: DataFrame, text: str) -> str:
    """The one node of the first rank that has any; raises for none, or for several."""
    if not text or not text.strip():
        raise FieldNotFound("no field given")
    found = candidates(nodes, text)
    best = found.orderBy("rank", "id").limit(MOST_CANDIDATES).collect()  # the least of each task
    if not best:
        raise FieldNotFound(f"no field '{text}'")
    own = [r.id for r in best if r.rank == best[0].rank]
    if len(own) > 1:
        raise AmbiguousField(text, own)
    return own[0]


def resolved(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(text, status, n, id) of many names (text) at once: found with its one id, ambiguous with the number of candidates and the first, or not_found; as resolve() does for one."""
    text = names.select("text").distinct()
    wanted = text.select("text", F.trim("text").alias("said")).where(F.length(F.trim("text")) > 0)
    by_id = nodes.select("id", F.lit(0).alias("rank"), F.col("id").alias("said"))
    by_path = nodes.where(F.col("id").startswith("json:")).select("id", F.lit(1).alias("rank"), ids.owner_key(F.col("id")).alias("said"))
    type_rank = ids.lookup({t: k + 2 for k, t in enumerate(RESOLVED_TYPES)}, F.col("type"))
    by_leaf = nodes.where(F.col("type").isin(RESOLVED_TYPES)).select("id", type_rank.alias("rank"), F.lower(ids.leaf(F.col("id"))).alias("said"))
    exact = wanted.join(by_id.union(by_path), "said").select("text", "rank", "id")
    leaf = wanted.withColumn("said", F.lower("said")).join(by_leaf, "said").select("text", "rank", "id")
    ranks = exact.union(leaf).distinct().groupBy("text", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    best = ranks.groupBy("text").agg(F.min(F.struct("rank", "n", "id")).alias("b"))
    status = F.when(F.col("b").isNull(), "not_found").when(F.col("b.n") > 1, "ambiguous").otherwise("found")
    return text.join(best, "text", "left").select("text", status.alias("status"), F.coalesce("b.n", F.lit(0)).alias("n"), "b.id")


def hops(edges: DataFrame, nodes: DataFrame, root: str, depth: int = TRACE_DEPTH, budget: int = TRACE_HOPS, index: Adjacency | None = None) -> DataFrame:
    """The trace's hops below root: hop, parent, node_id, edge_id, relation, depth, is_repeat, fallback; in the order a walk meets them, budget at most."""
    one = edges.sparkSession.createDataFrame([(0, root)], "request_id int, root string")
    return walks(edges, nodes, one, depth, budget, index).where("hop > 0").select("hop", "parent", "node_id", "edge_id", "relation", "depth", "is_repeat", "fallback")


def with_lineage(found: DataFrame, edges: DataFrame, lineage: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """hops with transform, expression, condition and confidence of the record that explains them, and the ids of all that do; nodes tell what expressions produce."""
    rows = found if "fallback" in found.columns else found.withColumn("fallback", F.lit(False))
    rows = kept(rows)  # the hops of one trace: semi joins with them prune edges and lineage before these shuffle
    told = links(rows, nodes, edges, lineage).drop("evidence")
    return rows.join(told, ["parent", "node_id", "edge_id", "fallback"]).select("hop", "parent", "node_id", "edge_id", "relation", "depth", "is_repeat", "transform", "expression", "condition", "confidence", "lineage_ids")


def steps_with_lineage(edges: DataFrame, lineage: DataFrame) -> DataFrame:
    """(parent, node_id, edge_id, transform, expression, condition, confidence, lineage_ids) of every lineage edge from its source, as with_lineage() tells of a hop.

    All edges are asked for and bring their own confidence, so nothing is pruned or looked up: edges and lineage meet in one join."""
    condition = F.col("metadata")["condition"] if "metadata" in edges.columns else F.lit(None).cast("string")
    rows = edges.where(F.col("relation").isin(LINEAGE_RELATIONS)).select(
        F.col("src").alias("parent"), F.col("src").alias("l_output"), F.col("dst").alias("node_id"), "edge_id", "relation", F.lit(False).alias("fallback"), F.col("confidence").alias("edge_confidence"), condition.alias("edge_condition"))
    return recorded(rows, lineage, ["parent", "node_id", "edge_id"]).drop("evidence")


def dangling(lineage: DataFrame) -> DataFrame:
    """Records without a source: evidence always, an unknown unless literal."""
    return lineage.where("source is null").select("output", "lineage_id", (F.col("transform") != "Literal").alias("is_unknown"))


def trace_summaries(evidence: DataFrame) -> DataFrame:
    """(trace_id, evidence, scopes) of each run: how many rows it has, and its scopes in lower case, in order."""
    return evidence.groupBy("trace_id").agg(F.count(F.lit(1)).alias("evidence"), F.array_sort(F.collect_set(F.lower("scope"))).alias("scopes"))


def overlay(found: DataFrame, evidence: DataFrame, scope: str | None = None) -> DataFrame:
    """(node_id, evidence columns) of the observed values at the found nodes: of any scope, or of none and the given one in any case."""
    own = evidence if scope is None else evidence.where(F.col("scope").isNull() | (F.lower("scope") == scope.lower()))
    return own.join(found.select("node_id").distinct(), "node_id", "left_semi")


def node_values(evidence: DataFrame, node_id: str, trace_id: str, scope: str | None = None) -> DataFrame:
    """The observed values that one trace, in any case of its id, has at one node: of any scope, or of none and the given one in any case."""
    own = evidence.where((F.col("node_id") == node_id) & (F.lower("trace_id") == trace_id.lower()))
    return own if scope is None else own.where(F.col("scope").isNull() | (F.lower("scope") == scope.lower()))


def trace_sets(edges: DataFrame, nodes: DataFrame, lineage: DataFrame, root: str) -> DataFrame:
    """(kind, id): nodes of the trace with their containers, its edges with the containers' edges, unknowns and lineage evidence."""
    from weft.operators.traverse import containers

    found = kept(hops(edges, nodes, root).select("parent", "node_id", "edge_id"))
    own = kept(found.select("node_id").union(found.sparkSession.createDataFrame([(root,)], "node_id string")).distinct())
    held = kept(containers(edges.join(own.withColumnRenamed("node_id", "dst"), "dst", "left_semi")))
    every = kept(own.union(held.select("container")).distinct())
    contains = held.select(ids.edge_id(F.col("container"), F.lit("Contains"), F.col("node_id")).alias("id"))
    unknown = nodes.join(own.withColumnRenamed("node_id", "id"), "id", "left_semi").where("status <> 'Known'").select("id")
    inside = lineage.join(every.withColumnRenamed("node_id", "output"), "output", "left_semi").join(every.withColumnRenamed("node_id", "source"), "source", "left_semi").select("lineage_id")
    tag = lambda kind, df: df.distinct().select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("id"))
    return tag("node", every).union(tag("edge", found.select("edge_id").union(contains))).union(tag("unknown", unknown)).union(tag("lineage", inside))


def entry_point(edges: DataFrame, nodes: DataFrame, node_id: str) -> str | None:
    """Where a request enters: for a JSON field its API's first page, else the API; else the first page, else the first API."""
    from weft.operators.traverse import containers

    if node_id.startswith("json:"):
        api = containers(edges).where((F.col("node_id") == node_id) & F.col("container").startswith("api:")).select(F.col("container").alias("dst"))
        page = edges.where("relation = 'Calls'").where(F.col("src").startswith("page:")).join(api, "dst", "left_semi").agg(F.min_by("src", "edge_id")).first()[0]
        own = page or (api.first() or [None])[0]
        if own:
            return own
    first = nodes.where(F.col("type").isin("Page", "Api")).agg(F.min(F.when(F.col("type") == "Page", F.col("id"))), F.min(F.when(F.col("type") == "Api", F.col("id")))).first()
    return first[0] or first[1]
