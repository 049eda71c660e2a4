"""The service's entry points as plain functions over a graph's tables. Results are DataFrames, or small dicts of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import rules, runtime, trace, traverse
from weft.operators.bundles import Bundles, bundles
from weft.operators.index import Steps
from weft.operators.shared import kept
from weft.operators.walks import Adjacency, truncated
from weft.sources import snapshots


class NotFound(LookupError):
    status = 404


class Denied(PermissionError):
    status = 403


class BadArgument(ValueError):
    status = 400


@dataclass
class Service:
    """nodes, edges and lineage of the merged graph; evidence, traces and captures of runs; cases; the audit log."""

    nodes: DataFrame
    edges: DataFrame
    lineage: DataFrame
    evidence: DataFrame | None = None
    fixtures: DataFrame | None = None
    cases_: DataFrame | None = None
    audit_log: DataFrame | None = None
    notes: DataFrame | None = None
    index: Adjacency | None = None
    down: Steps | None = None
    out: Steps | None = None

    def indexed(self) -> Adjacency:
        """The adjacency of the graph, written once, sorted by node, and read by every trace after it."""
        if self.index is None:
            self.index = Adjacency.of(self.edges, self.nodes)
        return self.index

    def downstream(self) -> Steps:
        """The steps of a change, written once and read by every impact search after it."""
        self.down = self.down or Steps.of(traverse.downstream_view(self.edges))
        return self.down

    def outward(self) -> Steps:
        self.out = self.out or Steps.of(traverse.out_view(self.edges))
        return self.out

    def health(self) -> DataFrame:
        n = self.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("status") == "Unknown").alias("unknown"), F.count_if(F.col("status") == "Pending").alias("pending"))
        e = self.edges.agg(F.count(F.lit(1)).alias("edges"))
        return n.crossJoin(e)  # one row each

    def cases(self) -> DataFrame:
        return self.cases_.select("id", "title", "rootNodeId")

    def case(self, case_id: str) -> dict[str, DataFrame]:
        own = self.cases_.where(F.col("id") == case_id)
        if not own.limit(1).count():
            raise NotFound(case_id)
        fields, gaps = snapshots.case_overview(own, self.nodes)
        return {"fields": fields, "gaps": gaps}

    def node(self, node_id: str, trace_id: str | None = None, scope: str | None = None) -> DataFrame | dict[str, DataFrame]:
        """Details of a node; with a trace's id, those and the values observed in it (none for a trace that is not there)."""
        found = traverse.node_details(self.edges, self.nodes, self.lineage, node_id)
        if not found.limit(1).count():
            raise NotFound(node_id)
        if trace_id is None:
            return found
        return {"details": found, "values": trace.node_values(self.evidence, node_id, trace_id, scope)}

    def graph(self, root: str, depth: int = 3, columns: bool = True) -> dict:
        nodes, edges, cut = traverse.subgraph(self.edges, self.nodes, self._known(root), depth, columns)
        return {"nodes": nodes, "edges": edges.drop("d_src", "d_dst"), "truncated": cut}

    def architecture(self, root: str) -> dict[str, DataFrame]:
        nodes, edges = traverse.architecture(self.edges, self._known(root), self.outward())
        return {"nodes": nodes, "edges": edges}

    def search(self, text: str, limit: int = 20) -> DataFrame:
        if not text or not text.strip():
            raise BadArgument("no text")
        return traverse.search(self.nodes, text, limit)

    def trace_field(self, field: str, scope: str | None = None, trace_id: str | None = None) -> dict[str, DataFrame]:
        """root, hops (in the walk's order; shown: the order of display), sets (kind, id), execution_path, unknowns, truncated; with evidence also values: of the run, if one is given."""
        root, b = self._bundled(field, scope, trace_id)
        on = ["parent", "node_id", "edge_id", "fallback"]
        shown = b.hops.select(F.col("edge_id"), F.col("hop").alias("shown"), "node_id", "depth", "is_repeat")
        hops = b.found.where("hop > 0").join(b.links, on).join(shown, ["edge_id", "node_id", "depth", "is_repeat"])
        tag = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("id"))
        unknown = b.gaps.select("node_id").distinct()
        out = {
            "root": self.nodes.where(F.col("id") == root), "hops": hops.select("hop", "shown", "parent", "node_id", "edge_id", "relation", "depth", "is_repeat", "transform", "expression", "condition", "confidence", "lineage_ids"),
            "sets": tag("node", b.nodes.select("node_id")).union(tag("edge", b.edges.select("edge_id"))).union(tag("unknown", unknown)).union(tag("evidence", b.cited.select("id"))),
            "execution_path": b.path.select("seq", "node_id", "name", "type"), "unknowns": b.gaps.select("node_id", "name", "type", "reason"), "truncated": truncated(b.found).select("truncated"),
        }
        if self.evidence is not None:
            out["values"] = b.values if trace_id else trace.overlay(b.found.select("node_id"), self.evidence, scope)
        return out

    def _bundled(self, field: str, scope: str | None = None, trace_id: str | None = None, language: str = "en", investigate: bool = False, allowed: list[str] | None = None) -> tuple[str, Bundles]:
        try:
            root = trace.resolve(self.nodes, field)
        except trace.FieldNotFound as e:
            raise NotFound(str(e)) from e
        spark, evidence = self.nodes.sparkSession, self.evidence if trace_id else None
        if evidence is not None:
            evidence = evidence.withColumn("id", F.col("id" if "id" in evidence.columns else "event_id").cast("string"))
            evidence = evidence if "label" in evidence.columns else evidence.withColumn("label", F.lit(None).cast("string"))
            environment = evidence.where(F.lower("trace_id") == trace_id.lower()).agg(F.min(F.col("environment"))).first()[0] if "environment" in evidence.columns else None
        else:
            environment = None
        one = spark.createDataFrame([(0, root, trace_id, scope, environment, language, investigate)], "request_id int, root string, trace_id string, scope string, environment string, language string, investigate boolean")
        listed = spark.createDataFrame([(0, i) for i in allowed], "request_id int, id string") if allowed else None
        return root, bundles(one, self.nodes, self.edges, self.lineage, evidence, self.notes if trace_id else None, listed, self.indexed())

    def impact(self, node_id: str, max_depth: int = traverse.IMPACT_DEPTH) -> dict[str, DataFrame]:
        affected = kept(traverse.impact(self.edges, self.nodes, self._known(node_id), max_depth, steps=self.downstream()))
        return {"affected": affected, "summary": traverse.impact_summary(affected), "key_paths": traverse.key_paths(affected)}

    def impact_summary(self, node_id: str, language: str = "en") -> dict[str, DataFrame]:
        """What a change reaches, in words: facts of the key paths, unknowns on the way, and one row with verdict and confidence; summary counts by type."""
        affected = kept(traverse.impact(self.edges, self.nodes, self._known(node_id), steps=self.downstream()))
        facts, unknowns, head = rules.impact_explained(affected, self.nodes, node_id, language)
        return {"facts": facts, "unknowns": unknowns, "explanation": head, "summary": traverse.impact_summary(affected)}

    def traces(self) -> DataFrame:
        return trace.trace_summaries(self.evidence)

    def trace(self, trace_id: str) -> DataFrame:
        own = self.evidence.where(F.lower("trace_id") == trace_id.lower())
        if not own.limit(1).count():
            raise NotFound(trace_id)
        return own

    def pick_order(self, order: str, material: str | None = None) -> DataFrame:
        """Evidence rows of the captures of an order in an allowed environment, of one material's scope if given."""
        own = runtime.by_entity(self.fixtures, order)
        if not own.limit(1).count():
            raise NotFound(order)
        allowed = own.where(runtime.allowed(F.col("environment")))
        if not allowed.limit(1).count():
            raise Denied(order)
        rows = runtime.bind(allowed)
        return runtime.by_material(rows, material)[0] if material else rows

    def tools(self) -> list[str]:
        from weft.functions.text import TOOLS

        return list(TOOLS)

    def call_tools(self, calls: DataFrame, data: DataFrame) -> DataFrame:
        return runtime.invoke(calls, data)

    def audit(self, count: int = 50) -> DataFrame:
        return runtime.recent_audit(self.audit_log, min(max(count, 1), 500))

    def explain(self, field: str, language: str = "en", trace_id: str | None = None, scope: str | None = None, allowed: list[str] | None = None) -> DataFrame:
        """One row that explains a field: summary, steps, facts with the ids they cite, unknowns, next steps, verdict and confidence."""
        return self._bundled(field, scope, trace_id, language, False, allowed)[1].explained().narrative().drop("request_id")

    def investigate(self, field: str, scope: str | None = None, language: str = "en", trace_id: str | None = None, allowed: list[str] | None = None) -> dict[str, DataFrame]:
        """explain() with hypotheses for the value that the run shows; its parts as tables, too."""
        _, b = self._bundled(field, scope, trace_id, language, True, allowed)
        told = b.explained()
        parts = {"explanation": told.narrative(), "facts": told.facts, "hypotheses": told.hypotheses, "next_steps": told.next_steps, "verdict": told.verdicts}
        return {name: df.drop("request_id") for name, df in parts.items()} | ({"values": b.values} if b.values is not None else {})

    def _known(self, node_id: str) -> str:
        if not self.nodes.where(F.col("id") == node_id).limit(1).count():
            raise NotFound(node_id)
        return node_id
