"""All queries; importing the modules registers them."""

from weft.plans import assembly_queries, explain_queries, graph_queries, relational_queries, rule_queries, runtime_queries, source_queries, walk_queries  # noqa: F401
