"""The evidence graph's vocabulary and row types."""

from __future__ import annotations

# Relations with their direction, and which traversals follow them.
RELATIONS = [
    # relation, direction, lineage, execution path, architecture
    ("Contains", "Structural", False, False, False),
    ("OfType", "Structural", False, False, False),
    ("HandledBy", "DependsOn", False, True, True),
    ("Calls", "DependsOn", False, True, True),
    ("ExecutesSp", "DependsOn", False, True, True),
    ("EnrichedBy", "DependsOn", True, True, False),
    ("BranchesOn", "DependsOn", False, False, True),
    ("UsesParameter", "DependsOn", False, False, True),
    ("Reads", "DependsOn", False, False, True),
    ("CallsFunction", "DependsOn", False, True, True),
    ("ComputedBy", "DependsOn", True, False, False),
    ("AliasOf", "DependsOn", True, False, False),
    ("DerivedFrom", "DependsOn", True, False, False),
    ("ControlledBy", "DependsOn", True, False, False),
    ("DependsOn", "DependsOn", False, False, False),
    ("Returns", "FlowsTo", False, False, True),
    ("MapsTo", "FlowsTo", True, False, False),
    ("SerializesAs", "FlowsTo", True, False, False),
    ("Produces", "FlowsTo", True, False, False),
]

# Id prefixes with the node type and layer they stand for.
PREFIXES = [
    ("page", "Page", "Web"),
    ("json", "JsonField", "Web"),
    ("api", "Api", "Api"),
    ("method", "Method", "Service"),
    ("model", "Model", "Api"),
    ("field", "Field", "Api"),
    ("sp", "StoredProcedure", "Data"),
    ("spcol", "ResultColumn", "Data"),
    ("udf", "Function", "Data"),
    ("table", "Table", "Data"),
    ("column", "Column", "Data"),
    ("cte", "Intermediate", "Data"),
    ("tmp", "Intermediate", "Data"),
    ("ctecol", "IntermediateColumn", "Data"),
    ("tmpcol", "IntermediateColumn", "Data"),
    ("expr", "Expression", "Data"),
    ("param", "SystemParameter", "Config"),
    ("branch", "Branch", "Service"),
]

# Prefixes of nodes that stand for columns and their parts.
COLUMN_LEVEL = ["spcol", "ctecol", "tmpcol", "expr", "column", "field", "json", "cte", "tmp"]

LAYERS = ["Web", "Api", "Service", "Data"]
STATUSES = ["Unknown", "Pending", "Known"]  # weaker first
TRANSFORMS = ["Direct", "Aggregate", "Conditional", "Mapping", "Serialization", "FunctionCall", "Expression", "Literal"]

# What a relation does, for the reasons of an impact.
VERBS = {
    "HandledBy": "is handled by", "Calls": "calls", "ExecutesSp": "executes", "EnrichedBy": "is enriched by", "BranchesOn": "branches on",
    "UsesParameter": "uses parameter", "Reads": "reads", "CallsFunction": "calls function", "ComputedBy": "is computed by", "AliasOf": "aliases",
    "DerivedFrom": "derives from", "ControlledBy": "is controlled by", "Returns": "returns", "MapsTo": "maps to", "SerializesAs": "serializes as",
    "Produces": "produces",
}

SOURCE = "struct<path:string,startLine:int,endLine:int>"
NODE = f"id string, type string, name string, qualifiedName string, layer string, status string, source {SOURCE}, metadata map<string,string>, description string, scanVersion string"
EDGE = "src string, dst string, relation string, confidence double, evidenceType string, evidenceRef string, metadata map<string,string>"
LINEAGE = "output string, source string, transform string, expression string, condition string, evidence array<string>, confidence double"
EVIDENCE = "id string, trace_id string, entity_key string, node_id string, evidence_type string, value string, scope string, label string, observed_at timestamp, environment string"
