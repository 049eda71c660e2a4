"""Graph snapshots, captures, cases and settings as JSON documents and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.schema import EDGE, LINEAGE, NODE

VERSION = "1.0"

EDGE_JSON = EDGE.replace("src string, dst string, relation string", "`from` string, `to` string, relationType string")
LINEAGE_JSON = LINEAGE.replace("output string, source string, transform string", "outputFieldId string, sourceFieldId string, transformType string").replace("evidence array", "evidenceEdgeIds array")
_fields = lambda s: ",".join(f"{n}:{t}" for n, t in (x.strip().split(" ", 1) for x in s.split(", ")))
SNAPSHOT = f"struct<schemaVersion:string,source:string,scanVersion:string,nodes:array<struct<{_fields(NODE)}>>,edges:array<struct<{_fields(EDGE_JSON)}>>,lineages:array<struct<{_fields(LINEAGE_JSON)}>>>"
CASE = "struct<id:string,title:string,rootNodeId:string,apiNodeId:string,keyFields:array<string>,systemParameters:array<string>,knownGaps:array<struct<nodeId:string,reason:string,priority:string>>>"
FIXTURE = (
    "struct<fixtureId:string,entityType:string,entityKey:string,environment:string,observedAt:string,traceId:string,systemParameters:map<string,string>,response:string,"
    "procedureResults:map<string,struct<durationMs:int,rowKey:string,returnColumn:string,rows:array<map<string,string>>>>,functionResults:map<string,struct<durationMs:int,rowKey:string,returnColumn:string,rows:array<map<string,string>>>>,unknowns:array<string>>"
)
SETTINGS = "struct<values:map<string,struct<value:string,provided:string,note:string>>>"


def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, bytes) of the files below root, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("bytes")).orderBy("path")


def documents(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """(path, json): whole text files."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def cleaned(json: Column) -> Column:
    """Without line comments outside strings and without trailing commas; texts without either do not meet the patterns, which read strings sign by sign."""
    bare = F.when(F.contains(json, F.lit("//")), F.regexp_replace(json, r'("(?:[^"\\]|\\.)*")|//[^\n]*', "$1")).otherwise(json)
    return F.when(F.rlike(bare, F.lit(r",\s*[}\]]")), F.regexp_replace(bare, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")).otherwise(bare)


def parsed(docs: DataFrame, schema: str) -> DataFrame:
    """docs (path, json) with doc; a document that is null or no JSON is an error that names its path."""
    bad = F.raise_error(F.concat(F.lit("no document in "), F.coalesce("path", F.lit("?"))))
    clean = docs.select("path", "json", cleaned(F.col("json")).alias("clean"))
    return clean.select("path", F.when(F.trim("json").isin("null", "") | F.col("json").isNull() | F.try_parse_json("clean").isNull(), bad.cast(schema)).otherwise(F.from_json("clean", schema)).alias("doc"))


def snapshot_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (with edge_id) and lineage (with lineage_id) of snapshot documents, with path and seq."""
    doc = parsed(docs, SNAPSHOT)
    nodes = doc.select("path", F.posexplode("doc.nodes").alias("seq", "n")).select("path", "seq", "n.*")
    edges = doc.select("path", F.posexplode("doc.edges").alias("seq", "e")).select("path", "seq", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), pascal(F.col("e.relationType")).alias("relation"), "e.confidence", pascal(F.col("e.evidenceType")).alias("evidenceType"), "e.evidenceRef", "e.metadata")
    lineage = doc.select("path", F.posexplode("doc.lineages").alias("seq", "l")).select("path", "seq", F.col("l.outputFieldId").alias("output"), F.col("l.sourceFieldId").alias("source"), pascal(F.col("l.transformType")).alias("transform"), "l.expression", "l.condition", F.col("l.evidenceEdgeIds").alias("evidence"), "l.confidence")
    nodes = nodes.withColumns({c: pascal(F.col(c)) for c in ("type", "layer", "status")})
    edges = edges.withColumns({"edge_id": ids.edge_id(F.col("src"), F.col("relation"), F.col("dst")), "confidence": F.coalesce("confidence", F.lit(1.0)), "evidenceType": F.coalesce("evidenceType", F.lit("Manual"))})
    lineage = lineage.withColumns({"lineage_id": ids.lineage_id(F.col("output"), F.col("source"), F.col("condition")), "confidence": F.coalesce("confidence", F.lit(1.0))})
    return nodes, edges, lineage


def pascal(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000))


def camel(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1000))


def faults(docs: DataFrame) -> DataFrame:
    """(path, fault) of snapshots with another schema version, or with a node id twice (the first such id)."""
    doc = parsed(docs, SNAPSHOT)
    version = doc.where(~F.col("doc.schemaVersion").eqNullSafe(F.lit(VERSION))).select("path", F.concat(F.lit("schema version "), F.coalesce("doc.schemaVersion", F.lit("missing"))).alias("fault"))
    nodes, _, _ = snapshot_parts(docs)
    return version.union(repeated(nodes))


def repeated(nodes: DataFrame) -> DataFrame:
    """(path, fault): the least node id that a snapshot (path) has twice."""
    twice = nodes.groupBy("path", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("path").agg(F.min("id").alias("id")).select("path", F.concat(F.lit("duplicate node id "), "id").alias("fault"))


# How ids follow from their rows; and what stands for one that is null though its row gives one.
IDS = {"edge_id": lambda: ids.edge_id(F.col("src"), F.col("relation"), F.col("dst")), "lineage_id": lambda: ids.lineage_id(F.col("output"), F.col("source"), F.col("condition"))}
NO_ID = "\0none"


def write_tables(path: str, nodes: DataFrame, edges: DataFrame, lineage: DataFrame) -> None:
    """A snapshot as three Parquet tables and a manifest row; any size. An id that follows from its row is left null, as JSON snapshots have none."""
    for column, own in IDS.items():
        shorter = lambda df: df.withColumn(column, F.when(~F.col(column).eqNullSafe(own()), F.coalesce(column, F.lit(NO_ID)))) if column in df.columns else df  # noqa: B023, E731
        edges, lineage = shorter(edges), shorter(lineage)
    for name, df in (("nodes", nodes), ("edges", edges), ("lineage", lineage)):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    nodes.sparkSession.createDataFrame([(VERSION, "merged")], "schemaVersion string, source string").write.mode("overwrite").json(f"{path}/manifest")


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    version = spark.read.json(f"{path}/manifest").first()["schemaVersion"]
    if version != VERSION:
        raise ValueError(f"schema version {version}")
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "lineage")]
    for column, own in IDS.items():
        whole = F.when(F.col(column).isNull(), own()).when(F.col(column) != NO_ID, F.col(column))
        tables = [df.withColumn(column, whole) if column in df.columns else df for df in tables]
    return tuple(tables)


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): each node and edge as a JSON object with camel-case names and enums, nulls left out."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", camel(F.col("type")).alias("type"), "name", camel(F.col("layer")).alias("layer"), camel(F.col("status")).alias("status"))).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), camel(F.col("relation")).alias("relationType"), "confidence")).alias("json"))
    return n.union(e)


def export(nodes: DataFrame, edges: DataFrame, lineage: DataFrame) -> DataFrame:
    """(kind, id, json) of a whole store with all the fields there are, each kind by id; written with partitionBy("kind") it is a snapshot of any size."""
    some = lambda df, names: [F.col(c) for c in names if c in df.columns]
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct("id", camel(F.col("type")).alias("type"), "name", *some(nodes, ["qualifiedName"]), camel(F.col("layer")).alias("layer"), camel(F.col("status")).alias("status"), *some(nodes, ["source", "metadata", "description", "scanVersion"]))).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), camel(F.col("relation")).alias("relationType"), "confidence", *some(edges, ["evidenceType", "evidenceRef", "metadata"]))).alias("json"))
    r = lineage.select(F.lit("lineage").alias("kind"), F.col("lineage_id").alias("id"), F.to_json(F.struct(F.col("output").alias("outputFieldId"), F.col("source").alias("sourceFieldId"), camel(F.col("transform")).alias("transformType"), "expression", "condition", *[F.col("evidence").alias("evidenceEdgeIds")] * ("evidence" in lineage.columns), "confidence")).alias("json"))
    return n.union(e).union(r).orderBy("kind", "id")


def cases(docs: DataFrame) -> DataFrame:
    return parsed(docs, CASE).select("path", "doc.*")


def case_overview(cases: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key fields that exist, in their order (id, pos, node_id, status); and gaps with their node's status, Unknown without one (id, node_id, priority, status)."""
    fields = cases.select(F.col("id").alias("case"), F.posexplode("keyFields").alias("pos", "node_id")).join(nodes.select(F.col("id").alias("node_id"), "status"), "node_id").select("case", "pos", "node_id", "status")
    gaps = cases.select(F.col("id").alias("case"), F.explode_outer("knownGaps").alias("g")).where("g is not null").select("case", "g.nodeId", "g.priority").join(nodes.select(F.col("id").alias("nodeId"), "status"), "nodeId", "left")
    return fields, gaps.select("case", F.col("nodeId").alias("node_id"), "priority", F.coalesce("status", F.lit("Unknown")).alias("status"))


def fixtures(docs: DataFrame) -> DataFrame:
    """Captures, with trace_id (trace-{fixture} where none is given) and the original time text beside the time."""
    d = parsed(docs, FIXTURE).select("path", "doc.*")
    return d.select(
        F.col("fixtureId").alias("fixture_id"), F.col("entityKey").alias("entity_key"), "environment", F.coalesce("traceId", F.concat(F.lit("trace-"), "fixtureId")).alias("trace_id"), F.col("observedAt").alias("observed_text"),
        F.to_timestamp("observedAt").alias("observed_at"), "systemParameters", "response", "procedureResults", "functionResults", "unknowns",
    )


def settings(docs: DataFrame) -> DataFrame:
    """(name, value, provided, note); a blank value is an error."""
    rows = parsed(docs, SETTINGS).select(F.explode("doc.values").alias("name", "v")).select("name", "v.*")
    return rows.withColumn("value", F.when(F.coalesce(F.trim("value"), F.lit("")) == "", F.raise_error(F.concat(F.lit("blank setting "), "name"))).otherwise(F.col("value")))
