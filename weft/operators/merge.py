"""Assembling graphs from several producers: ordered folds by key, placeholders, links by name.

Each row says which snapshot it came from (ord) and its place there (seq). Node merges depend on that order: windows find
what each row meets, aggregates do the rest. Edge and lineage merges are order-free aggregates with ties to the earliest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids
from weft.schema import NODE, STATUSES

PLACEHOLDER = "Referenced but not defined by any producer."


def merged_map(loser: Column, winner: Column) -> Column:
    """Union of two maps, winner's value where both have a key; nulls as empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(loser, none), F.coalesce(winner, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def _strength(status: Column) -> Column:
    return F.coalesce(ids.lookup({s: k for k, s in enumerate(STATUSES)}, status), F.lit(0))


FIELDS = [x.split()[0] for x in NODE.split(", ")][1:]


def _at() -> Column:
    return F.struct("ord", "seq")


def _in_order(*also: str):
    return Window.partitionBy("id", *also).orderBy("ord", "seq")


def _first(name: str, when: Column | None = None) -> Column:
    """The earliest value that is not null (of rows that satisfy when)."""
    return F.min(F.when(F.col(name).isNotNull() if when is None else F.col(name).isNotNull() & when, F.struct("ord", "seq", name)))


def _last(name: str, when: Column | None = None) -> Column:
    return F.max(F.when(F.col(name).isNotNull() if when is None else F.col(name).isNotNull() & when, F.struct("ord", "seq", name)))


def _metadata(rows: DataFrame) -> DataFrame:
    """(id, metadata) of rows (id, ord, seq, metadata, wins): of each key the latest entry that wins, else the earliest. Empty where a node has no entry, null if its only row has no map."""
    latest, earliest = F.max_by("value", F.when(F.col("wins"), _at())), F.min_by("value", _at())
    entries = rows.select("id", "ord", "seq", "wins", F.explode("metadata").alias("key", "value"))
    each = entries.groupBy("id", "key").agg(F.when(F.max("wins"), latest).otherwise(earliest).alias("value"))
    maps = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("map"))
    some = rows.groupBy("id").agg(((F.count(F.lit(1)) > 1) | F.max(F.col("metadata").isNotNull())).alias("any"))
    return some.join(maps, "id", "left").select("id", F.coalesce("map", F.when(F.col("any"), F.create_map().cast("map<string,string>"))).alias("metadata"))


def merge_nodes(rows: DataFrame) -> DataFrame:
    """rows: the node columns with ord, seq and policy (FillGaps or Authoritative); one node for each id, as if the store took them in (ord, seq) order.

    A node's status before each row follows from the strongest one since its last authoritative row. Where a row that is not unknown meets an
    unknown node, a new epoch begins: the row replaces what was there. All fields are then plain aggregates over the last epoch's rows
    (descriptions and metadata over all rows), so nothing gathers a node's rows: a window streams over them, and aggregates combine before the shuffle.
    """
    strict, known = F.coalesce(F.col("policy") == "Authoritative", F.lit(False)), F.col("status") == "Known"
    strength = _strength(F.col("status"))
    run = rows.withColumns({"strict": strict, "reset": F.sum(strict.cast("long")).over(_in_order())})
    run = run.withColumn("reached", F.max(F.struct(strength.alias("strength"), "status")).over(_in_order("reset")))
    run = run.withColumn("before", F.lag("reached.strength").over(_in_order()))
    strongest = len(STATUSES) - 1
    run = run.withColumns({"first": F.col("before").isNull(), "replaces": F.coalesce((F.col("before") == 0) & (strength > 0), F.lit(False))})
    run = run.withColumns({
        "defines": F.coalesce(~F.col("replaces") & (F.col("before") < strongest) & known, F.lit(False)), "epoch": F.sum(F.col("replaces").cast("long")).over(_in_order()),
    })
    run = run.withColumn("wins", F.col("replaces") | F.col("strict") | F.col("defines"))
    value = lambda e, name: F.col(e)[name]
    opens = F.col("first") | F.col("replaces")
    each = run.groupBy("id", "epoch").agg(
        F.min_by("type", _at()).alias("type"), *[F.max_by(c, F.when(opens | F.col("strict"), _at())).alias(c) for c in ("name", "layer")], F.max_by("reached.status", _at()).alias("status"),
        _last("qualifiedName", F.col("strict")).alias("q1"), _first("qualifiedName").alias("q2"), _first("source").alias("s"), _last("scanVersion", F.col("defines")).alias("v1"), _first("scanVersion").alias("v2"),
        _last("description", F.col("strict")).alias("d1"), _first("description").alias("d2"),
    )
    own = F.struct("type", "name", F.coalesce(value("q1", "qualifiedName"), value("q2", "qualifiedName")).alias("qualifiedName"), "layer", "status", value("s", "source").alias("source"), F.coalesce(value("v1", "scanVersion"), value("v2", "scanVersion")).alias("scanVersion"))
    node = each.groupBy("id").agg(F.max_by(own, "epoch").alias("n"), F.max("d1").alias("d1"), F.min("d2").alias("d2"))
    node = node.select("id", "n.*", F.coalesce(value("d1", "description"), value("d2", "description")).alias("description"))
    return node.join(_metadata(run), "id").select("id", *FIELDS)


def define_nodes(rows: DataFrame) -> DataFrame:
    """A scanner's own rule: a known node is never downgraded, so rows that are not known do not count after one that is; else the later row
    wins, and what it lacks comes from the latest that has it."""
    known = F.coalesce(F.col("status") == "Known", F.lit(False))
    seen = F.max(known).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    used = rows.withColumn("skip", F.coalesce(seen, F.lit(False)) & ~known).where("not skip").withColumn("wins", F.lit(True))
    node = used.groupBy("id").agg(
        *[F.max_by(c, _at()).alias(c) for c in ("type", "name", "layer", "status", "scanVersion")], *[_last(c)[c].alias(c) for c in ("qualifiedName", "source", "description")],
    )
    return node.join(_metadata(used), "id").select("id", *FIELDS)


def merge_edges(rows: DataFrame) -> DataFrame:
    """rows: edge_id, src, relation, dst, confidence, evidenceType, evidenceRef, ord, seq. Confidence is the most any row has; type and
    reference come from the most confident row, the earliest of equals; refs joins all references if several."""
    best = F.struct(F.col("confidence"), -F.col("ord"), -F.col("seq"))
    return rows.groupBy("edge_id").agg(
        F.min("src").alias("src"), F.min("relation").alias("relation"), F.min("dst").alias("dst"), F.max("confidence").alias("confidence"),
        F.max_by("evidenceType", best).alias("evidenceType"), F.max_by("evidenceRef", best).alias("evidenceRef"),
        F.array_sort(F.collect_set("evidenceRef")).alias("refs"),
    ).withColumn("refs", F.when(F.size("refs") > 1, F.array_join("refs", ";")))


def link_edges(rows: DataFrame) -> DataFrame:
    """A scanner's own rule: the most confident row stays whole, the earliest of equals; of the others only references are added."""
    best = F.struct(F.col("confidence"), -F.col("seq"))
    return rows.groupBy("edge_id").agg(
        F.max("confidence").alias("confidence"), F.max_by(F.struct("evidenceType", "evidenceRef", "metadata"), best).alias("best"), F.array_sort(F.collect_set("evidenceRef")).alias("refs"),
    ).select("edge_id", "confidence", "best.evidenceType", "best.evidenceRef", "best.metadata", F.when(F.size("refs") > 1, F.array_join("refs", ";")).alias("refs"))


def merge_lineage(rows: DataFrame) -> DataFrame:
    """rows: output, source, transform, expression, condition, evidence, confidence, ord, seq. First expression, all evidence, most confidence."""
    at = F.struct("ord", "seq")
    return rows.withColumn("lineage_id", ids.lineage_id(F.col("output"), F.col("source"), F.col("condition"))).groupBy("lineage_id").agg(
        F.min_by("transform", at).alias("transform"), F.min_by("expression", F.when(F.col("expression").isNotNull(), at)).alias("expression"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence", F.array().cast("array<string>")))))).alias("evidence"), F.max("confidence").alias("confidence"),
    )


def references(nodes: DataFrame, named: DataFrame, reason: str = PLACEHOLDER) -> DataFrame:
    """Unknown placeholders for the named ids (id) that nodes lacks."""
    new = named.select("id").where("id is not null").distinct().join(nodes.select("id"), "id", "left_anti")
    at = F.col("id")
    return new.select(
        "id", ids.node_type(at).alias("type"), ids.display_name(at).alias("name"), ids.owner_key(at).alias("qualifiedName"), ids.node_layer(at).alias("layer"), F.lit("Unknown").alias("status"), F.lit(reason).alias("reason"),
    )


def placeholders(nodes: DataFrame, edges: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Placeholders for every end of an edge or lineage record that nodes lacks."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    if lineage is not None:
        ends = ends.union(lineage.select("output")).union(lineage.select("source"))
    return references(nodes, ends)


def is_scalar(kind: Column) -> Column:
    return ~F.coalesce(F.lower(kind), F.lit("")).isin("model", "collection")


def link_by_name(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Result columns to model fields of each sp -MapsTo-> model edge, by leaf name in any case.

    Linked: one edge row for each match, with its lineage fields. Unmapped fields: scalar fields without a column. Unmapped columns:
    columns without a field. A procedure without columns is left out. nodes: id and kind.
    """
    maps = edges.where("relation = 'MapsTo'").where(F.col("src").startswith("sp:") & F.col("dst").startswith("model:")).select(F.col("src").alias("sp"), F.col("dst").alias("model"), F.col("edge_id").alias("mapping"))
    held = edges.where("relation = 'Contains'").select(F.col("src").alias("owner"), F.col("dst").alias("member"), "edge_id", F.lower(ids.leaf(F.col("dst"))).alias("leaf"))
    columns = held.where(F.col("member").startswith("spcol:"))
    first = columns.groupBy("owner", "leaf").agg(F.min_by("member", "edge_id").alias("column"))
    fields = held.where(F.col("member").startswith("field:")).join(nodes.select(F.col("id").alias("member"), "kind"), "member", "left")
    own_columns = maps.join(first, maps.sp == first.owner).select("mapping", "sp", "model", "leaf", "column")
    own_fields = maps.join(columns.select(F.col("owner").alias("sp")).distinct(), "sp", "left_semi").join(fields, F.col("model") == F.col("owner")).select("mapping", "sp", "leaf", F.col("member").alias("field"), "kind")
    linked = own_columns.join(own_fields.select("mapping", "leaf", "field"), ["mapping", "leaf"]).select(
        ids.edge_id(F.col("column"), F.lit("MapsTo"), F.col("field")).alias("edge_id"), F.col("column").alias("src"), F.lit("MapsTo").alias("relation"), F.col("field").alias("dst"), F.lit(0.95).alias("confidence"),
        F.lit("Linker").alias("evidenceType"), F.concat("mapping", F.lit("; dapper name match")).alias("evidenceRef"), F.concat("column", F.lit(" -> "), "field").alias("expression"), "mapping",
    )
    no_column = own_fields.where(is_scalar(F.col("kind"))).join(own_columns, ["mapping", "leaf"], "left_anti").select("mapping", "field")
    no_field = own_columns.join(own_fields, ["mapping", "leaf"], "left_anti").select("mapping", "column")
    return linked, no_column, no_field


# The steps of a build in their order, and those that each mode leaves out.
BUILD_STEPS = ["dotnet-scanner", "sql-scanner", "linker", "ground-truth", "manual-overrides"]
LEFT_OUT = {"Full": [], "ScanOnly": ["ground-truth", "manual-overrides"], "CuratedOnly": ["dotnet-scanner", "sql-scanner", "linker"]}


def build(parts: dict[str, tuple[DataFrame, DataFrame, DataFrame]], mode: str = "Full") -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """The merged nodes, edges and lineage of a build in a mode, and its steps for build_report().

    parts: step name to nodes, edges and lineage rows with seq, of the steps there are. Scanned rows fill gaps, curated ones are authoritative.
    Ends without a node become placeholders of the step that names them first.
    """
    names = [s for s in BUILD_STEPS if s in parts and s not in LEFT_OUT[mode]]
    if not names:
        raise ValueError(f"no step of mode {mode}")
    nodes = edges = lineage = None
    grow = lambda have, df: df if have is None else have.unionByName(df, allowMissingColumns=True)
    for name in names:
        n, e, r = parts[name]
        at = F.lit(BUILD_STEPS.index(name))
        policy = F.lit("Authoritative" if name in ("ground-truth", "manual-overrides") else "FillGaps")
        nodes, edges, lineage = grow(nodes, n.withColumns({"ord": at, "policy": policy})), grow(edges, e.withColumn("ord", at)), grow(lineage, r.withColumn("ord", at))
    merged, linked, records = merge_nodes(nodes), merge_edges(edges), merge_lineage(lineage)
    missing = placeholders(merged, linked)
    lost = missing.select(*[F.col(c) if c in missing.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in NODE.split(", "))])
    steps = []
    for name in names:
        ends = parts[name][1].select(F.col("src").alias("id")).union(parts[name][1].select("dst"))
        own = missing.join(ends, "id", "left_semi").select("id", "status")
        steps.append((name, parts[name][0].select("id", "status").union(own), parts[name][1], parts[name][2].withColumn("lineage_id", ids.lineage_id(F.col("output"), F.col("source"), F.col("condition")))))
    return merged.unionByName(lost), linked, records, steps


def build_report(steps: list[tuple[str, DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """(step, nodes, edges, lineage, unknown, pending) after each step, from what each step adds: (name, nodes (id, status), edges (edge_id), lineage (lineage_id)).

    Counts are cumulative: an id counts at the first step that has it, and a node's status is the strongest so far.
    """
    nodes = edges = lineage = None
    grow = lambda have, df: df if have is None else have.unionByName(df)
    for k, (_, n, e, r) in enumerate(steps):
        nodes = grow(nodes, n.select("id", _strength(F.col("status")).alias("strength"), F.lit(k).alias("step")))
        edges = grow(edges, e.select(F.col("edge_id").alias("id"), F.lit(k).alias("step")))
        lineage = grow(lineage, r.select(F.col("lineage_id").alias("id"), F.lit(k).alias("step")))
    names = nodes.sparkSession.createDataFrame([(k, s[0]) for k, s in enumerate(steps)], "step int, name string")

    def total(df, label):
        new = df.groupBy("id").agg(F.min("step").alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("new"))
        return names.join(new, "step", "left").select("step", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("step")).alias(label))

    # of each node and step: the strongest status up to that step; one row for each step that has the node or a later one
    reached = nodes.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("step", "strength"))).alias("seen"))
    at = reached.select(F.explode(F.sequence(F.col("seen")[0]["step"], F.lit(len(steps) - 1))).alias("step"), "seen")
    best = at.select("step", F.array_max(F.transform(F.filter("seen", lambda s: s["step"] <= F.col("step")), lambda s: s["strength"])).alias("strength"))
    status = best.groupBy("step").agg(F.count_if(F.col("strength") == 0).alias("unknown"), F.count_if(F.col("strength") == 1).alias("pending"))
    return names.join(total(nodes, "nodes"), "step").join(total(edges, "edges"), "step").join(total(lineage, "lineage"), "step").join(status, "step", "left")
