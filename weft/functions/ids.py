"""Columns over node, edge and lineage ids."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.schema import COLUMN_LEVEL, PREFIXES, RELATIONS, VERBS


def lookup(pairs: dict, key: Column) -> Column:
    """A value for key from a small fixed table, null if it has none; stays inside generated code."""
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items())), key)


def prefix(node_id: Column) -> Column:
    """Text before the first colon, empty if there is none."""
    return F.when(F.instr(node_id, ":") > 0, F.substring_index(node_id, ":", 1)).otherwise("")


def owner_key(node_id: Column) -> Column:
    """Text after the first colon; the whole id if there is none."""
    return F.substring(node_id, F.instr(node_id, ":") + 1, F.length(node_id))


def leaf(node_id: Column) -> Column:
    """Text after the last dot of what follows the prefix."""
    return F.substring_index(owner_key(node_id), ".", -1)


def edge_id(src: Column, relation: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge:"), src, F.lit("|"), relation, F.lit("|"), dst)


def lineage_id(output: Column, source: Column, condition: Column) -> Column:
    tail = F.coalesce(F.concat(F.lit("["), condition, F.lit("]")), F.lit(""))
    return F.concat(F.lit("lineage:"), output, F.lit("<-"), F.coalesce(source, F.lit("?")), tail)


def node_type(node_id: Column) -> Column:
    return F.coalesce(lookup({p: t for p, t, _ in PREFIXES}, prefix(node_id)), F.lit("Method"))


def node_layer(node_id: Column) -> Column:
    return F.coalesce(lookup({p: layer for p, _, layer in PREFIXES}, prefix(node_id)), F.lit("Service"))


def display_name(node_id: Column) -> Column:
    """api and page: all after the prefix; sp, udf, table: after the first dot; others: the leaf."""
    body, kind = owner_key(node_id), prefix(node_id)
    after_dot = F.when(F.instr(body, ".") > 0, F.substring(body, F.instr(body, ".") + 1, F.length(body))).otherwise(body)
    return F.when(kind.isin("api", "page"), body).when(kind.isin("sp", "udf", "table"), after_dot).otherwise(leaf(node_id))


def is_column_level(node_id: Column) -> Column:
    return prefix(node_id).isin(*COLUMN_LEVEL)


def direction(relation: Column) -> Column:
    return lookup({r: d for r, d, *_ in RELATIONS}, relation)


def upstream(src: Column, relation: Column, dst: Column) -> Column:
    """The end of an edge that the other depends on; null for structural edges."""
    way = direction(relation)
    return F.when(way == "DependsOn", dst).when(way == "FlowsTo", src)


def downstream(src: Column, relation: Column, dst: Column) -> Column:
    way = direction(relation)
    return F.when(way == "DependsOn", src).when(way == "FlowsTo", dst)


def verb(relation: Column) -> Column:
    return F.coalesce(lookup(VERBS, relation), F.lower(relation))


def normalised(schema: Column, name: Column) -> Column:
    """schema.name without brackets, dbo where no schema is given."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"^\s*\[|\]\s*$", ""))
    return F.concat_ws(".", F.coalesce(F.nullif(bare(schema), F.lit("")), F.lit("dbo")), bare(name))


def route_id(http_verb: Column, route: Column) -> Column:
    """api:VERB /route: verb in upper case, slashes trimmed, one in front."""
    return F.concat(F.lit("api:"), F.upper(http_verb), F.lit(" /"), F.regexp_replace(route, r"^/+|/+$", ""))
