"""Explanations: evidence bundles, deterministic rules over hops, and the check that every statement cites evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids
from weft.functions import text as T

BUNDLE_ITEMS = 120

# Kinds of evidence in their order, and relations that read as links of a chain.
KINDS = ["Node", "Edge", "Lineage", "Runtime"]
LINKS = ["SerializesAs", "MapsTo", "AliasOf", "Returns"]


def describe_node(type_: Column, name: Column, status: Column, description: Column, reason: Column) -> Column:
    text = F.concat(type_, F.lit(" '"), name, F.lit("' ["), status, F.lit("]"), F.coalesce(F.concat(F.lit(": "), description), F.lit("")))
    return F.concat(text, F.when((status != "Known") & reason.isNotNull(), F.concat(F.lit(" - "), reason)).otherwise(""))


def describe_edge(src: Column, relation: Column, dst: Column, condition: Column, variable: Column, kind: Column, ref: Column) -> Column:
    some = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return F.concat(src, F.lit(" -"), relation, F.lit("-> "), dst, some(" when ", condition), some(" via ", variable), some(" (", F.concat(kind, F.lit(" "), ref), ")"))


def describe_lineage(output: Column, source: Column, transform: Column, expression: Column, condition: Column) -> Column:
    from_ = F.coalesce(source, F.when(transform == "Literal", "<literal>").otherwise("<unknown>"))
    some = lambda before, c: F.coalesce(F.concat(F.lit(before), c), F.lit(""))
    return F.concat(output, F.lit(" <- "), from_, F.lit(" ["), transform, F.lit("]"), some(" ", expression), some(" when ", condition))


def describe_runtime(label: Column, node_id: Column, value: Column, kind: Column, environment: Column, observed_at: Column) -> Column:
    """value is JSON text; observed_at a time, told to the second."""
    said = F.concat(F.coalesce(label, node_id), F.lit(" = "), F.coalesce(value, F.lit("null")))
    at = F.concat(F.lit(" ("), kind, F.lit(", "), environment, F.lit(", "), F.date_format(observed_at, "yyyy-MM-dd HH:mm:ss"), F.lit("Z)"))
    return F.concat(said, at, F.lit(" on "), node_id)


def bundle(items: DataFrame, limit: int = BUNDLE_ITEMS) -> DataFrame:
    """items: request_id, kind, id, ord, text. Each id once (its first), by kind then id, limit a request."""
    once = items.groupBy("request_id", "id").agg(F.min_by(F.struct("kind", "text"), "ord").alias("i")).select("request_id", "id", "i.kind", "i.text")
    rank = ids.lookup({k: n for n, k in enumerate(KINDS)}, F.col("kind"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(rank, "id"))
    return once.withColumn("place", place).where(F.col("place") <= limit)


def allow(items: DataFrame, given: DataFrame) -> DataFrame:
    """Items whose id the caller listed, and all nodes."""
    listed = items.join(given.select("request_id", "id").distinct(), ["request_id", "id"], "left_semi")
    return listed.union(items.where("kind = 'Node'").join(given.select("request_id", "id"), ["request_id", "id"], "left_anti"))


def relevant_notes(notes: DataFrame, names: DataFrame) -> DataFrame:
    """Notes (request_id, note) that name, as a whole identifier in any case, one of the request's leaf names (request_id, name)."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("note"), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))
    words = notes.select("request_id", "note", F.explode(tokens).alias("word"))
    return words.join(names.select("request_id", F.lower("name").alias("word")).distinct(), ["request_id", "word"], "left_semi").select("request_id", "note").distinct()


def base_columns(hops: DataFrame) -> DataFrame:
    """For each request the distinct base columns its hops end at, by name."""
    ends = hops.where(ids.prefix(F.col("node_id")) == "column")
    return ends.groupBy("request_id").agg(F.array_sort(F.collect_set(ids.owner_key(F.col("node_id")))).alias("columns"))


def return_texts(texts: Column) -> Column:
    """Values without the timings among them, unless nothing else is left."""
    values = F.filter(texts, lambda t: ~F.contains(t, F.lit(" ms = ")))
    return F.when(F.size(values) > 0, values).otherwise(texts)


def row_context(evidence: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """(trace_id, scope, one column for each name) of rows that have all the sibling values."""
    wanted = evidence.where(F.col("scope").isNotNull() & F.col("node_id").isin([prefix + n for n in names]))
    each = wanted.groupBy("trace_id", F.lower("scope").alias("scope")).agg(*[F.min(F.when(F.col("node_id") == prefix + n, F.col("value"))).alias(n) for n in names])
    return each.na.drop(subset=names)


def validate(facts: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts: request_id, seq, ids. Kept facts with only their allowed ids, and (request_id, seq) of those without any: they become hypotheses."""
    cited = facts.select("request_id", "seq", F.posexplode("ids").alias("pos", "id")).join(allowed.select("request_id", "id").distinct(), ["request_id", "id"])
    kept = cited.groupBy("request_id", "seq").agg(F.array_sort(F.collect_set(F.struct("pos", "id"))).alias("c")).select("request_id", "seq", F.array_distinct(F.transform("c", lambda x: x["id"])).alias("ids"))
    return kept, facts.select("request_id", "seq").join(kept.select("request_id", "seq"), ["request_id", "seq"], "left_anti")


def verdict(n_facts: Column, static_gap: Column, open_hypotheses: Column) -> Column:
    return F.when(n_facts == 0, "Unknown").when(static_gap | open_hypotheses, "NeedMoreEvidence").otherwise("Known")


def validated_confidence(given: Column, said: Column) -> Column:
    cap = F.when(said == "Known", 0.95).otherwise(0.75)
    return F.when(said == "Unknown", 0.0).otherwise(F.bround(F.least(given, cap), 2))
