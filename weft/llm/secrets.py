"""Secret scans by multipart credential linking, with DataFrame functions only.

Base spans: assignments of a password, secret, token or API key, access key ids, and long hex runs. Besides,
every text yields weak parts: short access ids and named accounts (identifiers), shorter hex runs (secrets)
and connection addresses (endpoints). Parts become intervals from their start to TAIL characters before their
end (to the start, if shorter); an interval join on (row, scope bucket) tells for each weak part which
complementary parts lie within SCOPE characters, in either order and whatever the parts' lengths. A part is dealt
to every bucket that it covers. The right side is aggregated to one row a bucket before the join, so hot scopes never multiply. A weak identifier or secret is reported when its
counterpart is in scope and one of the two is strong or an endpoint is there as well; an endpoint
is reported when both an identifier and a secret are in scope.

Null and empty texts give no spans; each input row gives one row, repeated rows and null ids too; extra columns are
not read. Places are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import written

SCOPE = 200
TAIL = 20
GROUP = 64

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ACCOUNT = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]+"""
ENDPOINT = r"""(?i:https?|ftp|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|s3)(?::[a-z0-9]+)?://[^\x20\x09-\x0D"'<>]+"""


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, said>> of all matches: the texts between them, by split, give their places.

    Places are running sums; they are built by groups of GROUP matches, so that no long array is copied for every match.
    """
    none = F.array().cast("array<struct<start:int,end:int,said:string>>")
    length = lambda group: F.aggregate(group, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["said"]))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["said"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["said"].alias("said")))).alias("out"))

    def placed(groups):
        before = F.aggregate(groups, F.array(F.lit(0)), lambda sums, group: F.concat(sums, F.array(F.element_at(sums, -1) + length(group))))
        each = F.zip_with(groups, F.slice(before, 1, F.size(groups)), lambda group, at: F.aggregate(group, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(each)

    def grouped(pairs):  # the last pair has no match
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 2) / GROUP)), lambda g: F.slice(pairs, (g * GROUP + 1).cast("int"), F.least(F.lit(GROUP), (F.size(pairs) - 1 - g * GROUP).cast("int"))))

    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  names a value, so that it is not computed at every use
    zipped = lambda said: F.arrays_zip(F.split(text, pattern, -1).alias("gap"), said.alias("said"))
    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda said: F.when(F.size(said) > 0, once(zipped(said), lambda p: once(grouped(p), placed))).when(said.isNotNull(), none))


def parts(docs: DataFrame) -> DataFrame:
    """One row for each document: row, doc_id, base and weak spans as array<struct<start, rank, end, role>>."""
    text = docs["text"].cast("string")
    value_size = lambda m: F.length(F.regexp_extract(m["said"], ASSIGN, 1))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).select(
        "row", "doc_id",
        *[F.coalesce(matches(F.col("text"), p), F.array().cast("array<struct<start:int,end:int,said:string>>")).alias(n) for n, p in (("m_assign", ASSIGN), ("m_access", ACCESS), ("m_hex", HEX), ("m_account", ACCOUNT), ("m_endpoint", ENDPOINT))],
    )
    size = lambda m: m["end"] - m["start"]
    part = lambda name, rank, role, keep: F.transform(F.filter(name, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(role).alias("role")))
    return rows.select(
        "row", "doc_id",
        F.array_sort(F.concat(part("m_assign", 0, "secret", lambda m: value_size(m) >= 6), part("m_access", 1, "identifier", lambda m: size(m) >= 20), part("m_hex", 2, "secret", lambda m: size(m) >= 24))).alias("base"),
        F.concat(
            part("m_assign", 4, "secret", lambda m: value_size(m) < 6), part("m_hex", 4, "secret", lambda m: size(m) < 24),
            part("m_access", 3, "identifier", lambda m: size(m) < 20), part("m_account", 3, "identifier", lambda m: size(m) > 0), part("m_endpoint", 5, "endpoint", lambda m: size(m) > 0),
        ).alias("weak"),
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, added): the weak parts of found's rows that have their complementary parts in scope."""
    strong = found.where(F.size("weak") > 0).select("row", F.explode("base").alias("p"), F.lit(True).alias("strong"))
    weak = found.where(F.size("weak") > 0).select("row", F.explode("weak").alias("p"), F.lit(False).alias("strong"))
    bucket = lambda place: F.floor(place / scope)
    every = strong.union(weak).select("row", "p.start", "p.end", "p.rank", "p.role", "strong", F.greatest("p.start", F.col("p.end") - TAIL).alias("last"))
    covered = every.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("last")))))
    of = lambda role, strong, place: F.when((F.col("role") == role) & (F.col("strong") if strong else F.lit(True)), F.col(place))
    names = {"any_id": ("identifier", False), "any_secret": ("secret", False), "any_endpoint": ("endpoint", False), "strong_id": ("identifier", True), "strong_secret": ("secret", True)}
    # Of parts that share a bucket, one ending too early and one starting too late cannot both be out of scope: they are less than a scope apart.
    right = covered.groupBy("row", "bucket").agg(*[f(of(*what, place)).alias(f"{n}_{place}") for n, what in names.items() for f, place in ((F.min, "start"), (F.max, "last"))])
    left = every.where("not strong").select("row", "start", "end", "rank", "role", "last", F.explode(F.sequence(bucket(F.col("start") - scope), bucket(F.col("last") + scope))).alias("bucket"))
    near = lambda n: F.coalesce((F.col(f"{n}_last") >= F.col("start") - scope) & (F.col(f"{n}_start") <= F.col("last") + scope), F.lit(False))
    seen = left.join(right, ["row", "bucket"]).select("row", "start", "end", "rank", "role", *[near(n).alias(n) for n in names])
    seen = seen.groupBy("row", "start", "end", "rank", "role").agg(*[F.max(n).alias(n) for n in names])
    backed = lambda other, strong: F.col(other) & (F.col(strong) | F.col("any_endpoint"))
    kept = seen.where(
        F.when(F.col("role") == "identifier", backed("any_secret", "strong_secret"))
        .when(F.col("role") == "secret", backed("any_id", "strong_id"))
        .otherwise(F.col("any_id") & F.col("any_secret"))
    )
    return kept.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end", "role"))).alias("added"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id with base and added spans of every row of docs (doc_id, text)."""
    found, _ = written(parts(docs), "parts")
    none = F.array().cast(found.schema["base"].dataType)
    return found.join(linked(found, scope), "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_linked"),
    )
