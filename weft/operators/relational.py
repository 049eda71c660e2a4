"""The query shapes of stock procedures, over the star-schema tables. Money is summed in whole cents, so sums do not depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def order_rows(line: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, part: DataFrame, supplier: DataFrame, managed: bool = True) -> DataFrame:
    """Six tables joined, two of them optional; a parameter chooses the measure; grouped by nation and brand, then by nation."""
    own = (
        line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(part, (line.l_partkey == part.p_partkey) & (part.p_size <= 25), "left").join(supplier, (line.l_suppkey == supplier.s_suppkey) & (supplier.s_acctbal >= 0), "left")
    )
    inner = own.groupBy("n_name", F.coalesce("p_brand", F.lit("none")).alias("brand")).agg(
        (F.sum("l_quantity").cast("long") * 10 if managed else F.sum(cents("l_extendedprice"))).alias("amount"), F.count("s_suppkey").alias("supplied"))
    return inner.groupBy("n_name").agg(F.count(F.lit(1)).alias("brands"), F.sum("amount").alias("amount"), F.sum("supplied").alias("supplied"), F.max("amount").alias("most"))


def available(line: DataFrame, part: DataFrame) -> DataFrame:
    """Two branches of a CASE in one union; parts without either count 0."""
    done = line.where("l_linestatus = 'F'").select("l_partkey", F.col("l_quantity").alias("q"))
    open_ = line.where("l_linestatus <> 'F'").select("l_partkey", F.when(F.col("l_returnflag") == "R", 0.0).otherwise(-F.col("l_quantity")).alias("q"))
    total = done.unionByName(open_).groupBy("l_partkey").agg(F.sum("q").alias("q"))
    return part.join(total, part.p_partkey == total.l_partkey, "left").select("p_partkey", F.coalesce("q", F.lit(0.0)).cast("long").alias("available"))


def guarded(part: DataFrame, line: DataFrame, constant: int = 1000) -> DataFrame:
    """Where a returned line exists the part's size, else the constant."""
    hit = line.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return part.join(hit, "p_partkey", "left").select("p_partkey", F.when(F.col("hit"), F.col("p_size").cast("long")).otherwise(F.lit(constant).cast("long")).alias("quantity"))


def bins(line: DataFrame) -> DataFrame:
    """Suppliers of each part by their first shipment, in one text."""
    first = line.groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("l_partkey").orderBy("first", "l_suppkey")))
    return ranked.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), ",").alias("bins"), F.count(F.lit(1)).alias("n"))


def order_header(line: DataFrame, orders: DataFrame, priority: str | None = None) -> DataFrame:
    """Distinct counts, a label that depends on one, a least value; the filter applies only if given."""
    own = orders if priority is None else orders.where(F.col("o_orderpriority") == priority)
    each = own.join(line, own.o_orderkey == line.l_orderkey).groupBy("o_custkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.min("o_orderstatus").alias("status"))
    return each.withColumn("label", F.when(F.col("suppliers") > 1, "MULTI").otherwise("SINGLE"))


def wagons(line: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """A constant column over four joined tables, distinct."""
    own = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return own.select("n_name", "l_returnflag", F.lit(1).alias("boxes")).distinct()


def preferred(customer: DataFrame, segment: str) -> DataFrame:
    """For each nation the richest customer of the segment, else the richest of all; ties by key."""
    order = F.struct(F.when(F.col("c_mktsegment") == segment, 0).otherwise(1), -F.col("c_acctbal"), F.col("c_custkey"))
    return customer.groupBy("c_nationkey").agg(F.min_by("c_custkey", order).alias("c_custkey"), F.min_by("c_mktsegment", order).alias("segment"))


def latest(line: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """For each part its latest ordered line, through two joins."""
    own = part.join(line, part.p_partkey == line.l_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
    at = F.struct("o_orderdate", "o_orderkey")
    return own.groupBy("p_partkey").agg(F.max_by("o_orderkey", at).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


def translated(documents: DataFrame) -> DataFrame:
    """A label for each language from a small table, the English one with the code where it has none."""
    own = documents.sparkSession.createDataFrame([("en", "English"), ("de", "Deutsch"), ("fr", "Français")], "lang string, label string")
    counted = documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(own), "lang", "left").select("lang", F.coalesce("label", F.concat(F.lit("English:"), "lang")).alias("label"), "n")
