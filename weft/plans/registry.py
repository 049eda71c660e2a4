"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weft.operators.shared import dealt_by_size
from weft.sources import bench_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GRAPH = bench_graph.plain(f"edges AS ({bench_graph.EDGES}), nodes AS ({bench_graph.NODES}), lineage AS ({bench_graph.LINEAGE}), evidence AS ({bench_graph.EVIDENCE})")


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle; WITH GRAPH at the start of the SQL brings the bench graph's tables."""

    def add(f):
        @wraps(f)
        def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
            dealt_by_size(spark, [f"{sf_dir}/{t}.parquet" for t in bench_graph.TABLES])
            return f(spark, sf_dir)

        QUERIES[f.__name__] = sized
        if sql is not None:
            ORACLE[f.__name__] = sql.replace("WITH GRAPH", f"WITH RECURSIVE {GRAPH}")
        return f

    return add
