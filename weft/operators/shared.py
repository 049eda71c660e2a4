"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 4 << 20  # of input files that one shuffle partition stands for; derived rows take some ten to forty times that in memory
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY, ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8MB"  # ids in a shuffle are packed some five to ten times; Spark's own 64 MB are too many to sort
SPLIT = "spark.sql.files.maxPartitionBytes"
BROADCAST, BROADCAST_BYTES = "spark.sql.autoBroadcastJoinThreshold", 256 << 10  # of files or of a shuffle, whose rows take up to some hundred times that in the driver's memory: ids are packed well

_own_dir: list[str] = []
_sizes: dict[tuple[str, ...], int] = {}


def dealt_by_size(spark: SparkSession, paths: list[str], part_bytes: int = PART_BYTES) -> None:
    """Lets shuffles begin with a partition for each part_bytes of the files below paths, where these are more than the session's own number, so that
    what one task sorts does not grow with the input; and scans read as much a task (whole row groups at least), as aggregates sort before a shuffle too. Spark joins small partitions again, to ADVISED at most. The size is only a hint, taken once for each list of paths.
    Spark's own broadcasts are of BROADCAST_BYTES at most, as the driver holds them whole."""
    most = spark.conf.get(BROADCAST)
    if not most.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most) > BROADCAST_BYTES:
        spark.conf.set(BROADCAST, BROADCAST_BYTES)
    key = tuple(paths)
    if key not in _sizes:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(paths).select("length")
        _sizes[key] = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = -(-_sizes[key] // part_bytes)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, parts)
        spark.conf.set(ADVISORY, ADVISED)
        spark.conf.set(SPLIT, part_bytes)
    else:
        spark.conf.unset(INITIAL)
        spark.conf.unset(ADVISORY)
        spark.conf.unset(SPLIT)


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-weft-"))
    return _own_dir[0]


def kept_at(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """df written to the shared folder (a folder for each value of by) and read back, so that loops neither recompute it nor grow its plan; and where it is."""
    path = f"{shared_dir(df.sparkSession)}/weft-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)  # ids say much twice
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def buckets(spark: SparkSession) -> int:
    """How many buckets a table gets: as many as shuffles begin with, so that a join takes its buckets as they lie."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL, None) or 0))


def bucketed_at(df: DataFrame, by: str) -> tuple[DataFrame, str]:
    """df, whose partitions are those of repartition(buckets(), by), written in that many buckets and read back, so that joins on by and groups of it do not deal it again; and where it is."""
    spark, name = df.sparkSession, f"weft_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").bucketBy(buckets(spark), by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018 - resolved while the catalog has the name; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table, path


def kept(df: DataFrame) -> DataFrame:
    return kept_at(df)[0]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of kept_at() that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
