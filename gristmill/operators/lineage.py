"""Cutting lineage between rounds of an iterative operator, and spreading small scans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Scans of fewer bytes are spread over all cores before heavy work: a small file may be one row group, hence one task.
SMALL_SCAN = 32 << 20


def shared_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder: the one that the cluster names in spark.checkpoint.dir.

    Where it names none and all executors are threads of this process (tests), a temporary folder serves; on a cluster
    the setting is needed, as executors share no local folder.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a file of stored(): small files are read a few to a task, so a task's sorts stay in memory however well rows compress.
STORED_ROWS = 100_000


def stored(df: DataFrame) -> DataFrame:
    """df written to a scratch table in columns and read again: for rows whose values repeat a small part of a checkpoint's bytes."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", STORED_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a scan that one partition of parted() takes.
PART_BYTES = 8 << 20


def scan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parted(df: DataFrame, source: DataFrame, *by: str) -> DataFrame:
    """df partitioned by columns into as many parts as its source (a scan) has PART_BYTES: a part, hence a task's memory, doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, scan_bytes(source) // PART_BYTES + 1), *by)


def balanced(df: DataFrame, large: bool = False) -> DataFrame:
    """A scan over all cores if it is below SMALL_SCAN, or (with `large`) if one of its splits holds over twice a core's share of the rows: a file of few row groups gives work to few tasks, however large it is. Others stay as they are.

    Larger scans become parts of PART_BYTES. The rows of splits are read from the files' footers.
    """
    size, cores = scan_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    if size < SMALL_SCAN:
        return df.repartition(cores)
    if not large:
        return df
    splits = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    if splits[0] is None or splits[0] * cores <= 2 * splits[1]:
        return df
    return df.repartition(max(cores, size // PART_BYTES + 1))


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """df with row numbers from 1 over all rows in an order, without gathering them: ranges of the order are numbered apart and moved up by the sizes of those before (a number a partition goes to the driver)."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()):
        offsets += [F.lit(part), F.lit(before).cast("long")]
        before += n
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__part")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn(name, own + F.element_at(F.create_map(*offsets), F.col("__part"))).drop("__part")


def numbered_within(df: DataFrame, by: str, order: str, name: str = "n") -> DataFrame:
    """df with row numbers from 1 within each value of `by` (nulls are one), in an order. A value of many rows is numbered by many tasks: ranges of (by, order) apart, moved up by the sizes of the value's ranges before. df is a scan, with a range for PART_BYTES of it (2,000 at most)."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(2000, scan_bytes(df) // PART_BYTES + 1))
    placed = cut(df.repartitionByRange(parts, by, order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__at")).agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    own = placed.withColumn("__own", F.row_number().over(Window.partitionBy("__part", by).orderBy(order)))
    both = own.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")))
    return both.select(*df.columns, (F.col("__own") + F.col("__before")).cast("long").alias(name))


def scratch_path(spark: SparkSession) -> str:
    """A new folder's path in the shared folder of cut(), for tables that a job writes and reads again; it goes when the driver's Python ends."""
    shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/gristmill-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone  # noqa: BLE001
        return
