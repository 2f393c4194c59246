"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word contracts: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG_MAX = (1 << 63) - 1
#: Kinds of ids that are compared as numbers.
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Keys that are split off as hot and broadcast. Every other key then holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 1000

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset and all executors are threads of this process (tests) is it a temporary one; on a cluster it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(where)
        return where
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: no lineage, survives lost executors.

    The folder is removed by release() or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _scratch:
        atexit.register(release, spark)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """For release(): the tables written from now on."""
    return len(_scratch)


def release(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Removes the scratch tables written since a mark (default: all), but the last if it is still read. Call it when no result that reads them is needed any more."""
    try:
        gone = _scratch[since : len(_scratch) - but_last]
        del _scratch[since : len(_scratch) - but_last]
        for path in gone:
            _delete(spark, path)
    except Exception:  # the JVM may be gone at exit  # noqa: BLE001
        _scratch.clear()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns of df but those that an operator adds: an added column replaces one of its name (case aside)."""
    names = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in names]


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() to the shared folder; its files go when the result is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Joins left with right, which is unique by keys and says in `weight` how many left rows have the key.

    The HOT_KEYS keys of greatest weight are broadcast (a bound that no input changes); any other key has at most
    1/HOT_KEYS of left's rows, so no task of the shuffled join gets a hot key. left and right are read twice: they should be written tables.
    """
    hot = right.orderBy(F.col(weight).desc(), *keys).limit(HOT_KEYS)
    names = hot.select(*keys)
    cold = right.join(F.broadcast(names), keys, "left_anti")
    return left.join(F.broadcast(hot), keys, "inner").unionByName(left.join(F.broadcast(names), keys, "left_anti").join(cold, keys, how))
