"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting: drop a query's shuffle files when the query has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster no folder of one machine will do, so it raises.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        shared = sc.getCheckpointDir()
    return f"{shared}/lodestone-{sc.applicationId}"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run within are dropped as each ends: what it wrote is in a table by then."""
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read often, and whole even if executors are lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with short_lived_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that later queries of an application may read again.
_KEPT: dict[tuple, DataFrame] = {}


def version(files: DataFrame) -> tuple:
    """Two numbers that tell the files that a table is read from, by path, size and time of change."""
    facts = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    row = files.select(facts.alias("h")).distinct().agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def kept(files: DataFrame, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from files as they are now, such as an index: built and saved once in an application, then read again.

    `name` says what is built. Files that have changed since give another version, which is built anew.
    """
    key = (folder(files.sparkSession), name, version(files))
    if key not in _KEPT:
        _KEPT[key] = saved(build(), name)
    return _KEPT[key]


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when no result is to be read any more."""
    for key in [k for k in _KEPT if k[0] == folder(spark)]:
        del _KEPT[key]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes in fewer partitions, as one small file does; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
