"""Scratch tables in the folder that the driver and every executor share.

``spark.checkpoint.dir`` names that folder. It is read from the session; only a local-mode session
(one process, as in tests) that has none gets a temporary folder of its own. What an application writes there is
deleted when its driver ends, or earlier by :func:`clear`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared scratch folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="plaintide-")
    return _LOCAL[app]


def _of_application(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/plaintide/{spark.sparkContext.applicationId}"


def _store(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    top = _of_application(spark)
    if top not in _MARKED:
        _MARKED.add(top)
        store, path = _store(spark, top)
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends here: what is lost with an executor is read again from the shared folder, and
    the optimizer sees the table's true size when it picks a join.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt to all cores if it is read from fewer files than there are cores, and is small enough for a core to take what one scan task does.

    A file of one row group is one task's work, however many cores wait. Tables of many or large files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores
    return df.repartition(cores) if few else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clear(spark: SparkSession) -> None:
    """Delete every scratch table and file of this application."""
    store, path = _store(spark, _of_application(spark))
    store.delete(path, True)
    _MARKED.discard(_of_application(spark))
