"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Cuts from one collection to the next.
COLLECT = 8
_cuts = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; a cluster without one is an
    error, because a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that an iteration does not replay its whole history.

    What lies behind a cut is garbage, but executors keep its shuffle files until the driver's collector finds that out, which on a driver
    with little to collect takes long; so every ``COLLECT``-th cut asks for a collection.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_cuts) % COLLECT == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own below the shared folder, read again: far fewer bytes than ``cut`` leaves, and what follows reads only its columns."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that lies in fewer files than there are cores dealt over all of them, before costly work on each; any other table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
