"""Session helpers: tables, parallelism and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Where none is named a folder is made only for a master that is this machine itself (``local``); on a cluster
    such a folder would not be shared, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="mediatide-ckpt-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is shuffled and merged, whatever size is expected of either side.

    Spark expects what the compressed files behind a frame hold, even after :func:`cut`. Repeated values, forms made of
    them and exploded rows are many times that, and a side wrongly taken for small is gathered in the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Give a frame that arrives in fewer partitions than there are cores one partition a core.

    Python stages are bound by CPU, and a small table is often one file with one row group. Large inputs
    have more splits than cores and are passed on as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
