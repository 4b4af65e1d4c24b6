"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the cluster's ``spark.checkpoint.dir`` when it names one.

    A temporary folder is made only in local mode, where driver and executors
    are one process; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="seqcohort-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: used by the iterative operators,
    and where two branches of one plan must see the same values.

    A written table outlives executors, and the optimizer sees its true size, which keeps
    estimates of iterated joins from growing without bound and broadcasts honest.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove the tables of settled frames that nothing reads any more, such as those of the
    rounds before; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_settled", None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def checksum(df: DataFrame) -> tuple:
    """Number of rows and an order-free checksum: equal for equal tables."""
    row = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(row, F.lit(1)))).first())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows to the full number of shuffle partitions. Rows in front of numeric work
    are small, so merging partitions by bytes would leave all of it to one task."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):
        n = min(n, 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
