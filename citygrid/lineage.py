"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is set, but only if driver and
    executors are one process: on a cluster they do not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A lost executor then costs a reread instead of a recomputation.
    """
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Shelf:
    """Tables of one job, written to the shared folder and deleted when they are of no more use.

    Unlike a checkpoint such a table is read by column, and its disk is given back in
    the middle of a job.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.home = spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        schema, path = df.schema, f"{self.home}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables ("": all), and shuffle files that nothing refers to any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()
