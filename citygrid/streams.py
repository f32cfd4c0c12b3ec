"""Running a streaming plan over what is there now."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citygrid.lineage import shared_folder


def stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """The file or folder at ``path`` as a stream of ``like``'s schema, so many files a batch."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a plain path would have to be a folder
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(pattern)


#: State that is written by key and read by range, which timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(result: DataFrame, mode: str, each: Callable[[DataFrame, int], DataFrame] | None = None, watch: Callable[[dict], None] | None = None) -> DataFrame:
    """All rows that the streaming ``result`` puts out until its source is drained, with the
    number of their batch as ``_batch``. Rows and progress are kept in the shared folder;
    ``watch`` gets the progress of each batch."""
    spark = result.sparkSession
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        out.write.mode("overwrite").parquet(f"{home}/rows/_batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    for progress in query.recentProgress if watch else []:
        watch(progress)
    return spark.read.schema(result.schema.add("_batch", "long")).parquet(f"{home}/rows")
