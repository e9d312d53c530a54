"""Writing micro-batches as folders that a repeated batch replaces.

A batch that is run again after a failure writes the folder of its own number
once more, so every table here holds each batch exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def read_batch(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """One written batch."""
    return spark.read.parquet(f"{folder}/batch={batch_id}")


def read_batches(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """All written batches (or those before one), or None when there is none yet.

    Only a folder that does not exist means none; any other problem is raised.
    """
    if before == 0:
        return None
    try:
        found = spark.read.parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found if before is None else found.where(F.col("batch") < before)


def newest_per_key(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of every key: the state of an update-mode aggregation."""
    written = spark.read.parquet(folder)
    rest = [c for c in written.columns if c not in keys and c != "batch"]
    return (
        written.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        .select(*keys, "_row.*")
    )


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``handle`` per micro-batch; by default until the present input is used up."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
