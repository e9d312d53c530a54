"""Tables written to the cluster's shared folder, to cut lineage and to compute once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes and rows that go to a task's Python side at once, besides the one row that passes them.
BATCH_BYTES, BATCH_ROWS = 3 << 19, 1000


def bounded_batches(spark: SparkSession) -> None:
    """From now on, what goes to a task's Python side at once is bounded by its bytes, and rows that wait for it by number.

    All operators run with these values; what they give does not depend on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows of a stored table's documents, and shingles of theirs, that stand behind one file at least.
FILE_ROWS, FILE_SHINGLES = 4096, 1_000_000


def files_of(rows: int, shingles: int = 0) -> int:
    """How many files a table needs that is derived from so many documents; it grows with them."""
    return max(1, -(-rows // FILE_ROWS), -(-shingles // FILE_SHINGLES))


def stored(df: DataFrame, name: str, files: int | None = None, group_rows: int | None = None) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back, in at most ``files`` files.

    Later steps read files that every executor reaches, so a lost executor
    costs no recomputation of what came before. Without ``files`` every partition is a file, however small.
    Rows of megabytes need ``group_rows``, the rows of a row group: a writer holds 100 rows before it looks at their
    size, and a reader up to 4096, but neither more than a row group.
    """
    path = shared_dir(df.sparkSession, name)
    if files is not None:
        df = df.coalesce(files)
    writer = df.write.option("compression", "zstd")
    if group_rows is not None:
        writer = writer.option("parquet.block.row.count.limit", str(group_rows))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
