"""Tables of a stream that grow by deltas and are read by key.

A batch adds a delta with the rows it touched, laid in hash buckets of their key. A later batch reads the buckets of its
own keys only, and of every key the rows of the newest delta. Compaction writes the newest rows as a base, from
which reading starts; a pointer, written last, says which base that is.

Below a table's folder: ``delta/batch=n/bucket=b``, ``base/batch=n/bucket=b`` and ``pointer/batch=n``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.streaming.sink import read_batches

BUCKETS = 64
#: The batch number of what a table holds before its first batch.
BEGINNING = -1


class KeyedLog:
    """One such table. ``schema`` may be left out where the table has been written."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = (), schema: T.StructType | None = None):
        self.spark, self.folder, self.keys, self.schema = spark, folder, list(keys), schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` lie in, at most ``BUCKETS`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def pointer(self, before: int | None = None) -> T.Row | None:
        """The newest pointer, or None if nothing was written yet."""
        if before is not None and before <= BEGINNING:
            return None
        found = read_batches(self.spark, f"{self.folder}/pointer")
        if found is None:
            return None
        found = found if before is None else found.where(F.col("batch") < before)
        return found.orderBy(F.desc("batch")).first()

    def point(self, batch: int, base: int) -> None:
        """Say that the table is whole up to ``batch``, read from ``base`` on."""
        row = [(base, self.keys, json.dumps(self.schema.jsonValue()))]
        pointer = self.spark.createDataFrame(row, "base long, keys array<string>, layout string")
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointer/batch={batch}")

    def _write(self, rows: DataFrame, part: str, batch: int) -> None:
        self.schema = rows.schema
        placed = rows.withColumn("bucket", self.bucket())
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{part}/batch={batch}")

    def begin(self, rows: DataFrame) -> None:
        """What the table holds before its first batch; written once."""
        if self.pointer() is None:
            self._write(rows, "base", BEGINNING)
            self.point(BEGINNING, BEGINNING)

    def append(self, rows: DataFrame, batch: int) -> None:
        """The delta of a batch; one that is run again replaces its own. ``point`` makes it count."""
        self._write(rows, "delta", batch)

    def commit(self, batch: int) -> None:
        """All deltas up to ``batch`` are whole."""
        found = self.pointer(batch)
        self.point(batch, BEGINNING if found is None else found["base"])

    def _part(self, part: str, wanted: Column, buckets: Sequence[int] | None) -> DataFrame:
        layout = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        try:
            found = self.spark.read.schema(layout).parquet(f"{self.folder}/{part}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], layout)
        # Both are folders, so only the files of these batches and buckets are read.
        found = found.where(wanted)
        return found if buckets is None else found.where(F.col("bucket").isin(list(buckets)))

    def rows(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of the base and of later deltas before batch ``before``, with ``batch``; None if nothing was written."""
        found = self.pointer(before)
        if found is None:
            return None
        self.schema = self.schema or T.StructType.fromJson(json.loads(found["layout"]))
        self.keys = self.keys or list(found["keys"])
        batch, base = F.col("batch"), found["base"]
        last = found["batch"] if before is None else before - 1
        held = self._part("base", batch == base, buckets)
        return held.unionByName(self._part("delta", (batch > base) & (batch <= last), buckets)).drop("bucket")

    def newest(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Of every key, the rows of its newest batch; None if nothing was written."""
        found = self.rows(before, buckets)
        if found is None:
            return None
        newest = F.max("batch").over(Window.partitionBy(*self.keys))
        return found.withColumn("_newest", newest).where("batch = _newest").drop("batch", "_newest")

    def compact(self, batch: int, keep: Column | None = None) -> None:
        """Write the state after ``batch`` as a base; rows for which ``keep`` is not true leave it."""
        state = self.newest(batch + 1)
        if state is not None:
            self._write(state if keep is None else state.where(keep), "base", batch)
            self.point(batch, batch)
