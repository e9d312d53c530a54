"""Dense numbers for distinct values of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.storage import stored

#: Parts of the values, by hash; as many counts are summed in one place.
BUCKETS = 4096


def numbered(values: DataFrame, key: str, name: str) -> DataFrame:
    """``key, number`` for every distinct value of ``key``, numbered from 0 without gaps.

    Values are dealt into buckets by hash and ordered inside theirs; a bucket begins where the
    buckets before it end. The table is written, so a number stays what it is.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket")
    rows = stored(values.select(key).distinct().select(key, bucket), f"{name}-values")
    # At most BUCKETS rows.
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begins"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    found = rows.withColumn("_place", place).join(F.broadcast(starts), "_bucket")
    return stored(found.select(key, (F.col("_begins") + F.col("_place") - 1).alias("number")), f"{name}-numbers")
