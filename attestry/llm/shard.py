"""Shards of near equal size from sampled splitters.

A row's key is the hash of its text, then of its id, so equal texts are
neighbours. A size-weighted sample of keys gives quantile boundaries, which cut
the key order into many ranges; a range whose exact size turns out overfull is
subdivided. Ranges are laid end to end by their exact sizes and cut where the
running size passes a shard's share. Groups of equal texts stay in one shard
as long as a shard can hold them; larger groups are subdivided too.
"""

from __future__ import annotations

import bisect

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.ordering import position, running_total
from attestry.llm.storage import files_of, stored

#: Expected number of sampled keys on the driver, at any input size.
SAMPLE = 20_000
#: Ranges per shard.
FINE = 32
#: A group above this part of a shard is placed by itself; by bytes or by rows, so at most twice ``shards / HEAVY`` groups are.
HEAVY = 1 / 400
#: Rows of one text that a task orders at once; a group of no more is never placed by itself for its rows.
LIGHT_ROWS = 1000


def _unit(hashed: Column) -> Column:
    """A 64-bit hash as a number of [0, 1), in the same order."""
    return (hashed.cast("double") + F.lit(2.0**63)) / 2.0**64


def keyed_rows(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids, sizes and keys; no text."""
    text = F.col(text_column)
    return documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_group"),
        F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("_tie"),
        # Tells rows without an id apart; the rows are written, so it stays.
        F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.monotonically_increasing_id().cast("string"))).alias("_spread"),
    )


def sampled_splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Size-weighted quantiles of the group key, from about ``SAMPLE`` keys.

    A row is drawn with probability in proportion to its size, and stands for
    its size divided by that probability.
    """
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(SAMPLE / max(total, 1)))
    draw = _unit(F.xxhash64("_tie", "_group", F.lit("draw")))
    drawn = rows.where(draw < chance).select("_group", (F.col("size") / chance).alias("weight"))
    keys = sorted((r[0], r[1]) for r in drawn.collect())
    mass = sum(w for _, w in keys)
    splitters, run = [], 0.0
    for key, weight in keys:
        run += weight
        if run > mass * (len(splitters) + 1) / ranges and len(splitters) < ranges - 1 and key not in splitters[-1:]:
            splitters.append(key)
    return splitters


def heavy_groups(rows: DataFrame, bytes_: float, count: float) -> list[tuple[int, int]]:
    """Groups of more than ``bytes_`` or more than ``count`` rows; of either there are fewer than the total by that."""
    sizes = rows.groupBy("_group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sizes = sizes.where((F.col("size") > bytes_) | (F.col("n") > count))
    return [(r[0], r[1]) for r in sizes.collect()]


def listed(spark: SparkSession, rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """A short list as a table, sent as Arrow data: no Python process on the executors turns it into rows."""
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, fields, strict=True)}))


def assign_shards(
    documents: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, text_key`` per row: shards of near equal total size.

    Size is the UTF-8 length plus one; a null text counts as empty, and null
    and empty texts are one group. Rows of one group share a shard unless the group
    is larger than what a shard can still hold. Slots number a shard's rows from 0
    without gaps. Equal rows are numbered in any order among themselves. An
    empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    rows = stored(keyed_rows(documents, id_column, text_column), "shard-keys")
    total, number = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    share = total / shards
    ranges = FINE * shards

    load, whole, split = [0] * shards, [], [(0, False)]
    for group, size in sorted(heavy_groups(rows, share * HEAVY, max(number * HEAVY / shards, LIGHT_ROWS)), key=lambda x: (-x[1], x[0])):
        least = min(range(shards), key=lambda s: (load[s], s))
        if load[least] + size <= share:
            load[least] += size
            whole.append((group, least))
        else:
            split.append((group, True))
    placed = listed(spark, whole, [("_group", pa.int64()), ("_whole", pa.int32())])
    loose = listed(spark, split, [("_group", pa.int64()), ("_split", pa.bool_())]).where("_split")
    # Both lists are shorter than twice shards / HEAVY.
    rows = rows.join(F.broadcast(placed), "_group", "left").join(F.broadcast(loose), "_group", "left")

    splitters = sampled_splitters(rows, total, ranges)

    @F.pandas_udf(T.LongType())
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(splitters, k) for k in key], dtype="int64")

    # Else the inner join below lets Spark test it for null ahead of taking it: two Python processes a task.
    rows = rows.withColumn("_range", range_of.asNondeterministic()("_group"))
    filled = rows.groupBy("_range").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n")).collect()
    # Parts so that neither bytes nor rows of a range exceed its due; at most twice as many as ranges.
    count = sum(r["_n"] for r in filled)
    parts = {
        r["_range"]: 1 + int(max(r["_sum"] * ranges / max(total, 1), r["_n"] * ranges / max(count, 1)))
        for r in filled
    }
    cut = listed(spark, list(parts.items()), [("_range", pa.int64()), ("_parts", pa.int64())])
    edges = [-(2**63), *splitters, 2**63]
    bounds = listed(
        spark,
        [(i, float(edges[i]), float(edges[i + 1] - edges[i])) for i in range(len(splitters) + 1)],
        [("_range", pa.int64()), ("_low", pa.float64()), ("_width", pa.float64())],
    )
    rows = rows.join(F.broadcast(cut.join(bounds, "_range")), "_range")
    within = F.floor((F.col("_group").cast("double") - F.col("_low")) / F.col("_width") * F.col("_parts"))
    tied = F.floor(_unit(F.col("_spread")) * F.col("_parts"))
    hot = F.coalesce(F.col("_split"), F.lit(False)) | F.col("_whole").isNotNull()
    step = F.lit(2**20)
    rows = rows.withColumn(
        "_cell",
        (F.col("_range") * step + F.least(F.greatest(within, F.lit(0)), F.col("_parts") - 1)) * step
        + F.when(hot, tied + 1).otherwise(0),
    ).select("doc_id", "size", "text_crc32", "_group", "_tie", "_whole", "_split", "_cell")

    order = ["_group", "_tie", "doc_id", "size", "text_crc32"]
    light = running_total(
        rows.where("_whole is null").withColumn("_all", F.lit(0)), ["_all"], order, F.col("_cell"), F.col("size"), "_ahead"
    )
    # A group of equal texts moves as one: by the middle of its stretch, or of the row's where it is split.
    kept = light.where("_split is null").withColumn("_sizes", F.sum("size").over(_group_window()))
    kept = kept.withColumn("_middle", F.min("_ahead").over(_group_window()) + F.col("_sizes") / 2).drop("_sizes")
    spread = light.where("_split is not null").withColumn("_middle", F.col("_ahead") + F.col("size") / 2)
    room, reach = [], 0.0
    for used in load:
        reach += max(0.0, share - used)
        room.append(reach)
    shard = F.lit(0)
    for edge in room[:-1]:
        shard = shard + F.when(F.col("_middle") >= edge, 1).otherwise(0)
    done = kept.unionByName(spread).withColumn("shard", shard.cast("int"))
    out = ["doc_id", "size", "text_crc32", "_group", "_tie", "_cell", "shard"]
    done = done.select(out).unionByName(
        rows.where("_whole is not null").withColumn("shard", F.col("_whole")).select(out)
    )
    done = stored(done, "sharded", files_of(number))
    return position(done, ["shard"], order, F.col("_cell"), "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot", F.col("_group").alias("text_key")
    )


def _group_window() -> WindowSpec:
    return Window.partitionBy("_cell", "_group")
