"""Sources mixed to target weights by weighted fair queueing.

Every document waits in its source's queue, in shuffled order, up to
``max_repeats`` times over. Its virtual finish time is the source's running
size divided by the source's weight. In order of finish time, documents are taken until the
total budget is reached; a source that runs out leaves its share to the others.

The order is never built as a whole: finish times are cut into ranges, range
totals show where the budget ends, only the range at the cut is refined and
ordered, and every document is compared with the last one taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.ordering import running_total
from attestry.llm.storage import files_of, stored

WEIGHTS = (5, 2, 1)
#: Ranges that the finish times are cut into, in each round of refinement.
RANGES = 1024
#: Rows that may be ordered in one task at the cut.
ORDERED = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """Add number, weight and target to ``source, source_size``.

    Sources are numbered by code point, null last, and weights repeat. Targets
    share all sizes by weight; a target stops at ``max_repeats`` times its
    source, and what is over is shared again among the others. With t the time at
    which the others' shares are w * t, a source is full when its limit / w is below t;
    sorted by that ratio, the first source that is not full gives t.
    """
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    limited = numbered.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * max_repeats)
    limited = limited.withColumn("_ratio", F.col("_limit") / F.col("weight"))
    order = Window.orderBy("_ratio", "source_no")
    everything = Window.partitionBy()
    level = limited.withColumn(
        "_level",
        (
            F.sum("source_size").over(everything)
            - F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    )
    level = level.withColumn("_time", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_no", "_level"))).over(everything)["_level"])
    target = F.least(F.col("_limit").cast("double"), F.col("weight") * F.col("_time"))
    return level.select("source", "source_no", "source_size", "weight", target.alias("target"), F.col("_time").alias("level"))


def mix_sources(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = 3,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row; ``taken`` counts repeated words.

    Sizes are words; null and empty texts have none and take part with zero. A null
    source is a source of its own. Repeated rows are separate documents. Rows without an id are queued last, by text. Equal input gives
    equal output, except that equal rows may change places. An empty
    table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    number = F.col(id_column).cast("string")
    # Rows without an id wait behind the others, by their texts.
    place = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), number)), F.concat(F.lit("~"), F.lpad(F.hex(F.xxhash64(text)), 16, "0")))
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).alias("source"),
        F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("size"),
        place.alias("place"),
        F.xxhash64(text).alias("text_key"),
    )
    rows = stored(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(source_targets(sizes, weights, max_repeats), "mix-sources")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    level = sources.agg(F.max("level")).first()[0] or 0.0

    named = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "size", "place", "text_key", "source_no", "source_size", "weight", "target"
    )
    # Equal rows are one entry of the queue, however many there are.
    same = ["source_no", "place", "text_key", "size", "doc_id", "source_size", "weight", "target"]
    entries = named.groupBy(*same).agg(F.count("*").alias("n"))
    queue = running_total(
        entries, ["source_no"], ["place", "text_key", "size"], F.substring("place", 1, 3), F.col("size") * F.col("n"), "before"
    )
    queue = stored(every_copy(stored(queue, "mix-entries", files_of(rows.count()))), "mix-queue")

    def finish(turn: int | F.Column) -> F.Column:
        return (F.lit(turn) * F.col("source_size") + F.col("before") + F.col("size")) / F.col("weight")

    turns = queue.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    turns = turns.select(
        F.struct(finish(F.col("turn")).alias("finish"), "source_no", "turn", "place", "text_key", "size").alias("key"), "size"
    )
    last = cut_at(turns, budget, level)
    taken = F.lit(0).cast("long")
    if last is not None:
        key = F.struct(*[F.lit(v).cast(t) for v, t in zip(last, ("double", "int", "int", "string", "long", "long"), strict=True)])
        for turn in range(max_repeats):
            own = F.struct(finish(turn), "source_no", F.lit(turn), "place", "text_key", "size")
            taken = taken + F.when(own <= key, F.col("size")).otherwise(0)
    return queue.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_key")


def every_copy(entries: DataFrame) -> DataFrame:
    """A row for each of an entry's ``n`` equal rows, one behind the other; very many of them come from several tasks."""
    last = F.col("n") - 1
    few = entries.where(F.col("n") <= ORDERED).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = entries.where(F.col("n") > ORDERED).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(ORDERED).cast("long"))))
    many = many.repartition("place", "_from").withColumn(
        "_copy", F.explode(F.sequence(F.col("_from"), F.least(last, F.col("_from") + ORDERED - 1)))
    )
    copies = few.unionByName(many.drop("_from"))
    return copies.withColumn("before", F.col("before") + F.col("_copy") * F.col("size")).drop("_copy", "n")


def cut_at(turns: DataFrame, budget: int, level: float) -> tuple | None:
    """Key of the last turn that fits into ``budget`` in key order, or None.

    ``level`` is the finish time at which the budget would end if documents were of no size.
    """
    low, high, before = 0.0, max(level * 2, 1.0), 0
    inside = turns
    for _ in range(8):
        width = (high - low) / RANGES
        cut = F.greatest(F.lit(0), F.least(F.lit(RANGES), F.floor((F.col("key.finish") - low) / width)))
        sums = inside.groupBy(cut.alias("part")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        spent = None
        for part, total, n in sorted(sums.collect()):
            if before + total > budget:
                spent = (part, n)
                break
            before += total
        if spent is None:
            break
        inside = inside.where(cut == spent[0])
        if spent[1] <= ORDERED or width <= abs(high) * 1e-12 or spent[0] == RANGES:
            break
        low, high = low + spent[0] * width, low + (spent[0] + 1) * width
    if spent is None:
        last = turns.agg(F.max("key")).first()[0]
        return tuple(last) if last is not None else None
    run = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before
    last = inside.select("key", run.alias("run")).where(F.col("run") <= budget).agg(F.max("key")).first()[0]
    if last is None:
        first = inside.agg(F.min("key")).first()[0]
        last = turns.where(F.col("key") < F.struct(*[F.lit(v).cast(t) for v, t in zip(first, ("double", "int", "int", "string", "long", "long"), strict=True)])).agg(F.max("key")).first()[0]
    return tuple(last) if last is not None else None
