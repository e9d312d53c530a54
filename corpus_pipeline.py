"""A training corpus from raw documents: language, deduplication, decontamination, mixture, shards.

Every stage takes the documents that its predecessor kept, decides on each of
them, and returns those it keeps; the last one adds shard and slot. A stage's input may
hold repeated rows, null ids, texts or sources, and further columns: they are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, language, mixing, neardup, shard
from attestry.llm.bloom import maybe_in
from attestry.llm.storage import bounded_batches, files_of, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out texts in which no language can be told: null, or without a letter.

    Without a labelled row no language is known, and texts with a letter stay all the same.
    """
    bounded_batches(spark)
    model = language.train_languages(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = language.label_texts(docs, model, carry=True)
    return labelled.where(F.col("lang_pred") != language.UNDETERMINED).select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as ``row``, so that no column of theirs is mistaken, with what they are joined by: id and text.

    A null id is the text of length 0, and so is a null text.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), "doc_id", number.alias("_id"), text.alias("_text"))


def once(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of one id and text as one. ``listed`` holds ``_id, _text`` of every row.

    Only rows whose id and text several rows may have are shuffled for it.
    """
    both = F.xxhash64("_id", "_text").alias("_both")
    several = listed.groupBy("_id", "_text").agg(F.count("*").alias("n")).where("n > 1").select(both)
    several = stored(several, "repeated-rows", files_of(listed.count()))
    flagged = keyed(docs).withColumn("_both", both).withColumn("_maybe", maybe_in(several, "_both"))
    columns = ["row", "_id", "_text"]
    some = flagged.where("_maybe").select(columns).dropDuplicates(["_id", "_text"])
    return flagged.where("not _maybe").select(columns).unionByName(some)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles: that of the smallest id.

    Rows of one id and text are one document. Rows without an id all stay. Only rows that may have to go are
    shuffled: those whose id a filter of the dropped and repeated ids holds.
    """
    bounded_batches(spark)
    found = neardup.near_duplicates(docs, width=5, percent=80).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    touched = stored(ids.where("not kept or n > 1"), "touched-ids", files_of(docs.count()))
    flagged = keyed(docs).withColumn(
        "_touched", maybe_in(touched.select("doc_id"), "doc_id") & F.col("doc_id").isNotNull()
    )
    some = flagged.where("_touched").join(touched.where("not kept").select("doc_id"), "doc_id", "left_anti")
    some = some.dropDuplicates(["_id", "_text"]).select("row")
    return flagged.where("not _touched").select("row").unionByName(some).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark window."""
    bounded_batches(spark)
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.where(F.size("hits") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, from not at all to three times."""
    bounded_batches(spark)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    taken = stored(mixing.mix_sources(docs).select(number, F.col("text_key").alias("_text"), "size", "taken"), "taken")
    copies = taken.where("taken > 0").groupBy("_id", "_text").agg(F.sum(F.expr("taken div size")).cast("int").alias("_copies"))
    found = once(docs, taken).join(copies, ["_id", "_text"])
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def split_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; columns of these names are replaced."""
    bounded_batches(spark)
    placed = shard.assign_shards(docs, SHARDS)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    placed = stored(placed.select(number, F.col("text_key").alias("_text"), "shard", "slot"), "placed", files_of(docs.count()))
    return once(docs.drop("shard", "slot"), placed).join(placed, ["_id", "_text"]).select("row.*", "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix),
    ("shards", split_shards),
]

#: Language labels come from a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
