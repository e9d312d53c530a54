"""Document classification: request batches, response checks, escalation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.json import json_text
from attestry.functions.ordering import position

BATCH_SIZE = 3
ESCALATION_THRESHOLD = 0.5

# Allowed document types. Fixed values.
DOC_TYPES = [
    "prd",
    "techspec",
    "ticket_export",
    "meeting_notes",
    "release_notes",
    "postmortem",
    "other",
]


def classification_batches(
    documents: DataFrame,
    block: Column,
    groups: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("doc_id",),
    size: int = BATCH_SIZE,
) -> DataFrame:
    """Requests of ``size`` documents each: ``groups, batch, payload``."""
    placed = position(documents, groups, order, block, "_position")
    item = F.struct(F.col("doc_id").cast("string").alias("document_id"), "filename")
    ordered = F.array_sort(F.collect_list(F.struct("_position", item.alias("item"))))
    return (
        placed.withColumn("batch", F.floor(F.col("_position") / size))
        .groupBy(*groups, "batch")
        .agg(json_text(F.transform(ordered, lambda p: p["item"])).alias("payload"))
    )


def json_list_problem(response: Column) -> Column:
    """Why a response is not a JSON list; null when it is one.

    The JSON reader stops after the first value. Text behind it is found by
    reading the response once as an array item and once as an object member:
    only a single complete value fits both.
    """
    item = F.try_parse_json(F.concat(F.lit("["), response, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v": '), response, F.lit("}")))
    return F.when(item.isNull() | member.isNull(), F.lit("not JSON")).when(
        ~F.startswith(F.schema_of_variant(item), F.lit("ARRAY<ARRAY")), F.lit("not a list")
    )


def parse_classifications(
    responses: DataFrame, requested: DataFrame, keys: Sequence[str] = ("run_id", "batch")
) -> tuple[DataFrame, DataFrame]:
    """``(rows, errors)`` of JSON responses; a batch with an error yields no rows.

    ``requested``: ``keys`` and ``document_id`` of every document asked for.
    Errors name a response that is no JSON list, an item with a missing part, a
    document outside the batch, a type outside the allowed seven, and a
    requested document without an answer.
    """
    keys = list(keys)
    # a batch asks for a handful of documents, so all of it is judged in its row
    asked = requested.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.col("document_id").cast("string"))).alias("_asked")
    )
    schema = "array<struct<document_id string, doc_type string, confidence string>>"
    problem = F.col("_problem")

    def item_error(item: Column) -> Column:
        confidence = item["confidence"].try_cast("double")
        error = (
            F.when(
                item["document_id"].isNull() | item["doc_type"].isNull() | confidence.isNull(),
                F.lit("incomplete item"),
            )
            .when(~F.array_contains("_asked", item["document_id"]), F.lit("document not in batch"))
            .when(~item["doc_type"].isin(DOC_TYPES), F.lit("unknown type"))
        )
        return F.struct(item["document_id"].alias("document_id"), error.alias("error"))

    answered = F.transform("_items", lambda item: item["document_id"])
    missing = F.transform(
        F.array_except("_asked", answered),
        lambda d: F.struct(d.alias("document_id"), F.lit("missing document").alias("error")),
    )
    wrong = F.filter(F.transform("_items", item_error), lambda e: e["error"].isNotNull())
    broken = F.array(F.struct(F.lit(None).cast("string").alias("document_id"), problem.alias("error")))
    judged = (
        responses.join(asked, keys)
        .withColumn("_problem", json_list_problem(F.col("response")))
        .withColumn("_items", F.from_json("response", schema))
        .select(
            *keys,
            "_items",
            F.explode(
                F.array(F.when(problem.isNotNull(), broken).otherwise(F.concat(wrong, missing)))
            ).alias("_errors"),
        )
    )
    errors = judged.select(*keys, F.inline("_errors"))
    rows = (
        judged.where(F.size("_errors") == 0)
        .select(*keys, F.posexplode("_items").alias("_pos", "_item"))
        .groupBy(*keys, F.col("_item.document_id").alias("document_id"))
        # of two answers on one document the later one stands
        .agg(F.max_by(F.struct("_item.doc_type", "_item.confidence"), "_pos").alias("_last"))
        .select(*keys, "document_id", "_last.doc_type", F.col("_last.confidence").cast("double").alias("confidence"))
    )
    return rows, errors


def apply_doc_types(documents: DataFrame, classifications: DataFrame) -> DataFrame:
    """Documents with the classified type; the others keep theirs."""
    fresh = classifications.select(
        F.col("document_id").cast(documents.schema["doc_id"].dataType).alias("doc_id"),
        F.col("doc_type").alias("_type"),
    )
    return (
        documents.join(fresh, "doc_id", "left")
        .withColumn("doc_type", F.coalesce("_type", "doc_type"))
        .drop("_type")
    )


def low_confidence_escalations(classifications: DataFrame) -> DataFrame:
    """Classifications a person should look at."""
    return classifications.where(F.col("confidence") < ESCALATION_THRESHOLD)


def escalation_events(classifications: DataFrame) -> DataFrame:
    """``classify_escalated`` audit records, one per document and not one list per run."""
    return low_confidence_escalations(classifications).select(
        "run_id",
        F.lit("classify_escalated").alias("event_type"),
        json_text(F.struct("document_id", "doc_type", "confidence")).alias("payload"),
    )


def classification_review_flags(classifications: DataFrame) -> DataFrame:
    """Per run: whether any classification needs a person, and how many do."""
    low = F.col("confidence") < ESCALATION_THRESHOLD
    return classifications.groupBy("run_id").agg(
        F.bool_or(low).alias("needs_review"), F.count_if(low).alias("escalated")
    )
