"""Claim extraction records: prompts, parsing, quote verification, quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.json import json_text
from attestry.functions.injection import smells
from attestry.functions.text import wrap_source
from attestry.operators.classify import json_list_problem

CLAIM_LIST = (
    "array<struct<subject string, predicate string, object string, confidence string,"
    " sources array<struct<chunk_id string, quote string>>>>"
)


def wrap_sources(chunks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The fenced chunks of every document in order, as one prompt text per document."""
    block = wrap_source(F.col("chunk_id"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", block.alias("block"))))
    return chunks.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("prompt")
    )


def prompt_selection(documents: DataFrame, prompts: Mapping[str, str]) -> DataFrame:
    """Add ``prompt``: the text for the document's type, else the one for ``other``."""
    chosen = F.lit(prompts["other"])
    for doc_type, text in prompts.items():
        chosen = F.when(F.col("doc_type") == doc_type, F.lit(text)).otherwise(chosen)
    return documents.withColumn("prompt", chosen)


def parse_claims(responses: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(claims, errors)`` of one JSON response per row.

    A response that is no JSON list, or holds an item without one of its parts,
    is an error and yields no claims. ``pos`` is the item's place in the list.
    """
    checked = responses.withColumn("_problem", json_list_problem(F.col("response")))
    items = F.from_json("response", CLAIM_LIST)
    incomplete = F.exists(
        F.col("_items"),
        lambda c: c["subject"].isNull()
        | c["predicate"].isNull()
        | c["object"].isNull()
        | c["confidence"].try_cast("double").isNull()
        | c["sources"].isNull()
        | F.exists(c["sources"], lambda s: s["chunk_id"].isNull() | s["quote"].isNull()),
    )
    parsed = checked.withColumn("_items", items).withColumn(
        "_problem",
        F.coalesce("_problem", F.when(F.coalesce(incomplete, F.lit(True)), F.lit("incomplete item"))),
    )
    errors = parsed.where(F.col("_problem").isNotNull()).select(
        *keys, F.col("_problem").alias("error")
    )
    claims = (
        parsed.where(F.col("_problem").isNull())
        .select(*keys, F.posexplode("_items").alias("pos", "item"))
        .select(
            *keys,
            "pos",
            "item.subject",
            "item.predicate",
            "item.object",
            F.col("item.confidence").cast("float").alias("confidence"),
            "item.sources",
        )
    )
    return claims, errors


def verify_quotes(candidates: DataFrame, chunks: DataFrame, key: str = "claim_id") -> DataFrame:
    """Add ``verified``: the claim has sources, and each quotes a chunk of its document exactly.

    ``candidates`` has ``key``, ``doc_id`` and ``sources``. One wrong source
    rejects the whole claim.
    """
    cited = candidates.select(key, "doc_id", F.explode("sources").alias("source")).select(
        key,
        "doc_id",
        F.col("source.chunk_id").cast("string").alias("_chunk"),
        F.col("source.quote").alias("_quote"),
    )
    texts = chunks.select("doc_id", F.col("chunk_id").cast("string").alias("_chunk"), "text")
    # an inner join: chunks that nobody cites are left out before their texts move
    # Claims are the small side and texts stream past them: no text is sorted, and none spills.
    held = (
        cited.hint("shuffle_hash").join(texts, ["doc_id", "_chunk"])
        .where(F.contains(F.col("text"), F.col("_quote")))
        .groupBy(key)
        .agg(F.count("*").alias("_held"))
    )
    every = (F.size("sources") > 0) & (F.size("sources") == F.col("_held"))
    return (
        candidates.join(held, key, "left")
        .withColumn("verified", F.coalesce(every, F.lit(False)))
        .drop("_held")
    )


def accepted_claims(verified: DataFrame) -> DataFrame:
    return verified.where("verified").drop("verified")


def rejected_claims(verified: DataFrame, key: str = "claim_id") -> DataFrame:
    """One audit record per rejected claim, sources included."""
    return verified.where(~F.col("verified")).select(
        "run_id",
        key,
        F.lit("claim_rejected_bad_quote").alias("event_type"),
        json_text(
            F.struct(
                F.col("doc_id").cast("string").alias("document_id"),
                "subject",
                "predicate",
                "object",
                "sources",
            )
        ).alias("payload"),
    )


def split_claims_sources(accepted: DataFrame, key: str = "claim_id") -> tuple[DataFrame, DataFrame]:
    """Accepted claims as the ``claims`` and ``claim_sources`` tables.

    A claim's sources come from one response item, so the second quote of a
    chunk is dropped inside the row, without a shuffle.
    """
    claims = accepted.select(
        key, "run_id", "corpus_id", "subject", "predicate", "object", F.col("confidence").cast("float")
    )
    first_per_chunk = F.filter(
        F.col("sources"),
        lambda s, i: F.array_position(F.transform(F.col("sources"), lambda t: t["chunk_id"]), s["chunk_id"])
        == i + 1,
    )
    sources = accepted.select(key, F.explode(first_per_chunk).alias("source")).select(
        key, "source.chunk_id", "source.quote"
    )
    return claims, sources


def scan_injection(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per pattern that a text matches, with the first match."""
    return texts.select(*keys, F.inline(smells(F.col(text))))


def quarantine_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clean, findings)``: a response with any smell is set aside with a warning.

    ``responses``: ``run_id, doc_id, response``. The smells are computed in the
    row itself; nothing is shuffled.
    """
    # a generator, unlike a projection, is not repeated in the filters above it
    scanned = responses.select("*", F.explode(F.array(smells(F.col("response")))).alias("_smells"))
    clean = scanned.where(F.size("_smells") == 0).drop("_smells")
    listed = F.array_join(
        F.transform(
            F.col("_smells"),
            lambda s: F.concat(F.lit("('"), s["category"], F.lit("', '"), s["excerpt"], F.lit("')")),
        ),
        ", ",
    )
    document = F.col("doc_id").cast("string")
    findings = scanned.where(F.size("_smells") > 0).select(
        "run_id",
        F.lit("possible_prompt_injection").alias("rule_id"),
        F.lit("warning").alias("severity"),
        document.alias("subject"),
        F.concat(
            F.lit("extract: possible prompt injection smell in LLM response for document "),
            document,
            F.lit(": ["),
            listed,
            F.lit("]"),
        ).alias("message"),
    )
    return clean, findings
