"""Preparing chunks for an embedding function and pricing model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.ordering import position

BATCH_SIZE = 96

# Prices in US dollars per million tokens (equal to micro-dollars per token).
# Fixed values; an unlisted model is charged like the default one.
INPUT_PRICE = 3
OUTPUT_PRICE = 15
EMBED_PRICE_CENTS = 6
MAX_OUTPUT_TOKENS = 8192


def embedding_batches(
    chunks: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column, size: int = BATCH_SIZE
) -> DataFrame:
    """Number chunks into batches of ``size`` along ``order``; the last one is short."""
    placed = position(chunks, groups, order, block, "_position")
    return placed.withColumn("batch", F.floor(F.col("_position") / size)).drop("_position")


def embed_chunks(
    chunks: DataFrame,
    embed_fn: Callable[[list[str]], list[list[float]]],
    key: str = "chunk_id",
    size: int = BATCH_SIZE,
) -> DataFrame:
    """Vectors of all chunks from a caller's function, ``size`` texts per call.

    A failing or short answer fails the task, and with it the job, so a single
    write of the result stores all vectors or none.
    """
    key_type = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size]
                vectors = embed_fn(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts but {len(vectors)} vectors")
                yield pd.DataFrame({key: part[key].tolist(), "embedding": list(vectors)})

    return chunks.select(key, "text").mapInPandas(run, schema=f"{key} {key_type}, embedding array<float>")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("long")


def embed_micro_usd(tokens: Column) -> Column:
    """Price of embedding ``tokens``, rounded half up to a millionth of a dollar."""
    return F.floor((tokens * EMBED_PRICE_CENTS + 50) / 100).cast("long")


def as_usd(micro: Column) -> Column:
    return (micro.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(20,6)")


def embed_cost(chunks: DataFrame, groups: Sequence[str] = ("run_id",)) -> DataFrame:
    """One cost row per run for embedding its chunks."""
    totals = chunks.groupBy(*groups).agg(F.sum(estimated_tokens(F.col("text"))).alias("input_tokens"))
    micro = embed_micro_usd(F.col("input_tokens"))
    return totals.select(
        *groups,
        F.lit("embed").alias("stage"),
        "input_tokens",
        F.lit(0).cast("long").alias("output_tokens"),
        micro.alias("micro_usd"),
        as_usd(micro).alias("usd_cost"),
    )


def llm_call_cost(
    calls: DataFrame,
    prices: Mapping[str, tuple[int, int]] | None = None,
    default: tuple[int, int] = (INPUT_PRICE, OUTPUT_PRICE),
) -> DataFrame:
    """Price every call by its model; models outside ``prices`` use ``default``.

    The price list is configuration, so it becomes part of the expression.
    """
    model = F.col("model")
    per_input, per_output = F.lit(default[0]), F.lit(default[1])
    for name, (price_in, price_out) in (prices or {}).items():
        per_input = F.when(model == name, F.lit(price_in)).otherwise(per_input)
        per_output = F.when(model == name, F.lit(price_out)).otherwise(per_output)
    micro = F.col("input_tokens") * per_input + F.col("output_tokens") * per_output
    return calls.withColumn("micro_usd", micro.cast("long")).withColumn("usd_cost", as_usd(F.col("micro_usd")))
