"""Live run status: stage, cost and the event feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.operators.reports import TERMINAL_EVENTS, current_stage
from attestry.streaming.keyed import KeyedLog
from attestry.streaming.sink import start, write_batch


def stream_current_stage(events: DataFrame, folder: str, **options) -> StreamingQuery:
    """Current stage per run, kept up to date below ``folder``/stage.

    State is one row per run; ``newest_per_key`` reads the result.
    """
    return start(
        current_stage(events),
        lambda batch, number: write_batch(batch, f"{folder}/stage", number),
        f"{folder}/_stage_checkpoint",
        "update",
        **options,
    )


def stream_run_cost(costs: DataFrame, folder: str, **options) -> StreamingQuery:
    """Cost sums per run and stage, kept up to date below ``folder``/cost."""
    sums = costs.groupBy("run_id", "stage").agg(
        F.count("*").alias("calls"),
        *[F.sum(c).alias(c) for c in ["input_tokens", "output_tokens", "latency_ms", "micro_usd"]],
    )
    return start(
        sums,
        lambda batch, number: write_batch(batch, f"{folder}/cost", number),
        f"{folder}/_cost_checkpoint",
        "update",
        **options,
    )


def stream_run_events(
    events: DataFrame, folder: str, compact_every: int = 16, keep_batches: int = 1024, **options
) -> StreamingQuery:
    """The feed of every run up to and including its first terminal event.

    A source read from its start replays history and then follows. Runs that
    have ended are a table of their own (``folder``/closed) in buckets, and a batch reads those of its own runs: a run
    with a third of all events stays spread over tasks, which a grouped state function would not allow. Every
    ``compact_every`` batches the table is written together, without the runs that ended more than ``keep_batches``
    batches ago: by then a run sends nothing any more.
    """

    def handle(batch: DataFrame, number: int) -> None:
        log = KeyedLog(batch.sparkSession, f"{folder}/closed", ["run_id"])
        if number and number % compact_every == 0:
            log.compact(number - 1, F.col("ended_in") > number - keep_batches)
        closed = log.rows(number, log.buckets_of(batch))
        live = batch if closed is None else batch.join(closed.select("run_id"), "run_id", "left_anti")
        ends = (
            live.where(F.col("event_type").isin(TERMINAL_EVENTS))
            .groupBy("run_id")
            .agg(F.min("id").alias("last_id"), F.lit(number).alias("ended_in"))
        )
        shown = (
            live.join(ends.drop("ended_in"), "run_id", "left")
            .where(F.col("last_id").isNull() | (F.col("id") <= F.col("last_id")))
            .drop("last_id")
        )
        write_batch(shown, f"{folder}/feed", number)
        log.append(ends, number)
        log.commit(number)

    return start(events, handle, f"{folder}/_feed_checkpoint", **options)
