"""Applying review decisions to the register as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from attestry.operators.commit import next_snapshot
from attestry.operators.register import FEATURE
from attestry.operators.review import register_decisions
from attestry.streaming.keyed import KeyedLog
from attestry.streaming.sink import read_batch, start, write_batch


def latest_snapshot(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The register table below ``folder`` after its newest whole batch, or None."""
    return KeyedLog(spark, folder).newest(before)


def stream_commit(
    reviews: DataFrame,
    entries: DataFrame,
    field_sources: DataFrame,
    additions: DataFrame,
    addition_claims: DataFrame,
    changes: DataFrame,
    folder: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
    compact_every: int = 8,
    **options,
) -> StreamingQuery:
    """Commit approved proposals batch by batch; ``folder``/entries and /field_sources log what they change.

    One query is the only writer of a register, so commits are serial. A batch reads the entries that its approved
    proposals name, by bucket, and writes those entries and all their field sources as deltas, so what it reads and
    writes does not grow with the register or with the batches before it; every ``compact_every`` batches a new base
    is written. A batch starts from the state before its own number, and so gives the same deltas when it is
    run again. ``prepare`` turns a batch into review rows. Items that an earlier batch decided are listed in
    ``folder``/decided and are not applied a second time.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        decided = KeyedLog(spark, f"{folder}/decided", ["item_id"])
        stored = KeyedLog(spark, f"{folder}/entries", FEATURE)
        backing = KeyedLog(spark, f"{folder}/field_sources", ["entry_id"])
        stored.begin(entries)
        backing.begin(field_sources.select("entry_id", "field", "claim_id"))
        if number and number % compact_every == 0:
            for log in (decided, stored, backing):
                log.compact(number - 1)

        write_batch(batch if prepare is None else prepare(batch), f"{folder}/arrived", number)
        decisions = read_batch(spark, f"{folder}/arrived", number)
        known = decided.rows(number, decided.buckets_of(decisions))
        if known is not None:
            decisions = decisions.join(known.select("item_id"), "item_id", "left_anti")
        added, changed = register_decisions(additions, decisions), register_decisions(changes, decisions)
        write_batch(added.where("status = 'approved'"), f"{folder}/approved_additions", number)
        write_batch(changed.where("status = 'approved'"), f"{folder}/approved_changes", number)
        added = read_batch(spark, f"{folder}/approved_additions", number)
        changed = read_batch(spark, f"{folder}/approved_changes", number)

        named = added.select(*FEATURE).unionByName(changed.select(*FEATURE)).distinct()
        before = stored.newest(number, stored.buckets_of(named)).join(named, FEATURE, "left_semi")
        owners = before.select("entry_id").unionByName(changed.select("entry_id")).distinct()
        sources = backing.newest(number, backing.buckets_of(owners)).join(owners, "entry_id", "left_semi")
        after, sources = next_snapshot(before, sources, added, addition_claims, changed, mode)
        decided.append(decisions.select("item_id").distinct(), number)
        backing.append(sources, number)
        stored.append(after, number)
        for log in (decided, backing, stored):
            log.commit(number)

    return start(reviews, handle, f"{folder}/_commit_checkpoint", **options)
