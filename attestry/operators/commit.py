"""Applying approved proposals to the stored register.

The register is a snapshot: a commit computes the next snapshot from the last
one and is written as a whole by one job. Entries that no approved proposal
names pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.json import json_text
from attestry.operators.register import FEATURE, SINGLE_FIELDS, entry_id


def commit_additions(entries: DataFrame, additions: DataFrame) -> DataFrame:
    """New entries, version 1, of approved additions whose key is not stored yet.

    ``additions`` has ``committed_at`` when the caller stamps it. If two runs
    propose one key, the earlier commit is taken; of one time, the lower run id.
    """
    approved = additions.where(F.col("status") == "approved")
    rest = [c for c in approved.columns if c not in FEATURE]
    stamps = [c for c in ("committed_at", "run_id", "item_id") if c in rest]
    once = (
        approved.groupBy(*FEATURE)
        .agg(F.min_by(F.struct(*rest), F.struct(*stamps)).alias("_a"))
        .select(*FEATURE, "_a.*")
    )
    return once.join(entries.select(*FEATURE), FEATURE, "left_anti").select(
        entry_id().alias("entry_id"),
        *FEATURE,
        "fields",
        F.lit(1).alias("version"),
        F.col("run_id").alias("last_updated_run_id"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def commit_field_changes(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """All entries, with approved changes laid over their fields.

    The version rises by the number of changes applied. ``changes`` carries
    ``committed_at``. Changes of one entry are folded in the shuffle, so an
    entry is rewritten once however many changes it gets; of two changes to one
    field the later commit stands; of one time, the higher run id.
    """
    value = F.col("new_value")
    latest = F.struct("committed_at", "run_id", "item_id")

    def newest(field: str):
        return F.max_by(value, F.when(F.col("field") == field, latest)).alias(f"_{field}")

    fields = ["name", *SINGLE_FIELDS, "open_risks"]
    folded = (
        changes.where(F.col("status") == "approved")
        .groupBy(*FEATURE)
        .agg(
            *[newest(field) for field in fields],
            F.count("*").alias("_applied"),
            F.max_by(F.struct("run_id", "committed_at"), latest).alias("_last"),
        )
    )
    laid_over = F.struct(
        *[
            F.when(F.col(f"_{field}").isNotNull(), F.get(F.col(f"_{field}"), F.lit(0)))
            .otherwise(F.col(f"fields.{field}"))
            .alias(field)
            for field in fields[:-1]
        ],
        F.coalesce("_open_risks", "fields.open_risks").alias("open_risks"),
    )
    hit = F.col("_applied").isNotNull()
    return (
        entries.join(folded, FEATURE, "left")
        .withColumn("fields", F.when(hit, laid_over).otherwise(F.col("fields")))
        .withColumn("version", (F.col("version") + F.coalesce("_applied", F.lit(0))).cast("int"))
        .withColumn("last_updated_run_id", F.coalesce("_last.run_id", "last_updated_run_id"))
        .withColumn("updated_at", F.when(hit, F.col("_last.committed_at")).otherwise(F.col("updated_at")))
        .select(*entries.columns)
    )


def applied_changes(entries: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Approved changes whose entry is stored or new; the others change nothing."""
    present = entries.select(*FEATURE).unionByName(fresh.select(*FEATURE)).distinct()
    return changes.where(F.col("status") == "approved").join(present, FEATURE, "left_semi")


def upsert_field_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored ``(entry_id, field, claim_id)`` rows and the new ones, each once."""
    columns = ["entry_id", "field", "claim_id"]
    return stored.select(columns).unionByName(incoming.select(columns)).dropDuplicates(columns)


def incoming_field_sources(
    new_entries: DataFrame, addition_claims: DataFrame, changes: DataFrame, additions: DataFrame
) -> DataFrame:
    """Backing rows that a commit brings: all of an addition, one per change.

    ``addition_claims``: ``item_id, field, claim_id``; ``changes``: those of ``applied_changes``.
    """
    committed = additions.where(F.col("status") == "approved").join(
        new_entries.select("entry_id", *FEATURE, F.col("last_updated_run_id").alias("run_id")),
        [*FEATURE, "run_id"],
    )
    from_additions = committed.select("entry_id", "item_id").join(
        addition_claims.select("item_id", "field", "claim_id"), "item_id"
    )
    from_changes = changes.where(F.col("status") == "approved").select("entry_id", "field", "claim_id")
    return from_additions.select("entry_id", "field", "claim_id").unionByName(from_changes)


def replace_field_sources(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Variant that drops the old claims of a changed single-valued field first.

    ``changes``: those of ``applied_changes``.
    """
    changed = changes.where((F.col("status") == "approved") & (F.col("field") != "open_risks")).select(
        "entry_id", "field"
    )
    return stored.join(changed, ["entry_id", "field"], "left_anti")


def commit_events(
    entries: DataFrame,
    additions: DataFrame,
    addition_claims: DataFrame,
    changes: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """Audit records of a commit, against the entries stored before it.

    Additions are applied before changes, so a change may target an entry of
    the same commit; a change without an entry is skipped with a reason. An
    approved addition whose key is taken is not committed. A run
    with nothing approved or rejected gets ``commit_skipped``.
    """
    backing = addition_claims.groupBy("item_id").agg(
        F.array_sort(F.collect_set(F.col("claim_id").cast("string"))).alias("claim_ids")
    )

    def record(df: DataFrame, event_type: str, *payload) -> DataFrame:
        return df.select(
            "run_id",
            F.lit(event_type).alias("event_type"),
            json_text(F.struct(*payload)).alias("payload"),
        )

    fresh = commit_additions(entries, additions).select(*FEATURE, "entry_id", F.col("last_updated_run_id").alias("run_id"))
    approved = additions.where(F.col("status") == "approved").join(fresh, [*FEATURE, "run_id"])
    committed = record(
        approved.join(backing, "item_id", "left"),
        "register_entry_committed",
        F.col("entry_id").alias("register_entry_id"),
        "feature_key",
        "fields",
        "claim_ids",
    )
    refused = record(
        additions.where(F.col("status") == "rejected"), "register_entry_rejected", "item_id", "feature_key"
    )
    present = entries.select(*FEATURE).unionByName(fresh.select(*FEATURE)).distinct()
    wanted = changes.where(F.col("status") == "approved")
    updated = record(
        applied_changes(entries, fresh, changes).withColumn("entry_id", entry_id()),
        "register_field_updated",
        F.col("entry_id").alias("register_entry_id"),
        "feature_key",
        "field",
        F.col("old_value").alias("old"),
        F.col("new_value").alias("new"),
        F.array(F.col("claim_id").cast("string")).alias("backed_by_claim_ids"),
    )
    skipped = record(
        wanted.join(present, FEATURE, "left_anti"),
        "register_field_change_skipped",
        "feature_key",
        F.lit("no register_entries row found").alias("reason"),
    )
    refused_changes = record(
        changes.where(F.col("status") == "rejected"),
        "register_field_change_rejected",
        "item_id",
        "feature_key",
        F.col("field").alias("field_name"),
    )
    decided = F.col("status").isin("approved", "rejected")
    busy = additions.where(decided).select("run_id").unionByName(changes.where(decided).select("run_id"))
    idle = record(
        runs.select("run_id").join(busy, "run_id", "left_anti"),
        "commit_skipped",
        F.lit("nothing to commit").alias("reason"),
    )
    parts = [committed, refused, updated, skipped, refused_changes, idle]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def untouched_entries(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries outside the approved changes, before against after: all must be ``unchanged``."""
    changed = changes.where(F.col("status") == "approved").select(*FEATURE)
    old = before.join(changed, FEATURE, "left_anti").select(
        *FEATURE, F.col("version").alias("version_before"), F.col("updated_at").alias("_before")
    )
    new = after.select(*FEATURE, F.col("version").alias("version_after"), F.col("updated_at").alias("_after"))
    same = (F.col("version_before") == F.col("version_after")) & F.col("_before").eqNullSafe(F.col("_after"))
    return old.join(new, FEATURE, "left").select(
        *FEATURE, "version_before", "version_after", F.coalesce(same, F.lit(False)).alias("unchanged")
    )


def next_snapshot(
    entries: DataFrame,
    field_sources: DataFrame,
    additions: DataFrame,
    addition_claims: DataFrame,
    changes: DataFrame,
    mode: str = "append",
) -> tuple[DataFrame, DataFrame]:
    """Entries and field sources after applying all approved proposals.

    ``mode`` "append" keeps the old claims of a changed field, so the field is
    reported as changed again by a later run that touches it; "replace" keeps
    only the winner.
    """
    fresh = commit_additions(entries, additions)
    merged = commit_field_changes(entries.unionByName(fresh), changes)
    applied = applied_changes(entries, fresh, changes)
    base = replace_field_sources(field_sources, applied) if mode == "replace" else field_sources
    incoming = incoming_field_sources(fresh, addition_claims, applied, additions)
    return merged, upsert_field_sources(base, incoming)
