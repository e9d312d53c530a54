"""Human decisions: what waits for one, and what a decision does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFLICT, FINDING, REGISTER_CHANGE = "conflict", "finding", "register_change"


def latest_decisions(reviews: DataFrame, item_type: str) -> DataFrame:
    """The newest decision per item: ``item_id, decision, reviewer, decided_at``.

    Of one time, the higher ``review_id`` counts where ``reviews`` has it, then the text order.
    """
    order = [c for c in ("decided_at", "review_id", "decision", "reviewer") if c in reviews.columns]
    newest = F.max_by(F.struct("decision", "reviewer", "decided_at"), F.struct(*order)).alias("_d")
    return (
        reviews.where(F.col("item_type") == item_type)
        .groupBy("item_id")
        .agg(newest)
        .select("item_id", "_d.*")
    )


def register_decisions(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Additions or changes with the status their review gives them, else their own."""
    decided = latest_decisions(reviews, REGISTER_CHANGE).select("item_id", "decision")
    status = (
        F.when(F.col("decision") == "approve", F.lit("approved"))
        .when(F.col("decision") == "reject", F.lit("rejected"))
        .otherwise(F.col("status"))
    )
    return proposals.join(decided, "item_id", "left").withColumn("status", status).drop("decision")


def pending_conflicts(conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """Unresolved conflicts with both claims.

    Citations stay a table of their own (``claim_id`` to citation rows): a
    claim may be in very many conflicts, and repeating its citations in each
    would multiply them.
    """
    result = conflicts.where(F.col("resolution") == "unresolved")
    for side in ("a", "b"):
        detail = claims.select(
            F.col("claim_id").alias(f"claim_{side}_id"),
            F.col("object").alias(f"object_{side}"),
            F.col("confidence").alias(f"confidence_{side}"),
        )
        result = result.join(detail, f"claim_{side}_id")
    return result.withColumn("item_type", F.lit(CONFLICT))


def pending_conflict_citations(pending: DataFrame, cited: DataFrame) -> DataFrame:
    """Citations of every claim that waits in some conflict, once per claim."""
    waiting = (
        pending.select(F.col("claim_a_id").alias("claim_id"))
        .unionByName(pending.select(F.col("claim_b_id").alias("claim_id")))
        .distinct()
    )
    return cited.join(waiting, "claim_id", "left_semi")


def pending_findings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status") == "pending").withColumn("item_type", F.lit(FINDING))


def pending_finding_citations(
    findings: DataFrame, finding_sources: DataFrame, cited: DataFrame, chunk_citations: DataFrame
) -> DataFrame:
    """Citation rows of pending findings.

    A source that names a claim brings the claim's citations; one that names
    only a chunk brings the chunk with an empty quote (``chunk_citations``:
    citation columns per chunk).
    """
    open_sources = finding_sources.join(
        pending_findings(findings).select("finding_id"), "finding_id", "left_semi"
    )
    by_claim = (
        open_sources.where(F.col("claim_id").isNotNull())
        .select("finding_id", "claim_id")
        .join(cited, "claim_id")
    )
    by_chunk = (
        open_sources.where(F.col("claim_id").isNull() & F.col("chunk_id").isNotNull())
        .select("finding_id", "claim_id", "chunk_id")
        .join(chunk_citations, "chunk_id")
    )
    return by_claim.unionByName(by_chunk, allowMissingColumns=True)


def pending_register_changes(additions: DataFrame, changes: DataFrame) -> DataFrame:
    """Pending additions and field changes in one table."""
    added = additions.where(F.col("status") == "pending").select(
        "item_id",
        F.lit(REGISTER_CHANGE).alias("item_type"),
        F.lit("addition").alias("change_kind"),
        "run_id",
        "corpus_id",
        "feature_key",
        "fields",
    )
    changed = changes.where(F.col("status") == "pending").select(
        "item_id",
        F.lit(REGISTER_CHANGE).alias("item_type"),
        F.lit("field_change").alias("change_kind"),
        "run_id",
        "corpus_id",
        "feature_key",
        F.col("field").alias("field_name"),
        "old_value",
        "new_value",
        "claim_id",
    )
    return added.unionByName(changed, allowMissingColumns=True)


def pending_change_citations(
    pending: DataFrame, addition_claims: DataFrame, cited: DataFrame
) -> DataFrame:
    """Citation rows of pending changes; ``addition_claims``: ``item_id, field, claim_id``."""
    from_additions = addition_claims.select("item_id", "field", "claim_id").distinct().join(
        pending.where(F.col("change_kind") == "addition").select("item_id"), "item_id", "left_semi"
    )
    from_changes = pending.where(F.col("change_kind") == "field_change").select(
        "item_id", F.col("field_name").alias("field"), "claim_id"
    )
    return from_additions.unionByName(from_changes).join(cited, "claim_id")


def apply_conflict_decisions(conflicts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approve keeps both claims, reject keeps neither; undecided conflicts stay as they are."""
    decided = latest_decisions(reviews, CONFLICT).withColumnRenamed("item_id", "conflict_id")
    hit = F.col("decision").isNotNull()
    outcome = F.when(F.col("decision") == "approve", F.lit("kept_both")).otherwise(F.lit("rejected_both"))
    return (
        conflicts.join(decided, "conflict_id", "left")
        .withColumn("resolution", F.when(hit, outcome).otherwise(F.col("resolution")))
        .withColumn(
            "resolved_by",
            F.when(hit, F.concat(F.lit("human:"), F.col("reviewer"))).otherwise(F.col("resolved_by")),
        )
        .withColumn("resolved_at", F.when(hit, F.col("decided_at")).otherwise(F.col("resolved_at")))
        .select(*conflicts.columns)
    )


def apply_finding_decisions(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the status, reviewer and time of their decision."""
    decided = latest_decisions(reviews, FINDING).select(
        F.col("item_id").alias("finding_id"),
        "decision",
        F.col("reviewer").alias("_reviewer"),
        "decided_at",
    )
    hit = F.col("decision").isNotNull()
    outcome = F.when(F.col("decision") == "approve", F.lit("approved")).otherwise(F.lit("rejected"))
    return (
        findings.join(decided, "finding_id", "left")
        .withColumn("status", F.when(hit, outcome).otherwise(F.col("status")))
        .withColumn("reviewer", F.coalesce("_reviewer", "reviewer"))
        .withColumn("reviewed_at", F.coalesce("decided_at", "reviewed_at"))
        .select(*findings.columns)
    )


def pending_items(
    conflicts: DataFrame | None, findings: DataFrame, proposals: list[DataFrame]
) -> DataFrame:
    """``run_id, item_id, item_type`` of everything that waits for a person.

    Without ``conflicts`` none are listed: a caller that counts them otherwise need not build the pairs.
    """
    items = findings.where(F.col("status") == "pending").select(
        "run_id", F.col("finding_id").alias("item_id"), F.lit(FINDING).alias("item_type")
    )
    if conflicts is not None:
        items = items.unionByName(
            conflicts.where(F.col("resolution") == "unresolved").select(
                "run_id", F.col("conflict_id").alias("item_id"), F.lit(CONFLICT).alias("item_type")
            )
        )
    for proposal in proposals:
        items = items.unionByName(
            proposal.where(F.col("status") == "pending").select(
                "run_id", "item_id", F.lit(REGISTER_CHANGE).alias("item_type")
            )
        )
    return items


def invalid_decisions(decisions: DataFrame, pending: DataFrame) -> DataFrame:
    """Decisions on an item of their run that is not pending under that type."""
    return decisions.join(pending, ["run_id", "item_id", "item_type"], "left_anti")


def undecided_conflicts(counts: DataFrame, reviews: DataFrame) -> DataFrame:
    """``run_id, undecided``: conflicts of a run (``run_id, conflicts``) less those with a decision.

    The number comes from group sizes and decisions, so no pair is built to learn that a run has to wait.
    """
    decided = reviews.where(F.col("item_type") == CONFLICT).groupBy("run_id").agg(
        F.countDistinct("item_id").alias("_decided")
    )
    left = F.col("conflicts") - F.coalesce("_decided", F.lit(0))
    return counts.join(decided, "run_id", "left").select("run_id", left.alias("undecided"))


def review_gate(runs: DataFrame, pending: DataFrame, undecided: DataFrame | None = None) -> DataFrame:
    """Waiting items per run and kind; the gate is open, and the run waits, while any is left.

    ``pending`` names the items. With ``undecided``, the conflicts' numbers come from there, and
    ``pending`` need not hold any.
    """
    kinds = [(CONFLICT, "conflicts"), (FINDING, "findings"), (REGISTER_CHANGE, "register_changes")]
    counted = pending.groupBy("run_id").agg(
        *[F.count_if(F.col("item_type") == kind).alias(name) for kind, name in kinds]
    )
    result = runs.select("run_id").distinct().join(counted, "run_id", "left")
    if undecided is not None:
        result = result.join(undecided, "run_id", "left").withColumn("conflicts", F.col("undecided")).drop("undecided")
    for _, name in kinds:
        result = result.withColumn(name, F.coalesce(name, F.lit(0)))
    waiting = F.col("conflicts") + F.col("findings") + F.col("register_changes")
    return result.withColumn("gated", waiting > 0)


def gate_outcome(runs: DataFrame, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(runs, events)`` after the gate: a gated run awaits review, a clean one leaves a record."""
    gated = gate.select("run_id", "gated")
    status = F.when(F.col("gated"), F.lit("awaiting_review")).otherwise(F.col("status"))
    moved = runs.join(gated, "run_id", "left").withColumn("status", status).select(*runs.columns)
    events = gated.where(~F.col("gated")).select(
        "run_id", F.lit("human_gate_clean").alias("event_type"), F.lit("{}").alias("payload")
    )
    return moved, events
