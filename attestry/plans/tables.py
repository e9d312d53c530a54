"""Stored tables of a running register, derived by the operators from the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import conflicts as conflict_ops
from attestry.operators import register, reports, review, rules
from attestry.operators.rules import Rule
from attestry.plans import views

# The playbook of the registered queries.
PLAYBOOK = [
    Rule("every_feature_has_owner", "warning", "every_subject_has", "owner"),
    Rule("every_feature_has_target_release", "warning", "every_subject_has", "target_release"),
    Rule("no_status_v1", "error", "no_subject_has", "status", "v1"),
    Rule("some_risk", "info", "at_least_one", "risk"),
    Rule("shipped_requires_release_notes", "error", "select", "status", "v2", doc_type="release_notes"),
]


def initial_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("run_id").endswith(":initial"))


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.claim_rows(
        views.claims(spark, sf_dir),
        views.claim_sources(spark, sf_dir),
        views.chunks(spark, sf_dir),
        views.documents(spark, sf_dir),
    )


@views.stored
def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim rows as a table, for the derived tables below."""
    return claim_rows(spark, sf_dir)


def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.claim_doc_types(
        views.claim_sources(spark, sf_dir), views.chunks(spark, sf_dir), views.documents(spark, sf_dir)
    )


@views.stored
def initial_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.winners(initial_only(stored_rows(spark, sf_dir)))


@views.stored
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register after the initial runs were committed."""
    return register.fields_of(initial_winners(spark, sf_dir)).select(
        register.entry_id().alias("entry_id"),
        *register.FEATURE,
        "fields",
        F.lit(1).alias("version"),
        F.concat("corpus_id", F.lit(":initial")).alias("last_updated_run_id"),
        F.timestamp_micros(F.lit(1717200000000000)).alias("updated_at"),
    )


def field_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return initial_winners(spark, sf_dir).select(
        register.entry_id().alias("entry_id"), "field", "claim_id"
    )


@views.stored
def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that update runs touch."""
    return register.affected_keys(views.claims(spark, sf_dir), views.runs(spark, sf_dir))


@views.stored
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every touched field, written once: additions, changes and unaffected features read it.

    The claim rows are there already, as the entries come from them.
    """
    return register.judge_features(
        stored_rows(spark, sf_dir), affected(spark, sf_dir), entries(spark, sf_dir), field_sources(spark, sf_dir)
    )


def compute_diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(additions, changes, unaffected)`` of the update runs."""
    return register.split_diff(judged(spark, sf_dir))


@views.stored
def additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.split_diff(judged(spark, sf_dir))[0]


@views.stored
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.split_diff(judged(spark, sf_dir))[1]


@views.stored
def unaffected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.split_diff(judged(spark, sf_dir))[2]


@views.stored
def addition_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims behind the proposed additions: ``item_id, field, claim_id``."""
    added = additions(spark, sf_dir).select("item_id", *register.FEATURE)
    rows = register.affected_rows(stored_rows(spark, sf_dir), added)
    won = register.winners(rows).select(*register.FEATURE, "field", "claim_id")
    return added.join(won, register.FEATURE).drop(*register.FEATURE)


@views.stored
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict_ops.detect_conflicts(views.claims(spark, sf_dir))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate_rules(
        views.claims(spark, sf_dir), views.runs(spark, sf_dir), doc_types(spark, sf_dir), PLAYBOOK
    )


def compute_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rules.findings_and_sources(violations(spark, sf_dir), views.claims(spark, sf_dir), PLAYBOOK)


@views.stored
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_findings(spark, sf_dir)[0]


@views.stored
def finding_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited claims; a finding about a whole run cites the run's first chunk instead."""
    first = views.chunks(spark, sf_dir).groupBy("run_id").agg(F.min("chunk_id").alias("chunk_id"))
    whole = (
        findings(spark, sf_dir)
        .where(F.col("subject").isNull())
        .join(first, "run_id")
        .select("finding_id", "chunk_id", F.lit(None).cast("long").alias("claim_id"))
    )
    cited = rules.finding_source_rows(findings(spark, sf_dir), views.claims(spark, sf_dir), PLAYBOOK)
    return cited.unionByName(whole)


def label_decisions(
    spark: SparkSession, sf_dir: str, items: DataFrame, item_type: str
) -> DataFrame:
    """Review rows for ``items`` (``run_id, item_id, doc_id``) taken from the document labels.

    Good quality approves, bad quality rejects. Toxic documents carry an older,
    opposite decision as well, which the newer one replaces.
    """
    return decisions_from_labels(views.table(spark, sf_dir, "labels"), items, item_type)


def decisions_from_labels(labels: DataFrame, items: DataFrame, item_type: str) -> DataFrame:
    labelled = items.join(labels, "doc_id")
    decision = F.when(F.col("quality") == 1, F.lit("approve")).otherwise(F.lit("reject"))
    opposite = F.when(F.col("quality") == 1, F.lit("reject")).otherwise(F.lit("approve"))

    def rows(source: DataFrame, column, micros: int) -> DataFrame:
        return source.select(
            "run_id",
            F.lit(item_type).alias("item_type"),
            "item_id",
            column.alias("decision"),
            F.concat(F.lit("reviewer-"), F.col("toxic").cast("string")).alias("reviewer"),
            F.timestamp_micros(F.lit(micros)).alias("decided_at"),
        )

    newer = rows(labelled, decision, 1719792000000000)
    older = rows(labelled.where(F.col("toxic") == 1), opposite, 1719705600000000)
    return newer.unionByName(older)


def document_of(claim_id: str):
    return F.floor(F.col(claim_id) / views.CHUNKS_PER_DOCUMENT).alias("doc_id")


def conflict_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = conflicts(spark, sf_dir).select(
        "run_id", F.col("conflict_id").alias("item_id"), document_of("claim_a_id")
    )
    return label_decisions(spark, sf_dir, items, "conflict")


def finding_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowest = finding_sources(spark, sf_dir).groupBy("finding_id").agg(F.min("claim_id").alias("claim_id"))
    items = (
        findings(spark, sf_dir)
        .join(lowest, "finding_id")
        .select("run_id", F.col("finding_id").alias("item_id"), document_of("claim_id"))
    )
    return label_decisions(spark, sf_dir, items, "finding")


def change_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on proposals: by the claim behind the name of an addition, or behind a change."""
    names = addition_claims(spark, sf_dir).where(F.col("field") == "name").select("item_id", "claim_id")
    items = (
        additions(spark, sf_dir)
        .join(names, "item_id")
        .select("run_id", "item_id", document_of("claim_id"))
        .unionByName(changes(spark, sf_dir).select("run_id", "item_id", document_of("claim_id")))
    )
    return label_decisions(spark, sf_dir, items, "register_change")


@views.stored
def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        conflict_reviews(spark, sf_dir)
        .unionByName(finding_reviews(spark, sf_dir))
        .unionByName(change_reviews(spark, sf_dir))
    )


def decided_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = review.register_decisions(additions(spark, sf_dir), change_reviews(spark, sf_dir))
    return decided.withColumn("committed_at", F.timestamp_micros(F.lit(1719878400000000)))


def decided_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = review.register_decisions(changes(spark, sf_dir), change_reviews(spark, sf_dir))
    return decided.withColumn("committed_at", F.timestamp_micros(F.lit(1719878400000000)))


def cited(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Citations of all claims, or of the claims ``of`` (``claim_id``): others are left out before they meet a text."""
    sources = views.claim_sources(spark, sf_dir)
    if of is not None:
        sources = sources.join(of.select("claim_id"), "claim_id", "left_semi")
    return reports.citations(sources, views.chunks(spark, sf_dir), views.documents(spark, sf_dir))
