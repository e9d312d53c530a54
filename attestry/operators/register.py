"""The feature register: winners, fields, citations, proposals and diffs.

Everything that picks one claim of a group does so with ``min_by`` over the
complete order key: it combines before the shuffle, so a feature with a third
of all claims sends one candidate per task. No window runs over claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.json import json_text
from attestry.functions.ids import PROPOSAL_NAMESPACE, proposal_id, uuid5
from attestry.functions.ordering import position
from attestry.functions.text import slugify

RISK = "risk"
SINGLE_FIELDS = ["owner", "target_release", "status"]
FEATURE = ["corpus_id", "feature_key"]

# Ranges of confidence that the risks of a feature are placed in.
RISK_RANGES = 256

# Microseconds of the earliest timestamp; stands in for an unknown ingestion time.
EARLIEST = -62135596800000000


def feature_key() -> Column:
    return slugify(F.col("subject"))


def claim_rows(
    claims: DataFrame, claim_sources: DataFrame, chunks: DataFrame, documents: DataFrame
) -> DataFrame:
    """Claims with their citations and the newest ingestion time of their documents.

    A claim without any resolvable source is not in the result. The citations
    of one claim come from one response item, so they fit in a row.
    """
    cited = (
        claim_sources.select("claim_id", "chunk_id", "quote")
        .join(chunks.select("chunk_id", "doc_id"), "chunk_id")
        .join(documents.select("doc_id", F.col("filename").alias("document"), "ingested_at"), "doc_id")
    )
    per_claim = cited.groupBy("claim_id").agg(
        F.max("ingested_at").alias("ingested_at"),
        F.array_sort(F.collect_list(F.struct("chunk_id", "quote", "document"))).alias("citations"),
    )
    return claims.join(per_claim, "claim_id")


def trust_order() -> Column:
    """Ascending key: higher confidence, then newer, then lower claim id comes first."""
    newest = F.coalesce(F.unix_micros("ingested_at"), F.lit(EARLIEST))
    return F.struct((-F.col("confidence")).alias("c"), (-newest).alias("t"), F.col("claim_id").alias("i"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("feature_key", feature_key())


def select_winner(rows: DataFrame) -> DataFrame:
    """The most trusted claim per feature and single-valued field."""
    return winners(rows).where(F.col("field").isin(SINGLE_FIELDS)).select(
        *FEATURE, "field", "claim_id", "value"
    )


def feature_name(rows: DataFrame) -> DataFrame:
    """The subject text of the most trusted claim of the whole feature."""
    best = F.min_by(F.struct("claim_id", "subject"), trust_order()).alias("_best")
    return (
        _keyed(rows)
        .groupBy(*FEATURE)
        .agg(best)
        .select(*FEATURE, F.col("_best.subject").alias("name"), F.col("_best.claim_id").alias("claim_id"))
    )


def winners(rows: DataFrame) -> DataFrame:
    """All field winners in one pass: ``field, value, claim_id, trust`` per feature.

    A claim runs for ``name`` and, by its predicate, for one more field; each
    distinct risk is a field value of its own.
    """
    own = F.when(
        F.col("predicate").isin(SINGLE_FIELDS),
        F.struct(F.col("predicate").alias("field"), F.lit("").alias("slot"), F.col("object").alias("value")),
    ).when(
        F.col("predicate") == RISK,
        F.struct(F.lit("open_risks").alias("field"), F.col("object").alias("slot"), F.col("object").alias("value")),
    )
    name = F.struct(F.lit("name").alias("field"), F.lit("").alias("slot"), F.col("subject").alias("value"))
    candidates = _keyed(rows).select(
        *FEATURE,
        trust_order().alias("trust"),
        "claim_id",
        F.inline(F.array_compact(F.array(name, own))),
    )
    return (
        candidates.groupBy(*FEATURE, "field", "slot")
        .agg(F.min_by(F.struct("value", "claim_id", "trust"), "trust").alias("_best"))
        .select(*FEATURE, "field", "_best.value", "_best.claim_id", "_best.trust")
    )


def _risk_list(value: Column, trust: Column, when: Column) -> Column:
    """Distinct risks of a feature in order of trust; the array is the field's value."""
    ordered = F.array_sort(F.collect_list(F.when(when, F.struct(trust.alias("trust"), value.alias("value")))))
    return F.transform(ordered, lambda r: r["value"])


def open_risk_rows(rows: DataFrame) -> DataFrame:
    """``corpus_id, feature_key, place, risk, claim_id``: a row per distinct risk of a feature, place 0 most trusted.

    Places are counted by ranges of confidence, so a feature with very many risks (such as ``unknown``) is neither
    one row nor one task.
    """
    risks = winners(rows).where(F.col("field") == "open_risks").select(
        *FEATURE, F.col("value").alias("risk"), "claim_id", "trust"
    )
    # The order begins with the negated confidence, which lies between -1 and 0; ranges are in that order.
    block = F.floor(F.coalesce(F.col("trust.c"), F.lit(-2.0)) * RISK_RANGES)
    return position(risks, FEATURE, ["trust"], block, "place").select(*FEATURE, "place", "risk", "claim_id")


def open_risks(rows: DataFrame) -> DataFrame:
    """Distinct risks per feature, most trusted first; empty for a feature without any.

    The array is the field's stored value; ``open_risk_rows`` has a row per risk.
    """
    return build_fields(rows).select(*FEATURE, "fields.open_risks")


def fields_of(won: DataFrame) -> DataFrame:
    """Fold winners into one ``fields`` struct per feature."""

    def single(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("value"))).alias(field)

    return (
        won.groupBy(*FEATURE)
        .agg(
            single("name"),
            *[single(field) for field in SINGLE_FIELDS],
            _risk_list(F.col("value"), F.col("trust"), F.col("field") == "open_risks").alias("open_risks"),
        )
        .select(*FEATURE, F.struct("name", *SINGLE_FIELDS, "open_risks").alias("fields"))
    )


def build_fields(rows: DataFrame) -> DataFrame:
    """One ``fields`` struct per feature; a field without claims is null."""
    return fields_of(winners(rows))


def field_citations(rows: DataFrame) -> DataFrame:
    """Sources of every winning claim: ``field, claim_id, chunk_id, quote, document``."""
    won = winners(rows).select(*FEATURE, "field", "claim_id")
    return won.join(rows.select("claim_id", "citations"), "claim_id").select(
        *FEATURE, "field", "claim_id", F.inline("citations")
    )


def build_register(rows: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(additions, citations)``: one pending proposal per feature of each initial run's corpus."""
    initial = runs.where(F.col("kind") == "initial").select("run_id", "corpus_id")
    additions = build_fields(rows).join(initial, "corpus_id").select(
        proposal_id(F.col("run_id"), F.col("feature_key")).alias("item_id"),
        "run_id",
        *FEATURE,
        "fields",
        F.lit("pending").alias("status"),
    )
    citations = field_citations(rows).join(initial, "corpus_id").select(
        proposal_id(F.col("run_id"), F.col("feature_key")).alias("item_id"),
        "field",
        "claim_id",
        "chunk_id",
        "quote",
        "document",
    )
    return additions, citations


def register_entries(additions: DataFrame) -> DataFrame:
    """Stored form of committed additions, version 1."""
    return additions.select(
        entry_id().alias("entry_id"),
        *FEATURE,
        "fields",
        F.lit(1).alias("version"),
        F.col("run_id").alias("last_updated_run_id"),
    )


def entry_id() -> Column:
    """Stable id of a register entry."""
    return uuid5(PROPOSAL_NAMESPACE, F.concat_ws(":", F.lit("entry"), "corpus_id", "feature_key"))


def affected_keys(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Features that an update run's own claims touch: ``run_id, corpus_id, feature_key``."""
    update = runs.where(F.col("kind") == "update").select("run_id")
    # The key is taken once per subject, not once per claim.
    subjects = claims.select("run_id", "corpus_id", "subject").distinct().join(update, "run_id", "left_semi")
    return subjects.select("run_id", "corpus_id", feature_key().alias("feature_key")).distinct()


def touched_claims(
    claims: DataFrame, claim_sources: DataFrame, affected: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Claims of the touched features and their sources.

    Taken before ``claim_rows``, so that an update joins chunks and documents for these claims only.
    """
    keys = affected.select(*FEATURE).distinct()
    touched = claims.withColumn("feature_key", feature_key()).join(keys, FEATURE, "left_semi").select(claims.columns)
    return touched, claim_sources.join(touched.select("claim_id"), "claim_id", "left_semi")


def affected_rows(rows: DataFrame, affected: DataFrame) -> DataFrame:
    """All corpus claims of the touched features, whichever run made them."""
    return _keyed(rows).join(affected.select(*FEATURE).distinct(), FEATURE, "left_semi").drop("feature_key")


def judge_fields(
    rows: DataFrame, affected: DataFrame, entries: DataFrame, field_sources: DataFrame
) -> DataFrame:
    """New and stored state of every field of the touched features, one row per field.

    ``values`` are the field's new values in order, ``newcomer`` the lowest
    winning claim, as text, that is not stored for the field, ``backing`` the
    number of claims stored for it. Grouping is by feature and field and
    combines before the shuffle; only winners take part.
    """
    won = winners(affected_rows(rows, affected))
    stored = (
        entries.select("entry_id", *FEATURE)
        .join(field_sources.select("entry_id", "field", "claim_id").distinct(), "entry_id")
        .select(*FEATURE, "field", "claim_id", F.lit(True).alias("_stored"))
    )
    backing = stored.groupBy(*FEATURE, "field").agg(F.count("*").alias("backing"))
    fresh = F.col("_stored").isNull()
    ordered = F.array_sort(F.collect_list(F.struct("trust", "value")))
    return (
        won.join(stored, [*FEATURE, "field", "claim_id"], "left")
        .groupBy(*FEATURE, "field")
        .agg(
            F.transform(ordered, lambda v: v["value"]).alias("values"),
            F.min("claim_id").alias("winner"),
            F.min_by("claim_id", F.when(fresh, F.col("claim_id").cast("string"))).alias("newcomer"),
        )
        .join(backing, [*FEATURE, "field"], "left")
    )


def _fold(judged: DataFrame) -> DataFrame:
    """Fields of a feature, one row per field, to one ``fields`` struct."""

    def values(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("values")))

    return judged.groupBy("run_id", *FEATURE).agg(
        F.struct(
            *[F.get(values(f), F.lit(0)).alias(f) for f in ["name", *SINGLE_FIELDS]],
            F.coalesce(values("open_risks"), F.array().cast("array<string>")).alias("open_risks"),
        ).alias("fields")
    )


def _stored_value(field: Column) -> Column:
    """A stored field as an array of texts, whatever its kind."""
    value = F.when(field == "open_risks", F.col("fields.open_risks"))
    for name in ["name", *SINGLE_FIELDS]:
        value = F.when(field == name, F.array_compact(F.array(f"fields.{name}"))).otherwise(value)
    return value


def judge_features(
    rows: DataFrame, affected: DataFrame, entries: DataFrame, field_sources: DataFrame
) -> DataFrame:
    """Every field of every touched feature of every update run, with ``changed``.

    ``rows`` are all claim rows; only touched features are computed. A
    single-valued field changes when its winner is not exactly the set of
    claims stored for it. A multi-valued field changes when a winning claim is
    not stored yet; the lowest such id, as text, stands for the change. A field
    without a winner never changes.
    """
    fields = judge_fields(rows, affected, entries, field_sources)
    known = entries.select("entry_id", *FEATURE, "fields")
    # a touched feature without any claim row keeps one row with empty fields
    judged = affected.join(fields, FEATURE, "left").join(known, FEATURE, "left")
    changed = F.when(F.col("field") == "open_risks", F.col("newcomer").isNotNull()).otherwise(
        F.col("newcomer").isNotNull() | (F.col("backing") != 1)
    )
    return judged.withColumn(
        "changed", F.coalesce(F.col("field").isNotNull() & changed, F.lit(False))
    )


def split_diff(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(additions, changes, unaffected)`` of judged features.

    The three read ``judged`` once each; a caller that uses all of them writes it
    to a table first.
    """
    multi = F.col("field") == "open_risks"
    additions = _fold(judged.where(F.col("entry_id").isNull())).select(
        proposal_id(F.col("run_id"), F.col("feature_key")).alias("item_id"),
        "run_id",
        *FEATURE,
        "fields",
        F.lit("pending").alias("status"),
    )
    field = F.col("field")
    changes = judged.where(F.col("entry_id").isNotNull() & F.col("changed")).select(
        proposal_id(F.col("run_id"), F.col("feature_key"), field).alias("item_id"),
        "run_id",
        *FEATURE,
        "entry_id",
        "field",
        _stored_value(field).alias("old_value"),
        F.col("values").alias("new_value"),
        F.when(multi, F.col("newcomer")).otherwise(F.col("winner")).alias("claim_id"),
        F.lit("pending").alias("status"),
    )
    unaffected = (
        judged.where(F.col("entry_id").isNotNull())
        .groupBy("run_id", *FEATURE, "entry_id")
        .agg(F.bool_or("changed").alias("_changed"))
        .where(~F.col("_changed"))
        .drop("_changed")
    )
    return additions, changes, unaffected


def diff_register(
    rows: DataFrame, affected: DataFrame, entries: DataFrame, field_sources: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(additions, changes, unaffected)`` of update runs against the stored register."""
    return split_diff(judge_features(rows, affected, entries, field_sources))


def diff_events(
    additions: DataFrame,
    addition_claims: DataFrame,
    changes: DataFrame,
    unaffected: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """Audit records of a diff; a run that proposes nothing gets ``register_diff_empty``.

    ``addition_claims``: ``item_id, claim_id`` of the claims behind additions.
    """
    backing = addition_claims.groupBy("item_id").agg(
        F.array_sort(F.collect_set(F.col("claim_id").cast("string"))).alias("claim_ids")
    )
    proposed = additions.join(backing, "item_id", "left").select(
        "run_id",
        F.lit("register_entry_proposed").alias("event_type"),
        json_text(F.struct("feature_key", "fields", "claim_ids")).alias("payload"),
    )
    changed = changes.select(
        "run_id",
        F.lit("register_field_change_proposed").alias("event_type"),
        json_text(
            F.struct(
                F.col("entry_id").alias("register_entry_id"),
                "feature_key",
                "field",
                F.col("old_value").alias("old"),
                F.col("new_value").alias("new"),
                F.col("claim_id").cast("string").alias("claim_id"),
            )
        ).alias("payload"),
    )
    same = unaffected.select(
        "run_id",
        F.lit("register_entry_unaffected").alias("event_type"),
        json_text(F.struct("feature_key", F.col("entry_id").alias("register_entry_id"))).alias("payload"),
    )
    active = additions.select("run_id").unionByName(changes.select("run_id"))
    reason = F.when(
        F.col("kind") == "initial", F.lit("no persisted claims found for this corpus")
    ).otherwise(F.lit("no affected register fields found for this update run"))
    empty = runs.join(active, "run_id", "left_anti").select(
        "run_id",
        F.lit("register_diff_empty").alias("event_type"),
        json_text(F.struct(reason.alias("reason"))).alias("payload"),
    )
    return proposed.unionByName(changed).unionByName(same).unionByName(empty)
