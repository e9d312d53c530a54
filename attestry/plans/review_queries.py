"""Queries over reviews, commits and the read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import schemas
from attestry.operators import commit, conflicts, embedding, reports, review
from attestry.plans import tables, views
from attestry.plans.check_sql import uuid5
from attestry.plans.claim_queries import FIELDS_SQL, flat_fields
from attestry.plans.registry import query
from attestry.sources import export

# ---------------------------------------------------------------- review


@query(
    "register_decisions",
    "SELECT item_id, state FROM addition_state UNION ALL SELECT item_id, state FROM change_state",
)
def register_decisions(spark, sf_dir):
    added = tables.decided_additions(spark, sf_dir).select("item_id", F.col("status").alias("state"))
    changed = tables.decided_changes(spark, sf_dir).select("item_id", F.col("status").alias("state"))
    return added.unionByName(changed)


def decided_conflicts(spark, sf_dir):
    return review.apply_conflict_decisions(
        tables.conflicts(spark, sf_dir), tables.conflict_reviews(spark, sf_dir)
    )


def decided_findings(spark, sf_dir):
    return review.apply_finding_decisions(
        tables.findings(spark, sf_dir), tables.finding_reviews(spark, sf_dir)
    )


@query(
    "pending_conflicts",
    """
SELECT c.conflict_id, c.run_id, c.subject, c.predicate, a.object AS object_a, b.object AS object_b,
  round(a.confidence * 10)::INTEGER AS tenths_a, round(b.confidence * 10)::INTEGER AS tenths_b
FROM conflicts c JOIN claims a ON a.claim_id = c.claim_a_id JOIN claims b ON b.claim_id = c.claim_b_id
WHERE c.conflict_id NOT IN (SELECT item_id FROM conflict_calls)""",
)
def pending_conflicts(spark, sf_dir):
    waiting = review.pending_conflicts(decided_conflicts(spark, sf_dir), views.claims(spark, sf_dir))
    return waiting.select(
        "conflict_id",
        "run_id",
        "subject",
        "predicate",
        "object_a",
        "object_b",
        F.round(F.col("confidence_a") * 10).cast("int").alias("tenths_a"),
        F.round(F.col("confidence_b") * 10).cast("int").alias("tenths_b"),
    )


CITED = ["claim_id", "chunk_id", "document_filename", "snippet", "highlight_start", "highlight_end"]


@query(
    "pending_conflict_citations",
    f"""
WITH waiting AS (SELECT * FROM conflicts WHERE conflict_id NOT IN (SELECT item_id FROM conflict_calls))
SELECT {', '.join(CITED)} FROM cited WHERE claim_id IN (SELECT claim_a_id FROM waiting UNION SELECT claim_b_id FROM waiting)""",
)
def pending_conflict_citations(spark, sf_dir):
    waiting = review.pending_conflicts(decided_conflicts(spark, sf_dir), views.claims(spark, sf_dir))
    return review.pending_conflict_citations(waiting, tables.cited(spark, sf_dir)).select(*CITED)


def chunk_citations(spark, sf_dir):
    """Every chunk as a citation with an empty quote."""
    bare = views.chunks(spark, sf_dir)
    names = views.documents(spark, sf_dir).select("doc_id", F.col("filename").alias("document_filename"))
    return (
        bare.select(
            "chunk_id",
            F.lit("").alias("quote"),
            "doc_id",
            "page",
            "char_start",
            "char_end",
            *reports.citation_snippet(F.col("text"), F.lit("")),
        )
    ).join(names, "doc_id")


@query(
    "pending_findings",
    """
WITH waiting AS (SELECT * FROM findings WHERE finding_id NOT IN (SELECT item_id FROM finding_calls))
SELECT w.finding_id, w.rule_id, w.severity, w.subject, w.message, c.claim_id, c.chunk_id, c.quote, c.snippet, c.highlight_start, c.highlight_end
FROM waiting w LEFT JOIN (
  SELECT s.finding_id, s.claim_id, c.chunk_id, c.quote, c.snippet, c.highlight_start, c.highlight_end FROM finding_cites s JOIN cited c ON c.claim_id = s.claim_id
  UNION ALL SELECT s.finding_id, NULL, k.chunk_id, '', substr(k.text, 1, 80), 0, 0 FROM finding_cites s JOIN chunks k ON k.chunk_id = s.chunk_id WHERE s.claim_id IS NULL) c USING (finding_id)""",
)
def pending_findings(spark, sf_dir):
    decided = decided_findings(spark, sf_dir)
    shown = review.pending_finding_citations(
        decided,
        tables.finding_sources(spark, sf_dir),
        tables.cited(spark, sf_dir),
        chunk_citations(spark, sf_dir),
    )
    return (
        review.pending_findings(decided)
        .select("finding_id", "rule_id", "severity", "subject", "message")
        .join(
            shown.select(
                "finding_id", "claim_id", "chunk_id", "quote", "snippet", "highlight_start", "highlight_end"
            ),
            "finding_id",
            "left",
        )
    )


@query(
    "pending_register_changes",
    """
WITH waiting AS (
  SELECT item_id, 'addition' AS change_kind, run_id, feature_key, NULL AS field_name, NULL AS new_value FROM addition_state WHERE state = 'pending'
  UNION ALL SELECT item_id, 'field_change', run_id, feature_key, field, new_value FROM change_state WHERE state = 'pending'),
backed AS (SELECT a.item_id, w.claim_id FROM addition_state a JOIN won_all w USING (corpus_id, feature_key) WHERE a.state = 'pending' GROUP BY ALL
  UNION ALL SELECT item_id, claim_id FROM change_state WHERE state = 'pending')
SELECT w.*, c.claim_id, c.chunk_id, c.snippet FROM waiting w JOIN backed b USING (item_id) JOIN cited c ON c.claim_id = b.claim_id""",
)
def pending_register_changes(spark, sf_dir):
    waiting = review.pending_register_changes(
        tables.decided_additions(spark, sf_dir), tables.decided_changes(spark, sf_dir)
    )
    backing = tables.addition_claims(spark, sf_dir)
    behind = backing.select("claim_id").unionByName(tables.changes(spark, sf_dir).select("claim_id"))
    shown = review.pending_change_citations(waiting, backing, tables.cited(spark, sf_dir, of=behind))
    return waiting.select(
        "item_id",
        "change_kind",
        "run_id",
        "feature_key",
        "field_name",
        F.array_join("new_value", "|").alias("new_value"),
    ).join(shown.select("item_id", "claim_id", "chunk_id", "snippet").distinct(), "item_id")


@query(
    "apply_conflict_decisions",
    """
SELECT c.conflict_id, CASE d.decision WHEN 'approve' THEN 'kept_both' WHEN 'reject' THEN 'rejected_both' ELSE 'unresolved' END AS resolution, 'human:' || d.reviewer AS resolved_by,
  CASE WHEN d.decision IS NOT NULL THEN 1719792000000000 END::BIGINT AS resolved_micros
FROM conflicts c LEFT JOIN conflict_calls d ON d.item_id = c.conflict_id""",
)
def apply_conflict_decisions(spark, sf_dir):
    return decided_conflicts(spark, sf_dir).select(
        "conflict_id", "resolution", "resolved_by", F.unix_micros("resolved_at").alias("resolved_micros")
    )


@query(
    "apply_finding_decisions",
    """
SELECT f.finding_id, CASE d.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS state, d.reviewer,
  CASE WHEN d.decision IS NOT NULL THEN 1719792000000000 END::BIGINT AS reviewed_micros
FROM findings f LEFT JOIN finding_calls d ON d.item_id = f.finding_id""",
)
def apply_finding_decisions(spark, sf_dir):
    return decided_findings(spark, sf_dir).select(
        "finding_id",
        F.col("status").alias("state"),
        "reviewer",
        F.unix_micros("reviewed_at").alias("reviewed_micros"),
    )


# Every decision, the superseded ones of the second reviewer included.
EVERY_DECISION = """
WITH every AS (
  SELECT item_id, run_id, 'conflict' AS item_type, decision, reviewer FROM conflict_calls
  UNION ALL SELECT item_id, run_id, 'finding', decision, reviewer FROM finding_calls
  UNION ALL SELECT item_id, run_id, {changes}, decision, reviewer FROM change_calls),
sent AS (SELECT * FROM every UNION ALL SELECT item_id, run_id, item_type, CASE decision WHEN 'approve' THEN 'reject' ELSE 'approve' END, reviewer FROM every WHERE reviewer = 'reviewer-1')
"""


@query(
    "invalid_decisions",
    EVERY_DECISION.format(changes="'finding'") + "SELECT item_id, run_id, item_type, decision FROM sent",
)
def invalid_decisions(spark, sf_dir):
    """All decisions sent a second time, and those on changes sent under another type."""
    reviews = tables.reviews(spark, sf_dir)
    sent = reviews.withColumn(
        "item_type",
        F.when(F.col("item_type") == "register_change", F.lit("finding")).otherwise(F.col("item_type")),
    )
    pending = review.pending_items(
        review.apply_conflict_decisions(tables.conflicts(spark, sf_dir), reviews),
        review.apply_finding_decisions(tables.findings(spark, sf_dir), reviews),
        [tables.additions(spark, sf_dir), tables.changes(spark, sf_dir)],
    )
    return review.invalid_decisions(sent, pending).select("item_id", "run_id", "item_type", "decision")


@query(
    "review_gate",
    """
WITH waiting AS (
  SELECT run_id, 'c' AS kind FROM conflicts WHERE conflict_id NOT IN (SELECT item_id FROM conflict_calls)
  UNION ALL SELECT run_id, 'f' FROM findings WHERE finding_id NOT IN (SELECT item_id FROM finding_calls)
  UNION ALL SELECT run_id, 'r' FROM addition_state WHERE state = 'pending' UNION ALL SELECT run_id, 'r' FROM change_state WHERE state = 'pending')
SELECT r.run_id, count(*) FILTER (WHERE w.kind = 'c') AS conflicts, count(*) FILTER (WHERE w.kind = 'f') AS findings, count(*) FILTER (WHERE w.kind = 'r') AS register_changes, count(w.kind) > 0 AS gated
FROM runs r LEFT JOIN waiting w USING (run_id) GROUP BY 1""",
)
def review_gate(spark, sf_dir):
    pending = review.pending_items(
        None,
        decided_findings(spark, sf_dir),
        [tables.decided_additions(spark, sf_dir), tables.decided_changes(spark, sf_dir)],
    )
    undecided = review.undecided_conflicts(
        conflicts.conflict_counts(views.claims(spark, sf_dir)), tables.conflict_reviews(spark, sf_dir)
    )
    return review.review_gate(views.runs(spark, sf_dir), pending, undecided)


@query(
    "gate_outcome",
    """
WITH waiting AS (
  SELECT run_id FROM conflicts WHERE conflict_id NOT IN (SELECT item_id FROM conflict_calls)
  UNION SELECT run_id FROM findings WHERE finding_id NOT IN (SELECT item_id FROM finding_calls)
  UNION SELECT run_id FROM addition_state WHERE state = 'pending' UNION SELECT run_id FROM change_state WHERE state = 'pending')
SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM waiting) THEN 'awaiting_review' ELSE 'running' END AS outcome FROM runs
UNION ALL SELECT run_id, 'human_gate_clean' FROM runs WHERE run_id NOT IN (SELECT run_id FROM waiting)""",
)
def gate_outcome(spark, sf_dir):
    moving = views.runs(spark, sf_dir).withColumn("status", F.lit("running"))
    runs, events = review.gate_outcome(moving, review_gate(spark, sf_dir))
    return runs.select("run_id", F.col("status").alias("outcome")).unionByName(
        events.select("run_id", F.col("event_type").alias("outcome"))
    )


@query(
    "value_checks",
    EVERY_DECISION.format(changes="'register_change'")
    + """
SELECT 'runs' AS table_name, 'kind' AS column_name, count(*) AS rows, 0::BIGINT AS invalid FROM runs
UNION ALL SELECT 'conflicts', 'resolution', count(*), 0 FROM conflicts
UNION ALL SELECT 'findings', unnest(['severity', 'status']), n, 0 FROM (SELECT count(*) AS n FROM findings)
UNION ALL SELECT 'reviews', unnest(['item_type', 'decision']), n, 0 FROM (SELECT count(*) AS n FROM sent)""",
)
def value_checks(spark, sf_dir):
    """Enumerated columns of the tables after review hold allowed values only."""
    return schemas.value_checks(
        {
            "runs": views.runs(spark, sf_dir),
            "conflicts": decided_conflicts(spark, sf_dir),
            "findings": decided_findings(spark, sf_dir),
            "reviews": tables.reviews(spark, sf_dir),
        }
    )


# ---------------------------------------------------------------- commit


@query(
    "commit_additions",
    f"""
SELECT {uuid5("'entry:' || corpus_id || ':' || feature_key")} AS entry_id, corpus_id, feature_key, {FIELDS_SQL}, 1::INTEGER AS version, run_id AS last_updated_run_id FROM addition_state WHERE state = 'approved'""",
)
def commit_additions(spark, sf_dir):
    fresh = commit.commit_additions(tables.entries(spark, sf_dir), tables.decided_additions(spark, sf_dir))
    return flat_fields(fresh.drop("updated_at"))


def _overlay(field: str) -> str:
    return f"coalesce(max(c.new_value) FILTER (WHERE c.field = '{field}'), any_value(e.{field})) AS {field}"


@query(
    "commit_field_changes",
    f"""
SELECT e.entry_id, e.corpus_id, e.feature_key, {", ".join(_overlay(f) for f in ["name", "owner", "target_release", "status"])},
  coalesce(max(c.new_value) FILTER (WHERE c.field = 'open_risks'), array_to_string(any_value(e.open_risks), '|')) AS open_risks,
  (1 + count(c.item_id))::INTEGER AS version, coalesce(max(c.run_id), any_value(e.last_updated_run_id)) AS last_updated_run_id,
  CASE WHEN count(c.item_id) > 0 THEN 1719878400000000 ELSE 1717200000000000 END::BIGINT AS updated_micros
FROM entries e LEFT JOIN (SELECT * FROM change_state WHERE state = 'approved') c ON c.corpus_id = e.corpus_id AND c.feature_key = e.feature_key GROUP BY 1, 2, 3""",
)
def commit_field_changes(spark, sf_dir):
    after = commit.commit_field_changes(tables.entries(spark, sf_dir), tables.decided_changes(spark, sf_dir))
    return flat_fields(
        after.withColumn("updated_micros", F.unix_micros("updated_at")).drop("updated_at")
    )


INCOMING_SQL = f"""
SELECT {uuid5("'entry:' || a.corpus_id || ':' || a.feature_key")} AS entry_id, w.field, w.claim_id FROM addition_state a JOIN won_all w USING (corpus_id, feature_key) WHERE a.state = 'approved'
UNION SELECT entry_id, field, claim_id FROM change_state WHERE state = 'approved'"""


@query(
    "upsert_field_sources",
    "SELECT entry_id, field, claim_id FROM field_sources UNION " + INCOMING_SQL,
)
def upsert_field_sources(spark, sf_dir):
    _, sources = commit.next_snapshot(
        tables.entries(spark, sf_dir),
        tables.field_sources(spark, sf_dir),
        tables.decided_additions(spark, sf_dir),
        tables.addition_claims(spark, sf_dir),
        tables.decided_changes(spark, sf_dir),
    )
    return sources


@query(
    "replace_field_sources",
    """
SELECT entry_id, field, claim_id FROM field_sources s WHERE field = 'open_risks' OR NOT EXISTS (
  SELECT 1 FROM change_state c WHERE c.state = 'approved' AND c.entry_id = s.entry_id AND c.field = s.field) UNION """
    + INCOMING_SQL,
)
def replace_field_sources(spark, sf_dir):
    _, sources = commit.next_snapshot(
        tables.entries(spark, sf_dir),
        tables.field_sources(spark, sf_dir),
        tables.decided_additions(spark, sf_dir),
        tables.addition_claims(spark, sf_dir),
        tables.decided_changes(spark, sf_dir),
        mode="replace",
    )
    return sources


@query(
    "commit_events",
    """
WITH kept AS (SELECT corpus_id, feature_key FROM entries WHERE target_release IS NOT NULL UNION SELECT corpus_id, feature_key FROM addition_state WHERE state = 'approved')
SELECT run_id, 'register_entry_committed' AS event_type, feature_key, NULL AS field FROM addition_state WHERE state = 'approved'
UNION ALL SELECT run_id, 'register_entry_rejected', feature_key, NULL FROM addition_state WHERE state = 'rejected'
UNION ALL SELECT run_id, 'register_field_updated', feature_key, field FROM change_state JOIN kept USING (corpus_id, feature_key) WHERE state = 'approved'
UNION ALL SELECT run_id, 'register_field_change_skipped', feature_key, NULL FROM change_state c WHERE state = 'approved' AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.corpus_id = c.corpus_id AND k.feature_key = c.feature_key)
UNION ALL SELECT run_id, 'register_field_change_rejected', feature_key, field FROM change_state WHERE state = 'rejected'
UNION ALL SELECT run_id, 'commit_skipped', NULL, NULL FROM runs WHERE run_id NOT IN (SELECT run_id FROM addition_state WHERE state <> 'pending' UNION SELECT run_id FROM change_state WHERE state <> 'pending')""",
)
def commit_events(spark, sf_dir):
    """A commit against a register that lost the entries without a release."""
    events = commit.commit_events(
        tables.entries(spark, sf_dir).where(F.col("fields.target_release").isNotNull()),
        tables.decided_additions(spark, sf_dir),
        tables.addition_claims(spark, sf_dir),
        tables.decided_changes(spark, sf_dir),
        views.runs(spark, sf_dir),
    )
    field = F.coalesce(
        F.get_json_object("payload", "$.field"), F.get_json_object("payload", "$.field_name")
    )
    return events.select(
        "run_id",
        "event_type",
        F.get_json_object("payload", "$.feature_key").alias("feature_key"),
        field.alias("field"),
    )


@query(
    "untouched_entries",
    """
SELECT corpus_id, feature_key, 1::INTEGER AS version_before, 1::INTEGER AS version_after, true AS unchanged FROM entries e
WHERE NOT EXISTS (SELECT 1 FROM change_state c WHERE c.state = 'approved' AND c.corpus_id = e.corpus_id AND c.feature_key = e.feature_key)""",
)
def untouched_entries(spark, sf_dir):
    before, changes = tables.entries(spark, sf_dir), tables.decided_changes(spark, sf_dir)
    return commit.untouched_entries(before, commit.commit_field_changes(before, changes), changes)


# ---------------------------------------------------------------- read models


@query(
    "register_view_rows",
    """
SELECT s.entry_id, s.field, c.claim_id, c.predicate, c.object, q.chunk_id, q.snippet, q.highlight_start
FROM entries e JOIN field_sources s USING (entry_id) JOIN claims c USING (claim_id) LEFT JOIN cited q USING (claim_id)""",
)
def register_view_rows(spark, sf_dir):
    rows = reports.register_view_rows(
        tables.entries(spark, sf_dir),
        tables.field_sources(spark, sf_dir),
        views.claims(spark, sf_dir),
        tables.cited(spark, sf_dir, of=tables.field_sources(spark, sf_dir)),
    )
    return rows.select("entry_id", "field", "claim_id", "predicate", "object", "chunk_id", "snippet", "highlight_start")


@query(
    "register_view",
    """
SELECT e.corpus_id, e.feature_key, e.version::INTEGER AS version, s.field, c.claim_id, c.predicate, c.object, q.chunk_id, q.snippet, q.highlight_start
FROM entries e JOIN field_sources s USING (entry_id) JOIN claims c USING (claim_id) JOIN cited q USING (claim_id)""",
)
def register_view(spark, sf_dir):
    view = reports.register_view(
        tables.entries(spark, sf_dir),
        tables.field_sources(spark, sf_dir),
        views.claims(spark, sf_dir),
        tables.cited(spark, sf_dir, of=tables.field_sources(spark, sf_dir)),
    )
    # unfolded again, so that the rows compare with plain SQL
    return (
        view.select("corpus_id", "feature_key", "version", F.explode("field_claims").alias("field", "claims"))
        .select("corpus_id", "feature_key", "version", "field", F.inline("claims"))
        .select(
            "corpus_id",
            "feature_key",
            "version",
            "field",
            "claim_id",
            "predicate",
            "object",
            F.explode("sources").alias("source"),
        )
        .select(
            "corpus_id",
            "feature_key",
            "version",
            "field",
            "claim_id",
            "predicate",
            "object",
            "source.chunk_id",
            "source.snippet",
            "source.highlight_start",
        )
    )


@query(
    "citation_snippet",
    """
SELECT claim_id, chunk_id, document_filename, quote, char_start, char_end, snippet, highlight_start, highlight_end FROM cited""",
)
def citation_snippet(spark, sf_dir):
    return tables.cited(spark, sf_dir).select(
        "claim_id",
        "chunk_id",
        "document_filename",
        "quote",
        "char_start",
        "char_end",
        "snippet",
        "highlight_start",
        "highlight_end",
    )


SOURCES_SQL = "SELECT DISTINCT entry_id, chunk_id, char_start, char_end FROM field_sources JOIN cited USING (claim_id)"


@query("entry_sources", SOURCES_SQL)
def entry_sources(spark, sf_dir):
    return reports.entry_sources(tables.field_sources(spark, sf_dir), tables.cited(spark, sf_dir))


@query(
    "register_sorted",
    f"""
SELECT corpus_id, feature_key, lower(coalesce(nullif(name, ''), feature_key)) AS sort_text, len(open_risks)::INTEGER AS n_risks, coalesce(n, 0) AS n_sources
FROM entries LEFT JOIN (SELECT entry_id, count(*) AS n FROM ({SOURCES_SQL}) GROUP BY 1) USING (entry_id) ORDER BY sort_text, corpus_id""",
)
def register_sorted(spark, sf_dir):
    sources = reports.entry_sources(tables.field_sources(spark, sf_dir), tables.cited(spark, sf_dir))
    ordered = reports.register_sorted(tables.entries(spark, sf_dir), sources, "feature")
    name = F.coalesce(F.nullif(F.col("fields.name"), F.lit("")), F.col("feature_key"))
    return ordered.select(
        "corpus_id",
        "feature_key",
        F.lower(name).alias("sort_text"),
        F.size("fields.open_risks").alias("n_risks"),
        "n_sources",
    )


@query(
    "register_export_csv",
    """
SELECT corpus_id, feature_key, feature_key || ',' || coalesce(name, '') || ',' || coalesce(owner, '') || ',' || coalesce(target_release, '') || ',' || coalesce(status, '') || ',' || array_to_string(open_risks, '; ') AS line FROM entries""",
)
def register_export_csv(spark, sf_dir):
    return export.register_export_csv(tables.entries(spark, sf_dir), ["corpus_id"])


@query(
    "csv_cells",
    """
SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents""",
)
def csv_cells(spark, sf_dir):
    """The export's quoting rule over whole texts."""
    return views.raw_documents(spark, sf_dir).select("doc_id", export.csv_cell(F.col("text")).alias("cell"))


@query(
    "current_stage",
    """
SELECT run_id, regexp_replace(arg_max(event_type, id), '_(start|end)$', '') AS stage FROM audit WHERE event_type LIKE '%\\_start' ESCAPE '\\' OR event_type LIKE '%\\_end' ESCAPE '\\' GROUP BY run_id""",
)
def current_stage(spark, sf_dir):
    return reports.current_stage(views.audit_events(spark, sf_dir))


@query(
    "run_counts",
    """
SELECT r.run_id, coalesce(c.n, 0) AS claims, coalesce(x.n, 0) AS conflicts, coalesce(f.n, 0) AS findings FROM runs r
LEFT JOIN (SELECT run_id, count(*) AS n FROM claims GROUP BY 1) c USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM conflicts GROUP BY 1) x USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM findings GROUP BY 1) f USING (run_id)""",
)
def run_counts(spark, sf_dir):
    """Conflicts are counted from group sizes: no pair is built for the report."""
    claims = views.claims(spark, sf_dir)
    return reports.run_counts(
        views.runs(spark, sf_dir), claims, conflicts.conflict_counts(claims), tables.findings(spark, sf_dir)
    )


def priced(spark, sf_dir):
    return embedding.llm_call_cost(views.cost_events(spark, sf_dir))


@query(
    "run_cost",
    """
SELECT run_id, stage, count(*)::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(latency_ms)::BIGINT AS latency_ms,
  sum(micro_usd)::BIGINT AS micro_usd, sum(micro_usd)::BIGINT / 1000000.0::DOUBLE AS usd_cost FROM priced GROUP BY GROUPING SETS ((run_id, stage), (run_id))""",
)
def run_cost(spark, sf_dir):
    return reports.run_cost(priced(spark, sf_dir)).withColumn("usd_cost", F.col("usd_cost").cast("double"))


@query(
    "run_audit",
    "SELECT run_id, id, event_type, payload, epoch_us(occurred_at)::BIGINT AS occurred_micros FROM audit ORDER BY run_id, occurred_at, id",
)
def run_audit(spark, sf_dir):
    return reports.run_audit(views.audit_events(spark, sf_dir)).select(
        "run_id", "id", "event_type", "payload", F.unix_micros("occurred_at").alias("occurred_micros")
    )


@query(
    "stage_timeline",
    """
WITH stages AS (SELECT unnest(['classify','classify_review','extract','detect_conflicts','examine','build_register','human_gate','commit','finish']) AS stage,
  unnest(range(0, 9))::INTEGER AS position),
seen AS (SELECT run_id, id, payload, regexp_extract(event_type, '^(.*)_(start|end)$', 1) AS stage, regexp_extract(event_type, '^(.*)_(start|end)$', 2) AS phase FROM audit)
SELECT r.run_id, s.position, s.stage, CASE arg_max(phase, id) WHEN 'start' THEN 'running' WHEN 'end' THEN 'done' ELSE 'pending' END AS status,
  arg_max(payload, id) FILTER (WHERE phase = 'start') AS start_payload, arg_max(payload, id) FILTER (WHERE phase = 'end') AS end_payload
FROM evruns r CROSS JOIN stages s LEFT JOIN seen e ON e.run_id = r.run_id AND e.stage = s.stage GROUP BY 1, 2, 3""",
)
def stage_timeline(spark, sf_dir):
    return reports.stage_timeline(views.event_runs(spark, sf_dir), views.audit_events(spark, sf_dir))


@query(
    "budget_breaches",
    """
WITH spent AS (SELECT *, coalesce(sum(micro_usd) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
  (greatest(input_tokens, 1) * 3 + 8192 * 15)::BIGINT AS estimate FROM priced)
SELECT id, run_id, stage, spent, estimate FROM spent WHERE spent + estimate > 250000""",
)
def budget_breaches(spark, sf_dir):
    calls = priced(spark, sf_dir).withColumn(
        "estimate", reports.worst_case_micro_usd(F.col("input_tokens") * 4)
    )
    return reports.budget_breaches(calls, 250_000).select("id", "run_id", "stage", "spent", "estimate")


@query(
    "runs_list",
    """
SELECT r.run_id, coalesce(c.name, substr(r.corpus_id, 1, 8)) AS corpus, epoch_us(r.started_at)::BIGINT AS started_micros, coalesce(p.n, 0)::BIGINT AS micro_usd
FROM evruns r LEFT JOIN corpora c USING (corpus_id) LEFT JOIN (SELECT run_id, sum(micro_usd)::BIGINT AS n FROM priced GROUP BY 1) p USING (run_id)""",
)
def runs_list(spark, sf_dir):
    listed = reports.runs_list(
        views.event_runs(spark, sf_dir), views.corpora(spark, sf_dir), priced(spark, sf_dir)
    )
    return listed.select(
        "run_id", "corpus", F.unix_micros("started_at").alias("started_micros"), "micro_usd"
    )


@query(
    "corpora_list",
    "SELECT corpus_id, name, epoch_us(created_at)::BIGINT AS created_micros FROM corpora ORDER BY created_at DESC, corpus_id",
)
def corpora_list(spark, sf_dir):
    return reports.corpora_list(views.corpora(spark, sf_dir)).select(
        "corpus_id", "name", F.unix_micros("created_at").alias("created_micros")
    )


@query(
    "idempotent_requests",
    """
WITH asked AS (SELECT event_id AS request_id, 'src' || (user_id % 20) AS corpus_id, CASE WHEN event_id % 5 <> 0 THEN 'key-' || (user_id // 3) END AS idempotency_key FROM events),
firsts AS (SELECT idempotency_key, min(request_id) AS first_id, arg_min(corpus_id, request_id) AS first_corpus FROM asked WHERE idempotency_key IS NOT NULL GROUP BY 1)
SELECT a.request_id, a.corpus_id, a.idempotency_key, CASE WHEN f.first_id IS NULL THEN a.request_id WHEN f.first_corpus = a.corpus_id THEN f.first_id END AS run_request,
  CASE WHEN f.first_id IS NULL THEN 'created' WHEN f.first_corpus <> a.corpus_id THEN 'conflict' WHEN f.first_id = a.request_id THEN 'created' ELSE 'returned' END AS outcome
FROM asked a LEFT JOIN firsts f USING (idempotency_key)""",
)
def idempotent_requests(spark, sf_dir):
    asked = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("corpus_id"),
        F.when(
            F.col("event_id") % 5 != 0,
            F.concat(F.lit("key-"), F.floor(F.col("user_id") / 3).cast("string")),
        ).alias("idempotency_key"),
    )
    resolved, refused = reports.idempotent_requests(asked)
    outcome = F.when(F.col("created"), F.lit("created")).otherwise(F.lit("returned"))
    return resolved.withColumn("outcome", outcome).drop("created").unionByName(
        refused.select("request_id", "corpus_id", "idempotency_key", F.lit("conflict").alias("outcome")),
        allowMissingColumns=True,
    )


@query(
    "inbox_owner",
    """
WITH owners AS (SELECT inbox_path, arg_min(corpus_id, (created_at, corpus_id)) AS corpus_id FROM corpora GROUP BY 1)
SELECT d.doc_id, o.inbox_path, o.corpus_id FROM documents d JOIN owners o ON o.inbox_path = '/inbox/' || (d.doc_id % 20 % 7)""",
)
def inbox_owner(spark, sf_dir):
    dropped = views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/inbox/"), (F.col("doc_id") % 20 % 7).cast("string")).alias("inbox_path"),
    )
    return reports.inbox_owner(dropped, views.corpora(spark, sf_dir))
