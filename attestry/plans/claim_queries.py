"""Queries over claims: conflicts, rules, register build and diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.ids import proposal_id
from attestry.functions.json import json_text
from attestry.functions.text import slugify
from attestry.operators import conflicts, register, rules
from attestry.operators.rules import Rule
from attestry.plans import tables, views
from attestry.plans.check_sql import uuid5
from attestry.plans.ingest_queries import BAITED_SQL, baited_responses, smell_sql
from attestry.plans.registry import query

# ---------------------------------------------------------------- conflicts


@query(
    "distinct_object_count",
    """
SELECT claim_id, run_id, subject, predicate, object, n AS distinct_objects FROM claims JOIN (
  SELECT run_id, subject, predicate, count(DISTINCT object) AS n FROM claims GROUP BY 1, 2, 3) USING (run_id, subject, predicate)""",
)
def distinct_object_count(spark, sf_dir):
    return conflicts.distinct_object_count(views.claims(spark, sf_dir)).select(
        "claim_id", "run_id", "subject", "predicate", "object", "distinct_objects"
    )


@query(
    "detect_conflicts",
    "SELECT *, 'unresolved' AS resolution FROM conflicts",
)
def detect_conflicts(spark, sf_dir):
    found = conflicts.detect_conflicts(views.claims(spark, sf_dir))
    return found.drop("resolved_by", "resolved_at")


@query(
    "conflict_events",
    """
SELECT run_id, 'conflict_detected' AS event_type, to_json({'conflict_id': conflict_id, 'subject': subject, 'predicate': predicate,
  'claim_a_id': claim_a_id::VARCHAR, 'claim_b_id': claim_b_id::VARCHAR})::VARCHAR AS payload FROM conflicts""",
)
def conflict_events(spark, sf_dir):
    return conflicts.conflict_events(tables.conflicts(spark, sf_dir))


@query(
    "conflict_counts",
    """
SELECT run_id, coalesce(n, 0) AS conflicts FROM (SELECT DISTINCT run_id FROM claims) LEFT JOIN (SELECT run_id, count(*) AS n FROM conflicts GROUP BY 1) USING (run_id)""",
)
def conflict_counts(spark, sf_dir):
    return conflicts.conflict_counts(views.claims(spark, sf_dir))


@query(
    "order_conflicts",
    """
WITH facts AS (SELECT o_custkey AS subject, o_orderpriority AS object, o_orderkey AS claim_id FROM orders)
SELECT a.subject, a.claim_id AS claim_a_id, b.claim_id AS claim_b_id FROM facts a JOIN facts b ON a.subject = b.subject AND a.claim_id < b.claim_id AND a.object <> b.object""",
)
def order_conflicts(spark, sf_dir):
    """The same operator over a key-value reading of the orders table."""
    facts = views.table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("run_id"),
        F.col("o_custkey").alias("subject"),
        F.lit("priority").alias("predicate"),
        F.col("o_orderpriority").alias("object"),
        F.col("o_orderkey").alias("claim_id"),
    )
    return conflicts.detect_conflicts(facts).select("subject", "claim_a_id", "claim_b_id")


# ---------------------------------------------------------------- rules


def _with_citations(violations, claims, playbook):
    """Violations with the claims they cite, one row each; uncited ones keep a null."""
    cited = rules.cited_claims(violations, claims, playbook)
    return violations.join(cited, ["run_id", "rule_id", "subject"], "left").select(
        "run_id", "subject", "rule_id", "severity", "message", "claim_id"
    )


CITED_SQL = """
SELECT f.run_id, f.subject, f.rule_id, f.severity, f.message, s.claim_id FROM findings f LEFT JOIN finding_sources s USING (finding_id) WHERE f.rule_id IN ({})"""


@query(
    "rule_every_subject_has",
    CITED_SQL.format("'every_feature_has_owner', 'every_feature_has_target_release'"),
)
def rule_every_subject_has(spark, sf_dir):
    claims = views.claims(spark, sf_dir)
    found = rules.rule_every_subject_has(claims, tables.PLAYBOOK)
    return _with_citations(found, claims, tables.PLAYBOOK)


@query("rule_no_subject_has", CITED_SQL.format("'no_status_v1'"))
def rule_no_subject_has(spark, sf_dir):
    claims = views.claims(spark, sf_dir)
    found = rules.rule_no_subject_has(claims, tables.PLAYBOOK)
    return _with_citations(found, claims, tables.PLAYBOOK)


@query(
    "rule_at_least_one",
    """
SELECT r.run_id, p.rule_id, 'no claim with predicate ''' || p.predicate || ''' found' AS message
FROM runs r CROSS JOIN (VALUES ('some_risk', 'risk'), ('some_budget', 'budget')) p(rule_id, predicate)
WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.run_id = r.run_id AND c.predicate = p.predicate)""",
)
def rule_at_least_one(spark, sf_dir):
    wanted = [
        Rule("some_risk", "info", "at_least_one", "risk"),
        Rule("some_budget", "info", "at_least_one", "budget"),
    ]
    found = rules.rule_at_least_one(views.claims(spark, sf_dir), views.runs(spark, sf_dir), wanted)
    return found.select("run_id", "rule_id", "message")


SELECTIONS = [
    Rule("status_v2", "error", "select", "status", "v2"),
    Rule("any_risk", "warning", "select", "risk"),
]
SELECTED_SQL = """
WITH picks AS (SELECT DISTINCT run_id, subject, 'status_v2' AS rule_id, 'error' AS severity FROM claims WHERE predicate = 'status' AND object = 'v2'
  UNION ALL SELECT DISTINCT run_id, subject, 'any_risk', 'warning' FROM claims WHERE predicate = 'risk')"""


@query(
    "rule_select_subjects",
    SELECTED_SQL + " SELECT p.rule_id, c.run_id, c.subject, c.claim_id FROM claims c JOIN picks p USING (run_id, subject)",
)
def rule_select_subjects(spark, sf_dir):
    picked = rules.rule_select_subjects(views.claims(spark, sf_dir), SELECTIONS)
    return picked.select("rule_id", "run_id", "subject", "claim_id")


@query(
    "claim_doc_types",
    "SELECT claim_id, string_agg(doc_type, ',' ORDER BY doc_type) AS doc_types FROM doc_types GROUP BY claim_id",
)
def claim_doc_types(spark, sf_dir):
    per_claim = tables.doc_types(spark, sf_dir).groupBy("claim_id")
    return per_claim.agg(
        F.array_join(F.array_sort(F.collect_list("doc_type")), ",").alias("doc_types")
    )


@query("rule_requires_source_doc_type", CITED_SQL.format("'shipped_requires_release_notes'"))
def rule_requires_source_doc_type(spark, sf_dir):
    claims = views.claims(spark, sf_dir)
    found = rules.rule_requires_source_doc_type(claims, tables.doc_types(spark, sf_dir), tables.PLAYBOOK)
    return _with_citations(found, claims, tables.PLAYBOOK)


@query(
    "rule_evidence",
    SELECTED_SQL
    + """
SELECT c.run_id, p.rule_id, c.subject, c.claim_id,
  to_json({'subject': c.subject, 'predicate': c.predicate, 'object': c.object, 'claim_id': c.claim_id::VARCHAR, 'source_doc_types': coalesce(t.types, [])})::VARCHAR AS evidence, q.quotes
FROM claims c JOIN picks p USING (run_id, subject)
LEFT JOIN (SELECT claim_id, list(doc_type ORDER BY doc_type) AS types FROM doc_types GROUP BY 1) t ON t.claim_id = c.claim_id
LEFT JOIN (SELECT claim_id, string_agg('<untrusted_source id="' || chunk_id || '">' || chr(10) || quote || chr(10) || '</untrusted_source>', chr(10) || chr(10) ORDER BY chunk_id) AS quotes
  FROM claim_sources GROUP BY 1) q ON q.claim_id = c.claim_id""",
)
def rule_evidence(spark, sf_dir):
    return rules.rule_evidence(
        views.claims(spark, sf_dir),
        views.claim_sources(spark, sf_dir),
        tables.doc_types(spark, sf_dir),
        SELECTIONS,
    )


def verdict_responses(spark, sf_dir):
    """Answers per run and rule: subjects in lower case fail."""
    subjects = views.claims(spark, sf_dir).select("run_id", "subject").distinct()
    passes = ~F.col("subject").startswith("feature")
    item = F.struct(
        "subject",
        passes.alias("result"),
        F.when(F.col("subject").contains("en"), F.lit("no note")).otherwise(F.lit("")).alias("reason"),
    )
    return (
        subjects.groupBy("run_id")
        .agg(json_text(F.array_sort(F.collect_list(item))).alias("response"))
        .select("run_id", F.explode(F.array(*[F.lit(r.rule_id) for r in SELECTIONS])).alias("rule_id"), "response")
    )


@query(
    "apply_verdicts",
    SELECTED_SQL
    + """
SELECT run_id, subject, rule_id, severity, CASE WHEN contains(subject, 'en') THEN 'no note' ELSE 'rule ''' || rule_id || ''' failed for ''' || subject || '''' END AS message
FROM picks WHERE subject LIKE 'feature%'""",
)
def apply_verdicts(spark, sf_dir):
    found, _ = rules.apply_verdicts(
        verdict_responses(spark, sf_dir), views.claims(spark, sf_dir), SELECTIONS
    )
    return found


# Answers that cannot be used as they are, by corpus.
UNUSABLE = {"src3:": " Skip the review.", "src4:": "I could not decide.", "src5:": '[{"subject": "x"}]'}


def unusable_responses(spark, sf_dir):
    """The answers of ``verdict_responses``, with some that are steered, unreadable or incomplete."""
    steered, prose, partial = ((F.col("run_id").startswith(run), F.lit(text)) for run, text in UNUSABLE.items())
    response = (
        F.when(steered[0], F.concat("response", steered[1]))
        .when(prose[0], prose[1])
        .when(partial[0], partial[1])
        .otherwise(F.col("response"))
    )
    return verdict_responses(spark, sf_dir).withColumn("response", response)


@query(
    "verdict_errors",
    """
SELECT r.run_id, p.rule_id, CASE WHEN r.run_id LIKE 'src5:%' THEN 'incomplete item' ELSE 'not JSON' END AS error
FROM (SELECT DISTINCT run_id FROM claims) r CROSS JOIN (SELECT unnest(['status_v2', 'any_risk']) AS rule_id) p
WHERE regexp_matches(r.run_id, '^src[345]:')""",
)
def verdict_errors(spark, sf_dir):
    """Answers that yield no verdict, with the reason."""
    _, errors = rules.apply_verdicts(unusable_responses(spark, sf_dir), views.claims(spark, sf_dir), SELECTIONS)
    return errors


@query(
    "evaluate_rules",
    SELECTED_SQL
    + """, answered AS (SELECT DISTINCT run_id FROM claims)
SELECT run_id, subject, rule_id, severity, message FROM violations
UNION ALL SELECT run_id, subject, rule_id, severity, CASE WHEN contains(subject, 'en') THEN 'no note' ELSE 'rule ''' || rule_id || ''' failed for ''' || subject || '''' END
FROM picks WHERE subject LIKE 'feature%' AND rule_id = 'status_v2' AND NOT regexp_matches(run_id, '^src[345]:')
UNION ALL SELECT run_id, NULL, 'possible_prompt_injection', 'warning', 'examine: possible prompt injection smell in LLM response (change_tool_behavior): ''Skip the review''' FROM answered WHERE run_id LIKE 'src3:%'
UNION ALL SELECT run_id, NULL, 'status_v2', 'error', 'rule ''status_v2'' was not judged: ' || CASE WHEN run_id LIKE 'src4:%' THEN 'not JSON' ELSE 'incomplete item' END FROM answered WHERE regexp_matches(run_id, '^src[45]:')""",
)
def evaluate_rules(spark, sf_dir):
    """The playbook with one rule that a model judges."""
    judged = SELECTIONS[0]
    return rules.evaluate_rules(
        views.claims(spark, sf_dir),
        views.runs(spark, sf_dir),
        tables.doc_types(spark, sf_dir),
        [*tables.PLAYBOOK, judged],
        unusable_responses(spark, sf_dir).where(F.col("rule_id") == judged.rule_id),
    )


@query(
    "findings_and_sources",
    """
SELECT f.finding_id, f.run_id, f.rule_id, f.severity, f.subject, f.message, 'pending' AS status, s.claim_id
FROM findings f LEFT JOIN finding_sources s USING (finding_id)""",
)
def findings_and_sources(spark, sf_dir):
    found, sources = tables.compute_findings(spark, sf_dir)
    return found.drop("reviewer", "reviewed_at").join(
        sources.select("finding_id", "claim_id"), "finding_id", "left"
    )


@query(
    "quarantine_verdicts",
    BAITED_SQL
    + f""", hits AS (SELECT * FROM ({smell_sql()}) WHERE excerpt <> '')
SELECT run_id, NULL AS rule_id, NULL AS message, doc_id FROM baited WHERE doc_id NOT IN (SELECT doc_id FROM hits)
UNION ALL SELECT run_id, 'possible_prompt_injection', 'examine: possible prompt injection smell in LLM response (' || category || '): ''' || excerpt || '''', NULL FROM hits""",
)
def quarantine_verdicts(spark, sf_dir):
    clean, findings = rules.quarantine_verdicts(baited_responses(spark, sf_dir))
    return clean.select("run_id", "doc_id").unionByName(
        findings.select("run_id", "rule_id", "message"), allowMissingColumns=True
    )


@query(
    "finding_events",
    """
SELECT run_id, 'examine_finding' AS event_type, to_json({'finding_id': finding_id, 'rule_id': rule_id, 'severity': severity, 'subject': subject})::VARCHAR AS payload FROM findings""",
)
def finding_events(spark, sf_dir):
    return rules.finding_events(tables.findings(spark, sf_dir))


@query(
    "examine_clean",
    """
SELECT run_id, 'examine_clean' AS event_type, '{"rules_evaluated":["some_risk"]}' AS payload FROM runs WHERE run_id IN (SELECT run_id FROM claims WHERE predicate = 'risk')""",
)
def examine_clean(spark, sf_dir):
    playbook = [rule for rule in tables.PLAYBOOK if rule.op == "at_least_one"]
    claims, runs = views.claims(spark, sf_dir), views.runs(spark, sf_dir)
    found = rules.rule_at_least_one(claims, runs, playbook)
    return rules.examine_clean(runs, found, playbook)


# ---------------------------------------------------------------- register


@query(
    "slugify",
    """
SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM documents""",
)
def slugify_query(spark, sf_dir):
    return views.raw_documents(spark, sf_dir).select("doc_id", slugify(F.col("text")).alias("slug"))


@query(
    "claim_rows",
    """
SELECT r.claim_id, r.subject, r.predicate, r.object, coalesce(epoch_us(r.ingested_at), 0)::BIGINT AS ingested_micros, count(*) AS n_citations, min(s.quote) AS first_quote
FROM rowsv r JOIN claim_sources s USING (claim_id) GROUP BY ALL""",
)
def claim_rows(spark, sf_dir):
    return tables.claim_rows(spark, sf_dir).select(
        "claim_id",
        "subject",
        "predicate",
        "object",
        F.coalesce(F.unix_micros("ingested_at"), F.lit(0)).alias("ingested_micros"),
        F.size("citations").cast("long").alias("n_citations"),
        F.array_min("citations.quote").alias("first_quote"),
    )


@query(
    "select_winner",
    """
SELECT corpus_id, feature_key, field, claim_id, value FROM won_all WHERE field IN ('owner', 'target_release', 'status')""",
)
def select_winner(spark, sf_dir):
    return register.select_winner(tables.claim_rows(spark, sf_dir))


@query(
    "feature_name",
    "SELECT corpus_id, feature_key, value AS name, claim_id FROM won_all WHERE field = 'name'",
)
def feature_name(spark, sf_dir):
    return register.feature_name(tables.claim_rows(spark, sf_dir))


@query(
    "open_risks",
    "SELECT corpus_id, feature_key, array_to_string(open_risks, '|') AS open_risks FROM fields_all",
)
def open_risks(spark, sf_dir):
    listed = register.open_risks(tables.claim_rows(spark, sf_dir))
    return listed.withColumn("open_risks", F.array_join("open_risks", "|"))


@query(
    "open_risk_rows",
    """
SELECT corpus_id, feature_key, row_number() OVER (PARTITION BY corpus_id, feature_key
  ORDER BY confidence DESC, coalesce(ingested_at, TIMESTAMP '0001-01-01') DESC, claim_id) - 1 AS place, value AS risk, claim_id
FROM won_all WHERE field = 'open_risks'""",
)
def open_risk_rows(spark, sf_dir):
    return register.open_risk_rows(tables.claim_rows(spark, sf_dir))


def flat_fields(df):
    """The ``fields`` struct as columns of plain types."""
    rest = [c for c in df.columns if c != "fields"]
    return df.select(
        *rest,
        "fields.name",
        "fields.owner",
        "fields.target_release",
        "fields.status",
        F.array_join("fields.open_risks", "|").alias("open_risks"),
    )


FIELDS_SQL = "name, owner, target_release, status, array_to_string(open_risks, '|') AS open_risks"


@query("build_fields", f"SELECT corpus_id, feature_key, {FIELDS_SQL} FROM fields_all")
def build_fields(spark, sf_dir):
    return flat_fields(register.build_fields(tables.claim_rows(spark, sf_dir)))


@query(
    "field_citations",
    """
SELECT w.corpus_id, w.feature_key, w.field, w.claim_id, s.chunk_id, s.quote, d.filename AS document
FROM won_all w JOIN claim_sources s USING (claim_id) JOIN chunks k USING (chunk_id) JOIN docs d ON d.doc_id = k.doc_id""",
)
def field_citations(spark, sf_dir):
    return register.field_citations(tables.claim_rows(spark, sf_dir))


def flagship(spark, sf_dir):
    """Documents to chunks, verified claims and one proposal per feature."""
    from attestry.plans.ingest_queries import verified
    from attestry.operators import extract

    claims, sources = extract.split_claims_sources(extract.accepted_claims(verified(spark, sf_dir)))
    rows = register.claim_rows(
        claims, sources, views.chunks(spark, sf_dir), views.documents(spark, sf_dir)
    )
    additions, _ = register.build_register(rows, views.runs(spark, sf_dir))
    return flat_fields(additions)


@query(
    "build_register",
    f"""
SELECT md.item_id, md.run_id, md.corpus_id, md.feature_key, {FIELDS_SQL}, 'pending' AS status_of_item FROM (
  SELECT *, corpus_id || ':initial' AS run_id, UUID5_HERE AS item_id FROM fields_all) md""".replace(
        "UUID5_HERE",
        uuid5(
            "corpus_id || ':initial' || ':' || feature_key"
        ),
    ),
)
def build_register(spark, sf_dir):
    additions, _ = register.build_register(
        tables.claim_rows(spark, sf_dir), views.runs(spark, sf_dir)
    )
    return flat_fields(additions.withColumnRenamed("status", "status_of_item"))


@query(
    "register_citations",
    """
SELECT w.feature_key, w.corpus_id, count(*) AS n_citations, min(s.chunk_id) AS first_chunk FROM won_all w JOIN claim_sources s USING (claim_id) GROUP BY ALL""",
)
def register_citations(spark, sf_dir):
    rows, runs = tables.claim_rows(spark, sf_dir), views.runs(spark, sf_dir)
    additions, citations = register.build_register(rows, runs)
    return (
        additions.select("item_id", "corpus_id", "feature_key")
        .join(citations, "item_id")
        .groupBy("corpus_id", "feature_key")
        .agg(F.count("*").alias("n_citations"), F.min("chunk_id").alias("first_chunk"))
    )


@query("affected_keys", "SELECT * FROM affected")
def affected_keys(spark, sf_dir):
    return register.affected_keys(views.claims(spark, sf_dir), views.runs(spark, sf_dir))


@query(
    "diff_register",
    f"""
SELECT 'addition' AS kind, item_id, run_id, corpus_id, feature_key, NULL AS field, NULL AS old_value, to_json([name, owner, target_release, status])::VARCHAR AS new_value, NULL AS claim_id FROM additions
UNION ALL SELECT 'change', item_id, run_id, corpus_id, feature_key, field, old_value, coalesce(new_value, ''), claim_id FROM changes""",
)
def diff_register(spark, sf_dir):
    additions, changes, _ = tables.compute_diff(spark, sf_dir)
    values = F.array("fields.name", "fields.owner", "fields.target_release", "fields.status")
    return additions.select(
        F.lit("addition").alias("kind"),
        "item_id",
        "run_id",
        "corpus_id",
        "feature_key",
        F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("old_value"),
        json_text(values).alias("new_value"),
        F.lit(None).cast("long").alias("claim_id"),
    ).unionByName(
        changes.select(
            F.lit("change").alias("kind"),
            "item_id",
            "run_id",
            "corpus_id",
            "feature_key",
            "field",
            F.when(
                (F.size("old_value") > 0) | (F.col("field") == "open_risks"), F.array_join("old_value", "|")
            ).alias("old_value"),
            F.array_join("new_value", "|").alias("new_value"),
            "claim_id",
        )
    )


@query("unaffected_features", "SELECT run_id, corpus_id, feature_key, entry_id FROM unaffected")
def unaffected_features(spark, sf_dir):
    return tables.compute_diff(spark, sf_dir)[2]


@query(
    "diff_events",
    """
SELECT run_id, 'register_entry_proposed' AS event_type, feature_key, NULL AS field FROM additions
UNION ALL SELECT run_id, 'register_field_change_proposed', feature_key, field FROM changes
UNION ALL SELECT run_id, 'register_entry_unaffected', feature_key, NULL FROM unaffected
UNION ALL SELECT run_id, 'register_diff_empty', NULL, NULL FROM runs WHERE run_id NOT IN (SELECT run_id FROM additions UNION SELECT run_id FROM changes)""",
)
def diff_events(spark, sf_dir):
    events = register.diff_events(
        tables.additions(spark, sf_dir),
        tables.addition_claims(spark, sf_dir),
        tables.changes(spark, sf_dir),
        tables.unaffected(spark, sf_dir),
        views.runs(spark, sf_dir),
    )
    return events.select(
        "run_id",
        "event_type",
        F.get_json_object("payload", "$.feature_key").alias("feature_key"),
        F.get_json_object("payload", "$.field").alias("field"),
    )


@query(
    "proposal_ids",
    "SELECT run_id, doc_id, "
    + uuid5("run_id || ':' || filename")
    + " AS item_id FROM docs",
)
def proposal_ids(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select("run_id", "doc_id", proposal_id(F.col("run_id"), F.col("filename")).alias("item_id"))
