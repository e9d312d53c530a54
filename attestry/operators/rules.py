"""The rule playbook over the claims of a run, grouped by raw subject.

Violations and the claims they cite are two tables, never an array per
subject, so a subject with very many claims stays spread over tasks. The
playbook is configuration: its rules become columns of one aggregation, and no
rule is joined against the claims.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.injection import smells
from attestry.functions.json import json_text
from attestry.functions.ids import PROPOSAL_NAMESPACE, uuid5
from attestry.functions.text import quoted, wrap_source
from attestry.operators.classify import json_list_problem

GROUP = ["run_id", "subject"]

OPERATIONS = ("every_subject_has", "no_subject_has", "at_least_one", "select")


@dataclass(frozen=True)
class Rule:
    """One rule. ``op`` is one of ``OPERATIONS``.

    ``select`` rules pick subjects by ``predicate`` and, when given, ``value``;
    they are judged from verdicts, or by ``doc_type``: some claim of the subject
    must come from a document of that type.
    """

    rule_id: str
    severity: str
    op: str
    predicate: str
    value: str | None = None
    doc_type: str | None = None

    def __post_init__(self) -> None:
        if self.op not in OPERATIONS:
            raise ValueError(f"rule {self.rule_id}: unknown operation {self.op}")
        if self.severity not in ("info", "warning", "error"):
            raise ValueError(f"rule {self.rule_id}: unknown severity {self.severity}")
        if self.op == "no_subject_has" and self.value is None:
            raise ValueError(f"rule {self.rule_id}: no_subject_has needs a value")


def _of(rules: Sequence[Rule], op: str) -> list[Rule]:
    return [rule for rule in rules if rule.op == op]


def _matches(rule: Rule) -> Column:
    """The claim is one the rule speaks about."""
    hit = F.col("predicate") == rule.predicate
    return hit if rule.value is None else hit & (F.col("object") == rule.value)


def _head(rule: Rule, message: Column, when: Column) -> Column:
    """A violation of ``rule``, or null."""
    return F.when(
        when,
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.severity).alias("severity"),
            message.alias("message"),
        ),
    )


def _listed(heads: Sequence[Column]) -> Column:
    return F.inline(F.filter(F.array(*heads), lambda head: head.isNotNull()))


def _empty(claims: DataFrame, columns: str) -> DataFrame:
    return claims.sparkSession.createDataFrame([], columns)


def _run_type(claims: DataFrame) -> str:
    return claims.schema["run_id"].dataType.simpleString()


def rule_every_subject_has(claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A violation per subject without any claim of the rule's predicate."""
    wanted = _of(rules, "every_subject_has")
    if not wanted:
        return _empty(claims, f"run_id {_run_type(claims)}, subject string, rule_id string, severity string, message string")
    flags = [F.bool_or(F.col("predicate") == rule.predicate).alias(f"_has_{i}") for i, rule in enumerate(wanted)]
    heads = [
        _head(
            rule,
            F.concat(quoted(F.col("subject")), F.lit(f" has no claim for predicate '{rule.predicate}'")),
            ~F.col(f"_has_{i}"),
        )
        for i, rule in enumerate(wanted)
    ]
    return claims.groupBy(*GROUP).agg(*flags).select(*GROUP, _listed(heads))


def rule_no_subject_has(claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A violation per subject with a claim of the forbidden predicate and value."""
    wanted = _of(rules, "no_subject_has")
    if not wanted:
        return _empty(claims, f"run_id {_run_type(claims)}, subject string, rule_id string, severity string, message string")
    flags = [F.bool_or(_matches(rule)).alias(f"_has_{i}") for i, rule in enumerate(wanted)]
    heads = [
        _head(
            rule,
            F.concat(
                quoted(F.col("subject")),
                F.lit(f" has {rule.predicate}='{rule.value}', which rule '{rule.rule_id}' forbids"),
            ),
            F.col(f"_has_{i}"),
        )
        for i, rule in enumerate(wanted)
    ]
    touched = reduce(lambda a, b: a | b, [_matches(rule) for rule in wanted])
    return claims.where(touched).groupBy(*GROUP).agg(*flags).select(*GROUP, _listed(heads))


def rule_at_least_one(claims: DataFrame, runs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One violation without subject per run that has no claim of the predicate at all.

    Runs without claims violate too.
    """
    wanted = _of(rules, "at_least_one")
    if not wanted:
        return _empty(claims, f"run_id {_run_type(claims)}, subject string, rule_id string, severity string, message string")
    flags = [F.bool_or(F.col("predicate") == rule.predicate).alias(f"_has_{i}") for i, rule in enumerate(wanted)]
    heads = [
        _head(
            rule,
            F.lit(f"no claim with predicate '{rule.predicate}' found"),
            ~F.coalesce(F.col(f"_has_{i}"), F.lit(False)),
        )
        for i, rule in enumerate(wanted)
    ]
    seen = claims.groupBy("run_id").agg(*flags)
    return (
        runs.select("run_id")
        .distinct()
        .join(seen, "run_id", "left")
        .select("run_id", F.lit(None).cast("string").alias("subject"), _listed(heads))
    )


def selected_subjects(claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(run_id, subject, rule_id)`` of the subjects each ``select`` rule picks."""
    wanted = _of(rules, "select")
    picked = F.array_compact(
        F.array(*[F.when(F.bool_or(_matches(rule)), F.lit(rule.rule_id)) for rule in wanted])
    )
    touched = reduce(lambda a, b: a | b, [_matches(rule) for rule in wanted])
    return (
        claims.where(touched)
        .groupBy(*GROUP)
        .agg(picked.alias("_rules"))
        .select(*GROUP, F.explode("_rules").alias("rule_id"))
    )


def rule_select_subjects(claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All claims of the subjects each ``select`` rule picks, with ``rule_id``."""
    return claims.join(selected_subjects(claims, rules), GROUP)


def claim_doc_types(claim_sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The document types behind each claim, one row per source; unknown types are left out."""
    return (
        claim_sources.select("claim_id", "chunk_id")
        .join(chunks.select("chunk_id", "doc_id"), "chunk_id")
        .join(documents.where(F.coalesce("doc_type", F.lit("")) != "").select("doc_id", "doc_type"), "doc_id")
        .select("claim_id", "doc_type")
    )


def rule_requires_source_doc_type(
    claims: DataFrame, doc_types: DataFrame, rules: Sequence[Rule]
) -> DataFrame:
    """A violation per selected subject with no claim from the required document type."""
    wanted = [rule for rule in _of(rules, "select") if rule.doc_type is not None]
    if not wanted:
        return _empty(claims, f"run_id {_run_type(claims)}, subject string, rule_id string, severity string, message string")
    needed = F.lit(None).cast("string")
    severity = F.lit(None).cast("string")
    for rule in wanted:
        needed = F.when(F.col("rule_id") == rule.rule_id, F.lit(rule.doc_type)).otherwise(needed)
        severity = F.when(F.col("rule_id") == rule.rule_id, F.lit(rule.severity)).otherwise(severity)
    types = doc_types.distinct()
    judged = (
        rule_select_subjects(claims, wanted)
        .join(types, "claim_id", "left")
        .groupBy(*GROUP, "rule_id")
        .agg(F.bool_or(F.coalesce(F.col("doc_type") == needed, F.lit(False))).alias("_ok"))
    )
    return judged.where(~F.col("_ok")).select(
        *GROUP,
        "rule_id",
        severity.alias("severity"),
        F.concat(
            F.lit("rule '"), F.col("rule_id"), F.lit("' failed for "), quoted(F.col("subject"))
        ).alias("message"),
    )


def rule_evidence(
    claims: DataFrame, claim_sources: DataFrame, doc_types: DataFrame, rules: Sequence[Rule]
) -> DataFrame:
    """What a model is shown for each ``select`` rule: one row per selected claim.

    Sorted by rule, subject and claim, the rows are the request. It stays a
    table, because a rule may select most of the corpus.
    """
    # the sources and types of one claim come from one response item: small
    quotes = claim_sources.groupBy("claim_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("chunk_id", "quote"))),
                lambda s: wrap_source(s["chunk_id"], s["quote"]),
            ),
            "\n\n",
        ).alias("quotes")
    )
    types = doc_types.groupBy("claim_id").agg(F.array_sort(F.collect_list("doc_type")).alias("_types"))
    return (
        rule_select_subjects(claims, rules)
        .join(quotes, "claim_id", "left")
        .join(types, "claim_id", "left")
        .select(
            "run_id",
            "rule_id",
            "subject",
            "claim_id",
            json_text(
                F.struct(
                    "subject",
                    "predicate",
                    "object",
                    F.col("claim_id").cast("string").alias("claim_id"),
                    F.coalesce("_types", F.array().cast("array<string>")).alias("source_doc_types"),
                )
            ).alias("evidence"),
            F.coalesce("quotes", F.lit("")).alias("quotes"),
        )
    )


# Texts of a JSON value that count as false. Fixed values.
FALSE_TEXTS = ["false", "[]", "{}"]


def _is_false(value: Column) -> Column:
    """Whether a JSON value counts as false: null, false, zero, or an empty text, list or object.

    A text with characters counts as true, ``"false"`` included.
    """
    kind = F.schema_of_variant(value)
    text = value.cast("string")
    return (
        F.when(kind == "VOID", F.lit(True))
        .when(kind == "STRING", text == "")
        .otherwise(text.isin(FALSE_TEXTS) | F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    )


def apply_verdicts(
    responses: DataFrame, claims: DataFrame, rules: Sequence[Rule]
) -> tuple[DataFrame, DataFrame]:
    """``(violations, errors)`` of model verdicts: ``run_id, rule_id, response`` of JSON lists.

    Verdicts on subjects the rule did not select are ignored, as are true ones. A
    response that is no JSON list, or has an item without subject or result, is
    an error, ``run_id, rule_id, error``, and yields no violations: its rule was not judged.
    """
    severity = F.lit(None).cast("string")
    for rule in _of(rules, "select"):
        severity = F.when(F.col("rule_id") == rule.rule_id, F.lit(rule.severity)).otherwise(severity)
    items = F.try_variant_get(F.try_parse_json("response"), "$", "array<variant>")
    item = F.transform(
        items,
        lambda v: F.struct(
            F.try_variant_get(v, "$.subject", "string").alias("subject"),
            F.try_variant_get(v, "$.result", "variant").alias("result"),
            F.try_variant_get(v, "$.reason", "string").alias("reason"),
        ),
    )
    incomplete = F.exists("_items", lambda v: v["subject"].isNull() | v["result"].isNull())
    # a generator, unlike a projection, is not repeated in the filters above it
    parsed = responses.select(
        "run_id", "rule_id", json_list_problem(F.col("response")).alias("_problem"), F.explode(F.array(item)).alias("_items")
    ).withColumn(
        "_problem", F.coalesce("_problem", F.when(F.coalesce(incomplete, F.lit(True)), F.lit("incomplete item")))
    )
    errors = parsed.where(F.col("_problem").isNotNull()).select("run_id", "rule_id", F.col("_problem").alias("error"))
    verdicts = parsed.where(F.col("_problem").isNull()).select("run_id", "rule_id", F.inline("_items"))
    failed = verdicts.where(_is_false(F.col("result")))
    default = F.concat(
        F.lit("rule '"), F.col("rule_id"), F.lit("' failed for "), quoted(F.col("subject"))
    )
    violations = failed.join(selected_subjects(claims, rules), [*GROUP, "rule_id"]).select(
        *GROUP,
        "rule_id",
        severity.alias("severity"),
        F.coalesce(F.nullif(F.col("reason"), F.lit("")), default).alias("message"),
    )
    return violations, errors


def quarantine_verdicts(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clean, findings)``: a verdict response with any smell is set aside whole.

    Every smell of it becomes a warning of the run.
    """
    # a generator, unlike a projection, is not repeated in the filters above it
    scanned = responses.select("*", F.explode(F.array(smells(F.col("response")))).alias("_smells"))
    clean = scanned.where(F.size("_smells") == 0).drop("_smells")
    findings = scanned.select("run_id", F.inline("_smells")).select(
        "run_id",
        F.lit("possible_prompt_injection").alias("rule_id"),
        F.lit("warning").alias("severity"),
        F.lit(None).cast("string").alias("subject"),
        F.concat(
            F.lit("examine: possible prompt injection smell in LLM response ("),
            "category",
            F.lit("): "),
            quoted(F.col("excerpt")),
        ).alias("message"),
    )
    return clean, findings


def evaluate_rules(
    claims: DataFrame,
    runs: DataFrame,
    doc_types: DataFrame,
    rules: Sequence[Rule],
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Violations of all rules.

    ``verdicts`` are model responses, if there are any: ``run_id, rule_id, response``. A response with a smell is
    set aside whole and becomes a warning; the others are judged, and one that cannot be read
    becomes an error of its rule, so that a rule that was not judged never looks clean.
    """
    parts = [
        rule_every_subject_has(claims, rules),
        rule_no_subject_has(claims, rules),
        rule_at_least_one(claims, runs, rules),
        rule_requires_source_doc_type(claims, doc_types, rules),
    ]
    judged = [rule for rule in _of(rules, "select") if rule.doc_type is None]
    if verdicts is not None and judged:
        clean, smelly = quarantine_verdicts(verdicts)
        found, unread = apply_verdicts(clean, claims, judged)
        unjudged = unread.select(
            "run_id",
            F.lit(None).cast("string").alias("subject"),
            "rule_id",
            F.lit("error").alias("severity"),
            F.concat(F.lit("rule '"), "rule_id", F.lit("' was not judged: "), "error").alias("message"),
        )
        parts += [found, smelly.select(*parts[0].columns), unjudged]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cited_claims(violations: DataFrame, claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(run_id, rule_id, subject, claim_id)``: the claims each violation cites.

    A forbidden value cites the claims that hold it, every other violation all
    claims of its subject; a violation without subject cites nothing.
    """
    bad = F.lit(True)
    for rule in _of(rules, "no_subject_has"):
        bad = F.when(F.col("rule_id") == rule.rule_id, _matches(rule)).otherwise(bad)
    heads = violations.where(F.col("subject").isNotNull()).select(*GROUP, "rule_id")
    return (
        claims.select(*GROUP, "claim_id", "predicate", "object")
        .join(heads, GROUP)
        .where(bad)
        .select("run_id", "rule_id", "subject", "claim_id")
    )


def finding_id() -> Column:
    """Stable id of a finding from its run, rule and subject."""
    name = F.concat_ws(
        ":", F.lit("finding"), F.col("run_id").cast("string"), "rule_id", F.coalesce("subject", F.lit(""))
    )
    return uuid5(PROPOSAL_NAMESPACE, name)


def findings_and_sources(
    violations: DataFrame, claims: DataFrame, rules: Sequence[Rule]
) -> tuple[DataFrame, DataFrame]:
    """Violations as pending ``findings`` and one ``finding_sources`` row per cited claim."""
    findings = violations.select(
        finding_id().alias("finding_id"),
        "run_id",
        "rule_id",
        "severity",
        "subject",
        "message",
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("reviewer"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )
    return findings, finding_source_rows(findings, claims, rules)


def finding_source_rows(findings: DataFrame, claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per finding and claim it cites; ``chunk_id`` is for sources without a claim."""
    return cited_claims(findings, claims, rules).select(
        finding_id().alias("finding_id"), F.lit(None).cast("long").alias("chunk_id"), "claim_id"
    )


def finding_events(findings: DataFrame) -> DataFrame:
    """One ``examine_finding`` audit record per finding."""
    return findings.select(
        "run_id",
        F.lit("examine_finding").alias("event_type"),
        json_text(F.struct("finding_id", "rule_id", "severity", "subject")).alias("payload"),
    )


def examine_clean(runs: DataFrame, violations: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One ``examine_clean`` record per run without a violation."""
    names = F.array(*[F.lit(rule.rule_id) for rule in rules])
    return runs.join(violations.select("run_id"), "run_id", "left_anti").select(
        "run_id",
        F.lit("examine_clean").alias("event_type"),
        json_text(F.struct(names.alias("rules_evaluated"))).alias("payload"),
    )
