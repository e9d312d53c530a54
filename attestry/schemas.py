"""Table schemas and the values their enumerated columns may hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "struct<name:string,owner:string,target_release:string,status:string,open_risks:array<string>>"

# Ids are texts in stored tables; operators accept any sortable id type.
SCHEMAS = {
    "corpora": "corpus_id string, name string, inbox_path string, rules_path string, created_at timestamp",
    "documents": "doc_id string, corpus_id string, filename string, content_hash string, mime_type string,"
    " doc_type string, ingested_at timestamp, text string",
    "chunks": "chunk_id string, doc_id string, corpus_id string, idx int, text string, page int,"
    " char_start long, char_end long, embedding array<float>",
    "claims": "claim_id string, run_id string, corpus_id string, subject string, predicate string,"
    " object string, confidence float, created_at timestamp",
    "claim_sources": "claim_id string, chunk_id string, quote string",
    "conflicts": "conflict_id string, run_id string, subject string, predicate string, claim_a_id string,"
    " claim_b_id string, resolution string, resolved_by string, resolved_at timestamp",
    "findings": "finding_id string, run_id string, rule_id string, severity string, subject string,"
    " message string, status string, reviewer string, reviewed_at timestamp",
    "finding_sources": "finding_id string, chunk_id string, claim_id string",
    "register_entries": f"entry_id string, corpus_id string, feature_key string, fields {FIELDS},"
    " version int, last_updated_run_id string, updated_at timestamp",
    "register_field_sources": "entry_id string, field string, claim_id string",
    "reviews": "run_id string, item_type string, item_id string, decision string, note string,"
    " reviewer string, decided_at timestamp",
    "audit_events": "id long, run_id string, event_type string, payload string, occurred_at timestamp",
    "cost_events": "id long, run_id string, stage string, model string, input_tokens int,"
    " output_tokens int, latency_ms int, usd_cost decimal(10,6), occurred_at timestamp",
    "runs": "run_id string, corpus_id string, kind string, status string, triggering_document_id string,"
    " started_at timestamp, idempotency_key string",
}

# Fixed values.
ALLOWED = {
    ("runs", "kind"): ["initial", "update"],
    ("runs", "status"): [
        "pending",
        "running",
        "awaiting_review",
        "committing",
        "done",
        "failed",
        "cancelled",
    ],
    ("conflicts", "resolution"): ["unresolved", "kept_a", "kept_b", "kept_both", "rejected_both"],
    ("findings", "severity"): ["info", "warning", "error"],
    ("findings", "status"): ["pending", "approved", "rejected"],
    ("reviews", "item_type"): ["claim", "conflict", "finding", "register_change"],
    ("reviews", "decision"): ["approve", "reject"],
}


def value_check(df: DataFrame, table: str) -> DataFrame:
    """Rows per enumerated column of ``table``, valid and not: ``column_name, rows, invalid``.

    One pass over the table for all its columns. Absent columns are skipped.
    """
    columns = [column for name, column in ALLOWED if name == table and column in df.columns]
    bad = [
        F.count_if(~F.coalesce(F.col(c).isin(ALLOWED[table, c]), F.lit(False))).alias(c) for c in columns
    ]
    counted = df.agg(F.count("*").alias("_rows"), *bad)
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), F.col(c).alias("invalid")) for c in columns]
    )
    return counted.select(F.lit(table).alias("table_name"), F.inline(rows))


def value_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """``value_check`` of several tables in one result."""
    return reduce(lambda a, b: a.unionByName(b), [value_check(df, name) for name, df in tables.items()])


def valid_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows whose enumerated columns all hold allowed values."""
    for name, column in ALLOWED:
        if name == table and column in df.columns:
            df = df.where(F.col(column).isin(ALLOWED[name, column]))
    return df
