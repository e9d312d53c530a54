"""Streaming queries: each runs over the given table, in several micro-batches, and reads its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators.embedding import llm_call_cost
from attestry.plans import tables, views
from attestry.plans.check_sql import uuid5
from attestry.plans.claim_queries import FIELDS_SQL, flat_fields
from attestry.plans.registry import query
from attestry.plans.review_queries import _overlay
from attestry.session import shared_dir
from attestry.streaming import commit, inbox, runs
from attestry.streaming.sink import newest_per_key


BATCHES = 3


def table_stream(spark, sf_dir, name, key):
    """A given table as a stream that arrives in order of ``key``, in three micro-batches."""
    whole = views.table(spark, sf_dir, name)
    folder = shared_dir(spark, f"arriving-{name}")
    low, high = whole.agg(F.min(key), F.max(key)).first()
    part = F.floor((F.col(key) - F.lit(low)) * BATCHES / F.lit((high or 0) - (low or 0) + 1))
    for number in range(BATCHES):
        whole.where(part == number).write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", -(-files // BATCHES))
    return stream.parquet(folder)


@query(
    "stream_inbox",
    """
WITH dropped AS (SELECT source AS corpus_id, sha256(text) AS content_hash, any_value(text) AS text, count(*) AS n_runs FROM documents WHERE doc_id % 4 <> 2 GROUP BY 1, 2)
SELECT corpus_id, content_hash, n_runs, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 800.0)::BIGINT + 1 END AS n_chunks FROM dropped""",
)
def stream_inbox(spark, sf_dir):
    """Documents dropped as files into the inbox of their source; one in four has a bad name."""
    suffix = F.get(
        F.array(*[F.lit(s) for s in [".md", ".txt", ".exe", ".MD"]]), (F.col("doc_id") % 4).cast("int")
    )
    files = table_stream(spark, sf_dir, "documents", "doc_id").select(
        F.concat(F.lit("/inbox/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.length("text").cast("long").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )
    corpora = (
        views.table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("corpus_id"))
        .agg(F.timestamp_micros(F.lit(1704067200000000)).alias("created_at"))
        .withColumn("inbox_path", F.concat(F.lit("/inbox/"), "corpus_id"))
    )
    folder = shared_dir(spark, "inbox")
    inbox.stream_inbox(files, corpora, folder).awaitTermination()
    documents = spark.read.parquet(f"{folder}/documents")
    n_chunks = spark.read.parquet(f"{folder}/chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    n_runs = (
        spark.read.parquet(f"{folder}/runs")
        .groupBy(F.col("triggering_document_id").alias("doc_id"))
        .agg(F.count("*").alias("n_runs"))
    )
    return (
        documents.select("doc_id", "corpus_id", "content_hash")
        .join(n_chunks, "doc_id", "left")
        .join(n_runs, "doc_id")
        .select("corpus_id", "content_hash", "n_runs", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    )


@query(
    "stream_current_stage",
    """
SELECT run_id, regexp_replace(arg_max(event_type, id), '_(start|end)$', '') AS stage FROM audit WHERE event_type LIKE '%\\_start' ESCAPE '\\' OR event_type LIKE '%\\_end' ESCAPE '\\' GROUP BY run_id""",
)
def stream_current_stage(spark, sf_dir):
    events = views.audit_view(table_stream(spark, sf_dir, "events", "event_id"))
    folder = shared_dir(spark, "stage")
    runs.stream_current_stage(events, folder).awaitTermination()
    return newest_per_key(spark, f"{folder}/stage", ["run_id"])


@query(
    "stream_run_events",
    """
SELECT a.id, a.run_id, a.event_type FROM audit a LEFT JOIN (SELECT run_id, min(id) AS last_id FROM audit WHERE event_type = 'run_completed' GROUP BY 1) e USING (run_id)
WHERE e.last_id IS NULL OR a.id <= e.last_id""",
)
def stream_run_events(spark, sf_dir):
    events = views.audit_view(table_stream(spark, sf_dir, "events", "event_id"))
    folder = shared_dir(spark, "feed")
    runs.stream_run_events(events, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/feed").select("id", "run_id", "event_type")


@query(
    "stream_run_cost",
    """
SELECT run_id, stage, count(*)::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(latency_ms)::BIGINT AS latency_ms, sum(micro_usd)::BIGINT AS micro_usd FROM priced GROUP BY 1, 2""",
)
def stream_run_cost(spark, sf_dir):
    calls = llm_call_cost(views.cost_view(table_stream(spark, sf_dir, "events", "event_id")))
    folder = shared_dir(spark, "cost")
    runs.stream_run_cost(calls, folder).awaitTermination()
    return newest_per_key(spark, f"{folder}/cost", ["run_id", "stage"])


@query(
    "stream_commit",
    f"""
SELECT e.entry_id, {", ".join(_overlay(f) for f in ["name", "owner", "target_release", "status"])},
  coalesce(max(c.new_value) FILTER (WHERE c.field = 'open_risks'), array_to_string(any_value(e.open_risks), '|')) AS open_risks,
  (1 + count(c.item_id))::INTEGER AS version
FROM entries e LEFT JOIN (SELECT * FROM change_state WHERE state = 'approved') c ON c.corpus_id = e.corpus_id AND c.feature_key = e.feature_key GROUP BY e.entry_id
UNION ALL SELECT {uuid5("'entry:' || corpus_id || ':' || feature_key")}, {FIELDS_SQL}, 1 FROM addition_state WHERE state = 'approved'""",
)
def stream_commit(spark, sf_dir):
    """Labels arrive as decisions on the proposals that rest on their document."""
    additions, changes = tables.additions(spark, sf_dir), tables.changes(spark, sf_dir)
    backing = tables.addition_claims(spark, sf_dir)
    names = backing.where(F.col("field") == "name").select("item_id", "claim_id")
    items = (
        additions.join(names, "item_id")
        .select("run_id", "item_id", tables.document_of("claim_id"))
        .unionByName(changes.select("run_id", "item_id", tables.document_of("claim_id")))
    )
    stamp = F.timestamp_micros(F.lit(1719878400000000))
    folder = shared_dir(spark, "commit")
    commit.stream_commit(
        table_stream(spark, sf_dir, "labels", "doc_id"),
        tables.entries(spark, sf_dir),
        tables.field_sources(spark, sf_dir),
        additions.withColumn("committed_at", stamp),
        backing,
        changes.withColumn("committed_at", stamp),
        folder,
        prepare=lambda labels: tables.decisions_from_labels(labels, items, "register_change"),
    ).awaitTermination()
    after = commit.latest_snapshot(spark, f"{folder}/entries")
    return flat_fields(after.select("entry_id", "fields", "version"))
