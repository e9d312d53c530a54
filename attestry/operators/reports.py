"""Read models: citations, register view, runs, stages, cost and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.ordering import running_total
from attestry.operators.embedding import INPUT_PRICE, MAX_OUTPUT_TOKENS, OUTPUT_PRICE, as_usd

# Characters of context on each side of a quote. Fixed value.
SNIPPET_PADDING = 80

# Stages in graph order. Fixed values.
STAGES = [
    "classify",
    "classify_review",
    "extract",
    "detect_conflicts",
    "examine",
    "build_register",
    "human_gate",
    "commit",
    "finish",
]
TERMINAL_EVENTS = ["run_completed", "run_failed"]
STAGE_EVENT = r"(?s)^(.*)_(start|end)$"


def citation_snippet(text: Column, quote: Column) -> list[Column]:
    """``snippet, highlight_start, highlight_end`` of a quote inside a chunk text.

    A quote that is not there is treated as an empty one at the start.
    """
    found = F.instr(text, quote) - 1
    at = F.greatest(found, F.lit(0))
    width = F.when(found >= 0, F.length(quote)).otherwise(F.lit(0))
    begin = F.greatest(at - SNIPPET_PADDING, F.lit(0))
    end = F.least(F.length(text), at + width + SNIPPET_PADDING)
    return [
        F.substr(text, begin + 1, end - begin).alias("snippet"),
        (at - begin).alias("highlight_start"),
        (at - begin + width).alias("highlight_end"),
    ]


def citations(claim_sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Every claim source with its document, span and highlighted snippet."""
    quote = F.col("quote")
    # the snippet is cut where quote and text meet, so the text travels no further; it streams past the quotes unsorted
    cut = claim_sources.hint("shuffle_hash").join(
        chunks.select("chunk_id", "doc_id", "page", "char_start", "char_end", "text"), "chunk_id"
    ).select(
        *claim_sources.columns,
        "doc_id",
        "page",
        "char_start",
        "char_end",
        *citation_snippet(F.col("text"), quote),
    )
    names = documents.select("doc_id", F.col("filename").alias("document_filename"))
    return cut.join(names, "doc_id")


def register_view_rows(
    entries: DataFrame, field_sources: DataFrame, claims: DataFrame, cited: DataFrame
) -> DataFrame:
    """A row per entry, field, claim and citation: the register view without nesting.

    ``cited`` comes from ``citations``. The entry's own columns are not repeated; a claim without a citation has a row
    of nulls there. However many claims a field has gathered, no row grows.
    """
    backing = (
        entries.select("entry_id")
        .join(field_sources.select("entry_id", "field", "claim_id"), "entry_id")
        .join(claims.select("claim_id", "predicate", "object", "confidence"), "claim_id")
    )
    return backing.join(cited, "claim_id", "left").select(
        "entry_id", "field", "claim_id", "predicate", "object", "confidence", *[c for c in cited.columns if c != "claim_id"]
    )


def register_view(
    entries: DataFrame, field_sources: DataFrame, claims: DataFrame, cited: DataFrame
) -> DataFrame:
    """Entries with ``field_claims``: field to claims to citations, one row per entry, for export.

    ``cited`` comes from ``citations``. Where commits keep the old claims of a changed field (mode "append"), the nested
    value gains a claim per committed change; ``register_view_rows`` holds the same without nesting, and a caller
    nests the entries it shows.
    """
    rows = register_view_rows(entries, field_sources, claims, cited)
    one = F.struct(*[c for c in cited.columns if c != "claim_id"])
    nested = rows.groupBy("entry_id", "field", "claim_id", "predicate", "object", "confidence").agg(
        F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), one))).alias("sources")
    )
    per_field = nested.groupBy("entry_id", "field").agg(
        F.array_sort(
            F.collect_list(F.struct("claim_id", "predicate", "object", "confidence", "sources"))
        ).alias("claims")
    )
    per_entry = per_field.groupBy("entry_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "claims"))).alias("field_claims")
    )
    return entries.join(per_entry, "entry_id", "left")


def entry_sources(field_sources: DataFrame, cited: DataFrame) -> DataFrame:
    """Distinct citation spans of an entry: one row per entry, chunk and span."""
    return (
        field_sources.select("entry_id", "claim_id")
        .distinct()
        .join(cited.select("claim_id", "chunk_id", "char_start", "char_end"), "claim_id")
        .select("entry_id", "chunk_id", "char_start", "char_end")
        .distinct()
    )


def register_sorted(
    entries: DataFrame, sources: DataFrame, by: str = "feature", ascending: bool = True
) -> DataFrame:
    """Entries ordered by feature, owner, target_release, status, open_risks or sources."""
    counted = entries.join(
        sources.groupBy("entry_id").agg(F.count("*").alias("n_sources")), "entry_id", "left"
    ).withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))

    def text(field: str) -> Column:
        return F.collate(F.lower(F.coalesce(f"fields.{field}", F.lit(""))), "UNICODE")

    name = F.coalesce(F.nullif(F.col("fields.name"), F.lit("")), F.col("feature_key"))
    key = {
        "feature": F.collate(F.lower(name), "UNICODE"),
        "owner": text("owner"),
        "target_release": text("target_release"),
        "status": text("status"),
        "open_risks": F.coalesce(F.size("fields.open_risks"), F.lit(0)),
        "sources": F.col("n_sources"),
    }[by]
    return counted.orderBy(key.asc() if ascending else key.desc(), F.asc("corpus_id"), F.asc("feature_key"))


def stage_event(event_type: Column) -> tuple[Column, Column]:
    """Stage name and phase of a stage event; empty texts for any other event."""
    return F.regexp_extract(event_type, STAGE_EVENT, 1), F.regexp_extract(event_type, STAGE_EVENT, 2)


def current_stage(events: DataFrame) -> DataFrame:
    """Stage of the newest start or end event, by id, per run."""
    stage, phase = stage_event(F.col("event_type"))
    return (
        events.where(phase != "")
        .groupBy("run_id")
        .agg(F.max_by(stage, F.col("id")).alias("stage"))
    )


def run_counts(runs: DataFrame, claims: DataFrame, conflicts: DataFrame, findings: DataFrame) -> DataFrame:
    """Claims, conflicts and findings per run, zero where there are none.

    Each side is a table with ``run_id`` and either one row per item or an
    already counted column of the same name.
    """
    result = runs.select("run_id").distinct()
    for name, df in [("claims", claims), ("conflicts", conflicts), ("findings", findings)]:
        amount = F.sum(name) if name in df.columns else F.count("*")
        counted = df.groupBy("run_id").agg(amount.cast("long").alias(name))
        result = result.join(counted, "run_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return result


def run_cost(costs: DataFrame) -> DataFrame:
    """Calls, tokens, latency and dollars per run and stage, plus a total row (stage null)."""
    measures = ["calls", "input_tokens", "output_tokens", "latency_ms", "micro_usd"]
    stages = costs.groupBy("run_id", "stage").agg(
        F.count("*").alias("calls"), *[F.sum(m).alias(m) for m in measures[1:]]
    )
    # the total is taken over the stage sums, not over the calls a second time
    return (
        stages.groupingSets([["run_id", "stage"], ["run_id"]], "run_id", "stage")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("usd_cost", as_usd(F.col("micro_usd")))
    )


def run_audit(events: DataFrame) -> DataFrame:
    """The trail of every run in order of time, then id."""
    return events.orderBy("run_id", "occurred_at", "id")


def stage_timeline(runs: DataFrame, events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Every stage of every run: pending, running or done, with its newest payloads.

    Unknown stages are ignored; the last event of a stage decides.
    """
    stage, phase = stage_event(F.col("event_type"))
    seen = events.select("run_id", "id", "payload", stage.alias("stage"), phase.alias("phase"))
    newest = (
        seen.where(F.col("stage").isin(list(stages)))
        .groupBy("run_id", "stage")
        .agg(
            F.max_by("phase", "id").alias("_phase"),
            F.max_by("payload", F.when(F.col("phase") == "start", F.col("id"))).alias("start_payload"),
            F.max_by("payload", F.when(F.col("phase") == "end", F.col("id"))).alias("end_payload"),
        )
    )
    listed = F.array(*[F.lit(s) for s in stages])
    grid = runs.select("run_id").distinct().select("run_id", F.posexplode(listed).alias("position", "stage"))
    status = (
        F.when(F.col("_phase") == "start", F.lit("running"))
        .when(F.col("_phase") == "end", F.lit("done"))
        .otherwise(F.lit("pending"))
    )
    return grid.join(newest, ["run_id", "stage"], "left").select(
        "run_id", "position", "stage", status.alias("status"), "start_payload", "end_payload"
    )


# Calls of one block of a run; bounds the work of a single window.
CALLS_PER_BLOCK = 10_000


def worst_case_micro_usd(prompt_chars: Column) -> Column:
    """Upper estimate of a call: about four characters a token, and a full answer."""
    tokens = F.greatest(F.floor(prompt_chars / 4), F.lit(1))
    return (tokens * INPUT_PRICE + MAX_OUTPUT_TOKENS * OUTPUT_PRICE).cast("long")


def budget_breaches(calls: DataFrame, budget_micro_usd: int) -> DataFrame:
    """Calls whose run had spent so much before that their worst case passes the budget.

    ``calls``: ``id, run_id, micro_usd, estimate``. The spend before a call is a
    running total, taken over blocks of ids first, so a run with very many
    calls is not one task.
    """
    spent = running_total(
        calls, ["run_id"], ["id"], F.floor(F.col("id") / CALLS_PER_BLOCK), F.col("micro_usd"), "spent"
    )
    return spent.where(F.col("spent") + F.col("estimate") > budget_micro_usd)


def runs_list(runs: DataFrame, corpora: DataFrame, costs: DataFrame) -> DataFrame:
    """Runs, newest first, with the corpus name (or a short id) and the total cost."""
    totals = costs.groupBy("run_id").agg(F.sum("micro_usd").alias("micro_usd"))
    names = corpora.select("corpus_id", F.col("name").alias("_name"))
    return (
        runs.join(names, "corpus_id", "left")
        .join(totals, "run_id", "left")
        .withColumn("micro_usd", F.coalesce("micro_usd", F.lit(0)))
        .withColumn("corpus", F.coalesce("_name", F.substr(F.col("corpus_id"), F.lit(1), F.lit(8))))
        .drop("_name")
        .orderBy(F.desc("started_at"), F.asc("run_id"))
    )


def corpora_list(corpora: DataFrame) -> DataFrame:
    """Corpora, newest first."""
    return corpora.orderBy(F.desc("created_at"), F.asc("corpus_id"))


def idempotent_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(resolved, conflicts)`` of run requests ``request_id, corpus_id, idempotency_key``.

    The first request of a key makes the run; a later one with the same corpus
    returns it, one with another corpus is a conflict. Requests without a key
    always make a run. ``request_id`` gives the order.
    """
    keyed = F.coalesce("idempotency_key", F.lit("")) != ""
    first = (
        requests.where(keyed)
        .groupBy("idempotency_key")
        .agg(F.min_by(F.struct("request_id", "corpus_id"), "request_id").alias("_first"))
    )
    plain = requests.where(~keyed).select(
        "request_id",
        "corpus_id",
        "idempotency_key",
        F.col("request_id").alias("run_request"),
        F.lit(True).alias("created"),
    )
    joined = requests.where(keyed).join(first, "idempotency_key")
    same = F.col("corpus_id") == F.col("_first.corpus_id")
    resolved = joined.where(same).select(
        "request_id",
        "corpus_id",
        "idempotency_key",
        F.col("_first.request_id").alias("run_request"),
        (F.col("request_id") == F.col("_first.request_id")).alias("created"),
    )
    conflicts = joined.where(~same).select(
        "request_id",
        "corpus_id",
        "idempotency_key",
        F.col("_first.corpus_id").alias("first_corpus_id"),
    )
    return plain.unionByName(resolved), conflicts


def inbox_owner(files: DataFrame, corpora: DataFrame) -> DataFrame:
    """The corpus of each file by its inbox folder: the oldest corpus wins, none drops the file."""
    owner = (
        corpora.where(F.col("inbox_path").isNotNull())
        .groupBy("inbox_path")
        .agg(F.min_by("corpus_id", F.struct("created_at", "corpus_id")).alias("corpus_id"))
    )
    return files.join(owner, "inbox_path")
