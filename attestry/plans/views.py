"""Claims, runs and register tables derived from the given tables.

The given tables hold documents, vectors, events and labels; the tables the
operators work on are derived from them here, row by row, so their size follows
the data. Subjects carry a thousand-document era, so the number of features
grows with the documents and a feature keeps a bounded number of claims.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import cells, extract, grams
from attestry.operators.chunks import chunk_documents
from attestry.operators.classify import DOC_TYPES
from attestry.session import shared_dir

CHUNKS_PER_DOCUMENT = 1_000_000


_WRITTEN: dict[tuple[str, str, str], str] = {}
_LOCK = threading.RLock()


def stored(
    build: Callable[[SparkSession, str], DataFrame] | None = None, *, group_rows: int | None = None
) -> Callable[..., DataFrame]:
    """A derived table that is written once per session to the shared folder, then read.

    Chunks, claims or the register are stored tables in use; deriving them anew
    in every query that reads them would repeat the whole ingestion. ``group_rows`` bounds the rows that a writer or
    reader holds at once, for tables with rows of megabytes.
    """
    if build is None:
        return functools.partial(stored, group_rows=group_rows)

    @functools.wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f"{build.__module__}.{build.__name__}")
        with _LOCK:
            if key in _WRITTEN:
                try:
                    return spark.read.parquet(_WRITTEN[key])
                except AnalysisException:
                    pass  # the folder was cleared: write it again
            path = shared_dir(spark, build.__name__)
            writer = build(spark, sf_dir).write.option("compression", "zstd")
            if group_rows is not None:
                writer = writer.option("parquet.block.row.count.limit", str(group_rows))
            writer.parquet(path)
            _WRITTEN[key] = path
            return spark.read.parquet(path)

    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _era(doc_id: Column) -> Column:
    return F.floor(doc_id / 1000)


def _wave(doc_id: Column) -> Column:
    return F.floor(doc_id / 20) % 5


def run_of(doc_id: Column, corpus_id: Column) -> Column:
    update = F.concat(corpus_id, F.lit(":update-"), _era(doc_id).cast("string"))
    return F.when(_wave(doc_id) == 4, update).otherwise(F.concat(corpus_id, F.lit(":initial")))


def subject_of(doc_id: Column, lang: Column) -> Column:
    tail = F.concat(
        (F.floor(doc_id / 100) % 4).cast("string"), F.lit("."), _era(doc_id).cast("string")
    )
    title = F.concat(F.lit("Feature "), F.upper(lang), F.lit(" "), tail)
    return F.when(doc_id % 3 == 0, F.lower(F.replace(title, F.lit("."), F.lit("/")))).otherwise(title)


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, text = F.col("doc_id"), F.col("text")
    types = F.array(*[F.lit(t) for t in DOC_TYPES])
    newline = F.lit("\n")
    return raw_documents(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("corpus_id"),
        F.concat(F.lit("doc_"), doc_id.cast("string"), F.lit(".md")).alias("filename"),
        "lang",
        F.when(
            doc_id % 10 == 0, F.concat(F.lit("# "), F.replace(text, newline, F.lit("\n# ")))
        )
        .when(doc_id % 5 == 0, F.concat(F.lit("# Part\n"), text))
        .otherwise(text)
        .alias("text"),
        F.when(doc_id % 19 != 0, F.get(types, (doc_id % 7).cast("int"))).alias("doc_type"),
        F.when(
            doc_id % 23 != 0,
            F.timestamp_micros(F.lit(1704067200000000) + doc_id * F.lit(60000000)),
        ).alias("ingested_at"),
        run_of(doc_id, F.col("source")).alias("run_id"),
    )


def cut_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["doc_id", "corpus_id", "run_id", "lang"]
    cut = chunk_documents(documents(spark, sf_dir), keep)
    chunk_id = F.col("doc_id") * CHUNKS_PER_DOCUMENT + F.col("idx")
    return cut.withColumn("chunk_id", chunk_id)


@stored
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_chunks(spark, sf_dir)


@stored(group_rows=grams.GROUP_ROWS)
def gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gram sets of the stored chunks, in blocks."""
    return grams.gram_blocks(chunks(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One initial run per corpus and one update run per corpus and era."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("corpus_id"), run_of(F.col("doc_id"), F.col("source")).alias("run_id")
    )
    kind = F.when(F.col("run_id").endswith(":initial"), F.lit("initial")).otherwise(F.lit("update"))
    return (
        docs.groupBy("run_id", "corpus_id")
        .agg(F.max("doc_id").alias("last_doc"), F.min("doc_id").alias("first_doc"))
        .select(
            "run_id",
            "corpus_id",
            kind.alias("kind"),
            F.when(kind == "update", F.col("last_doc")).alias("triggering_document_id"),
            F.timestamp_micros(
                F.lit(1704067200000000) + F.col("first_doc") * F.lit(60000000)
            ).alias("started_at"),
        )
    )


def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extracted claim per chunk with its quoted sources, some of them wrong.

    Wrong are a quote that is not in the chunk, a source of another document,
    and a claim without any source.
    """
    n = F.col("doc_id") + F.col("idx")
    predicate = F.get(
        F.array(*[F.lit(p) for p in ["owner", "target_release", "status", "risk", "note"]]),
        (n % 5).cast("int"),
    )
    here = F.substr(F.col("text"), F.lit(5), F.lit(30))
    quote = F.when(n % 11 == 0, F.concat(here, F.lit("~~"))).otherwise(here)
    cited = F.when(n % 13 == 0, (F.col("doc_id") + 1) * CHUNKS_PER_DOCUMENT).otherwise(F.col("chunk_id"))
    main = F.struct(cited.alias("chunk_id"), quote.alias("quote"))
    before = F.struct((F.col("chunk_id") - 1).alias("chunk_id"), quote.alias("quote"))
    sources = (
        F.when(n % 17 == 0, F.slice(F.array(main), 1, 0))
        .when((n % 4 == 0) & (F.col("window") > 0), F.array(main, before))
        .otherwise(F.array(main))
    )
    return chunks(spark, sf_dir).select(
        F.col("chunk_id").alias("claim_id"),
        "run_id",
        "corpus_id",
        "doc_id",
        "idx",
        subject_of(F.col("doc_id"), F.col("lang")).alias("subject"),
        predicate.alias("predicate"),
        F.concat(F.lit("v"), ((F.col("doc_id") * 7 + F.col("idx") * 3) % 4).cast("string")).alias("object"),
        (((F.col("doc_id") * 13 + F.col("idx") * 5) % 10) / 10).cast("float").alias("confidence"),
        sources.alias("sources"),
    )


@stored
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that quote verification keeps."""
    return extract.accepted_claims(extract.verify_quotes(claim_candidates(spark, sf_dir), chunks(spark, sf_dir)))


@stored
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.split_claims_sources(accepted(spark, sf_dir))[0]


@stored
def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.split_claims_sources(accepted(spark, sf_dir))[1]


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_view(table(spark, sf_dir, "events"))


def audit_view(events: DataFrame) -> DataFrame:
    """Event rows read as a run's audit trail."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "view", "classify")
        .when(kind == "click", "extract")
        .when(kind == "signup", "detect_conflicts")
        .when(kind == "purchase", "examine")
        .otherwise("register_entry_proposed")
    )
    phase = (
        F.when(kind == "error", "").when(F.col("event_id") % 2 == 0, "_start").otherwise("_end")
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_id") % 97 == 0, F.lit("run_completed"))
        .otherwise(F.concat(stage, phase))
        .alias("event_type"),
        F.col("props").alias("payload"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
    )


def cost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_view(table(spark, sf_dir, "events"))


def cost_view(events: DataFrame) -> DataFrame:
    """Event rows read as model calls with their token counts."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "view", "classify")
        .when(kind == "click", "extract")
        .when(kind == "signup", "examine")
        .otherwise("embed")
    )
    model = F.when(F.col("event_id") % 3 == 0, "unlisted-model").otherwise("default-model")
    return events.where(kind != "error").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("run_id"),
        stage.alias("stage"),
        model.alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"),
        (F.col("event_id") % 500).alias("output_tokens"),
        (F.col("event_id") % 1000).alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that the audit and cost events belong to."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run_id"))
        .agg(F.min(F.col("ts").cast("timestamp")).alias("started_at"))
        .withColumn("corpus_id", F.concat(F.lit("src"), (F.col("run_id") % 20).cast("string")))
    )


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora with a name and an inbox; several share one inbox, some are not listed."""
    number = F.substr(F.col("source"), F.lit(4)).cast("int")
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.min("doc_id").alias("first_doc"))
        .where(number % 7 != 3)
        .select(
            F.col("source").alias("corpus_id"),
            F.concat(F.lit("Corpus "), number.cast("string")).alias("name"),
            F.concat(F.lit("/inbox/"), (number % 6).cast("string")).alias("inbox_path"),
            F.timestamp_micros(
                F.lit(1704067200000000) + F.col("first_doc") * F.lit(60000000)
            ).alias("created_at"),
        )
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a vector where the given vectors have one; every ninth stays without."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (
        chunks(spark, sf_dir)
        .withColumn("vec_id", F.col("doc_id") + F.col("idx"))
        .join(vectors.where(F.col("vec_id") % 9 != 0), "vec_id", "left")
        .drop("vec_id")
    )


@stored(group_rows=cells.GROUP_ROWS)
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.vector_cells(chunk_vectors(spark, sf_dir))


def _as_queries(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """``query_id, number, vec_id, query`` with the corpus of the number and the vector of the id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    corpus = F.concat(F.lit("src"), (F.col("number") % 20).cast("string"))
    return texts.withColumn("corpus_id", corpus).join(vectors, "vec_id", "left").drop("number", "vec_id")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    texts = table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"), item.alias("number"), item.alias("vec_id"), F.col("text").alias("query")
    )
    return _as_queries(spark, sf_dir, texts)


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a query."""
    conversation, turn = F.col("conv_id"), F.col("turn")
    texts = table(spark, sf_dir, "conversations").select(
        (conversation * 1000 + turn).alias("query_id"),
        conversation.alias("number"),
        (conversation + turn).alias("vec_id"),
        F.col("text").alias("query"),
    )
    return _as_queries(spark, sf_dir, texts)
