"""Documents and chunks: dedupe, sliding windows, scope, highlighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.sources.segments import heading_segments

# Window length and step in characters. Fixed values.
CHUNK_SIZE = 1000
CHUNK_STEP = 800


def dedupe(documents: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first document of every key, by ``order``.

    ``min_by`` combines before the shuffle, so a content that fills a third of
    the table sends one row per task, not all its copies.
    """
    rest = [c for c in documents.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return documents.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*documents.columns)


def dedupe_documents(documents: DataFrame, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One document per corpus and content hash."""
    return dedupe(documents, ["corpus_id", "content_hash"], order)


def dedupe_by_filename(documents: DataFrame, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One document per corpus and file name, for encoders whose bytes differ per run."""
    return dedupe(documents, ["corpus_id", "filename"], order)


def new_documents(
    incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("corpus_id", "content_hash")
) -> DataFrame:
    """Incoming documents whose key is not stored yet."""
    return incoming.join(stored.select(*keys), list(keys), "left_anti")


def windows(segment: Column) -> Column:
    """Sliding windows of one segment as an array of structs.

    The text is cut once into step-sized pieces; a window is a piece plus the
    head of the next one. That reads the text once, where a ``substr`` per
    window would walk it from the start each time.
    """
    size, step = F.lit(CHUNK_SIZE), F.lit(CHUNK_STEP)
    length = (segment["char_end"] - segment["char_start"]).cast("int")
    count = (
        F.when(length == 0, F.lit(0))
        .when(length <= size, F.lit(1))
        .otherwise(F.ceil((length - size) / step).cast("int") + 1)
    )
    cut = F.regexp_extract_all(segment["text"], F.lit(f"(?s).{{1,{CHUNK_STEP}}}"), F.lit(0))

    def from_pieces(pieces: Column) -> Column:
        def window(piece: Column, k: Column) -> Column:
            head = F.substr(F.coalesce(F.get(pieces, k + 1), F.lit("")), F.lit(1), size - step)
            start = segment["char_start"] + k * step
            return F.struct(
                F.concat(piece, head).alias("text"),
                start.alias("char_start"),
                F.least(start + size, segment["char_end"]).alias("char_end"),
                segment["page"].alias("page"),
                k.alias("window"),
            )

        return F.slice(F.transform(pieces, window), F.lit(1), count)

    # the one-element array binds the pieces, so they are cut once per segment
    return F.flatten(F.transform(F.array(cut), from_pieces))


def chunk_documents(
    documents: DataFrame, keep: Sequence[str] = ("doc_id",), segments: Column | None = None
) -> DataFrame:
    """Chunk every document: ``keep`` columns, ``idx``, offsets, ``page``, ``text``.

    ``segments`` is the array of segments of a row; by default headings split
    ``text``. Windows never cross a segment. A document is one row, so chunking
    is a projection: no shuffle.
    """
    parts = heading_segments(F.col("text")) if segments is None else segments
    return documents.select(
        *keep, F.posexplode(F.flatten(F.transform(parts, windows))).alias("idx", "chunk")
    ).select(
        *keep,
        "idx",
        "chunk.char_start",
        "chunk.char_end",
        "chunk.page",
        "chunk.window",
        "chunk.text",
    )


def chunk_segments(segments: DataFrame, key: str, seg: str = "seg") -> DataFrame:
    """Chunk a table of segments that already have offsets.

    ``idx`` runs through the document: the windows of earlier segments are
    counted first, block-wise, so a huge document is not one task.
    """
    from attestry.functions.ordering import running_total

    page = F.col("page") if "page" in segments.columns else F.lit(None).cast("int")
    counted = segments.withColumn("page", page).withColumn(
        "_windows",
        windows(F.struct("text", "char_start", "char_end", "page")),
    )
    placed = running_total(
        counted, [key], [seg], F.floor(F.col(seg) / 4096), F.size("_windows"), "_first"
    )
    return placed.select(key, "_first", F.posexplode("_windows").alias("_k", "chunk")).select(
        key,
        (F.col("_first") + F.col("_k")).cast("int").alias("idx"),
        "chunk.char_start",
        "chunk.char_end",
        "chunk.page",
        "chunk.text",
    )


def highlight_span(documents: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text before, inside and after every span, with the span clamped to the text."""
    length = F.length("text").cast("long")
    start = F.greatest(F.lit(0), F.least(F.col("span_start"), length))
    end = F.greatest(F.col("_start"), F.least(F.col("span_end"), length))
    return (
        spans.join(documents.select(key, "text"), key)
        .withColumn("_start", start)
        .withColumn("_end", end)
        .select(
            *spans.columns,
            F.expr("substr(text, 1, cast(_start as int))").alias("before"),
            F.expr("substr(text, cast(_start + 1 as int), cast(_end - _start as int))").alias("marked"),
            F.expr("substr(text, cast(_end + 1 as int))").alias("after"),
        )
    )


def initial_scope(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Every document of a run's corpus, for runs over the whole corpus."""
    initial = runs.where(F.col("kind") == "initial").select("run_id", "corpus_id")
    listed = documents.select("corpus_id", "doc_id", "filename", "ingested_at")
    return initial.join(listed, "corpus_id").select("run_id", *listed.columns)


def run_scope(documents: DataFrame, runs: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Documents each run looks at: the corpus, or the trigger and its neighbours.

    ``neighbors`` holds ``(run_id, doc_id)`` as ``neighbor_documents`` finds them.
    """
    columns = ["run_id", "corpus_id", "doc_id", "filename"]
    update = runs.where(F.col("kind") == "update")
    trigger = update.select("run_id", F.col("triggering_document_id").alias("doc_id"))
    wanted = trigger.unionByName(neighbors.select("run_id", "doc_id")).distinct()
    narrow = wanted.join(documents.select("corpus_id", "doc_id", "filename"), "doc_id").select(columns)
    return initial_scope(documents, runs).select(columns).unionByName(narrow)
