"""New files to documents, chunks and update runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.functions.ids import PROPOSAL_NAMESPACE, uuid5
from attestry.operators.chunks import chunk_documents, chunk_segments, dedupe, new_documents
from attestry.operators.reports import inbox_owner
from attestry.sources.files import FILE_SCHEMA, rejected_files, scan_documents
from attestry.sources.segments import joined_text, segment_csv_rows, segment_json_elements
from attestry.streaming.keyed import KeyedLog
from attestry.streaming.sink import read_batch, start, write_batch

CONTENT = ["corpus_id", "content_hash"]
REFUSED = ["path", "corpus_id", "filename", "extension", "reason"]
DOCUMENT = ["doc_id", "corpus_id", "filename", "content_hash", "mime_type", "text"]


def read_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they land. They must appear by rename; names starting with a dot are skipped."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(folder)


def inbox_path() -> Column:
    return F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "^file:(//)?", "")


def visible(files: DataFrame) -> DataFrame:
    return files.where(~F.startswith(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(".")))


def refused_files(files: DataFrame, corpora: DataFrame) -> DataFrame:
    """Visible files of a corpus folder that become no document, with the reason."""
    owned = inbox_owner(rejected_files(visible(files)).withColumn("inbox_path", inbox_path()), corpora)
    return owned.select(REFUSED)


def broken_json(documents: DataFrame) -> DataFrame:
    """JSON files that do not parse: those without parts that are no empty list or object."""
    files = documents.where(F.col("extension") == ".json")
    parts = segment_json_elements(files).select("doc_id").distinct()
    bare = F.regexp_replace("text", r"\s", "").isin("[]", "{}")
    return files.where(~bare).join(parts, "doc_id", "left_anti")


def owned_documents(files: DataFrame, corpora: DataFrame) -> DataFrame:
    """Accepted files with the corpus of their folder and a stable document id."""
    owned = inbox_owner(scan_documents(visible(files)).withColumn("inbox_path", inbox_path()), corpora)
    name = F.concat_ws(":", F.lit("document"), "corpus_id", "content_hash")
    return owned.withColumn("doc_id", uuid5(PROPOSAL_NAMESPACE, name))


def parsed_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents, chunks)`` of new files: each format by its own segmentation.

    The stored text of a CSV or JSON file is its joined parts, so that chunk
    offsets point into it.
    """
    plain = documents.where(F.col("extension").isin(".md", ".txt"))
    columns = ["doc_id", "idx", "char_start", "char_end", "page", "text"]
    chunks = chunk_documents(plain, ["doc_id"]).select(columns)
    texts = plain.select("doc_id", "text")
    for suffix, split in ((".csv", segment_csv_rows), (".json", segment_json_elements)):
        parts = split(documents.where(F.col("extension") == suffix))
        chunks = chunks.unionByName(chunk_segments(parts, "doc_id").select(columns))
        texts = texts.unionByName(joined_text(parts, ["doc_id"], "seg", "\n\n"))
    stored = documents.drop("text").join(texts, "doc_id", "left")
    return stored.withColumn("text", F.coalesce("text", F.lit(""))).select(DOCUMENT), chunks


def stream_inbox(
    files: DataFrame, corpora: DataFrame, folder: str, compact_every: int = 16, **options
) -> StreamingQuery:
    """Ingest a stream of files into ``folder``/documents, /chunks, /runs and /rejects.

    Every accepted file starts one update run, also when its content was known:
    then the known document triggers it. Documents are stored once per corpus
    and content; ``folder``/contents holds the keys of all of them in buckets, of which a batch reads those
    of its own keys, and which are written together every ``compact_every`` batches. A file that cannot be read as a document is a row of
    /rejects with the reason, and starts no run.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # parsing, deduplication and run rows all read this table, not the batch again
        write_batch(owned_documents(batch, corpora), f"{folder}/arrived", number)
        arrived = read_batch(spark, f"{folder}/arrived", number)
        unparsed = broken_json(arrived).withColumn("reason", F.lit("content is not JSON")).select(REFUSED)
        write_batch(refused_files(batch, corpora).unionByName(unparsed), f"{folder}/rejects", number)
        refused = read_batch(spark, f"{folder}/rejects", number)
        found = arrived.join(refused.select("path"), "path", "left_anti")
        contents = KeyedLog(spark, f"{folder}/contents", CONTENT)
        if number and number % compact_every == 0:
            contents.compact(number - 1)
        stored = contents.rows(number, contents.buckets_of(found))
        fresh = dedupe(found, CONTENT, ["path"])
        if stored is not None:
            fresh = new_documents(fresh, stored)
        # chunks and texts of every format read this table; deduplication would run for each of them
        write_batch(fresh, f"{folder}/fresh", number)
        fresh = read_batch(spark, f"{folder}/fresh", number)
        runs = found.select(
            uuid5(
                PROPOSAL_NAMESPACE,
                F.concat_ws(":", F.lit("inbox"), "path", F.lit(str(number))),
            ).alias("run_id"),
            "corpus_id",
            F.lit("update").alias("kind"),
            F.lit("pending").alias("status"),
            F.col("doc_id").alias("triggering_document_id"),
        )
        documents, chunks = parsed_documents(fresh)
        write_batch(runs, f"{folder}/runs", number)
        write_batch(chunks, f"{folder}/chunks", number)
        write_batch(documents, f"{folder}/documents", number)
        contents.append(read_batch(spark, f"{folder}/documents", number).select(CONTENT), number)
        contents.commit(number)

    return start(files, handle, f"{folder}/_inbox_checkpoint", **options)
