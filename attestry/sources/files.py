"""Reading document files: type dispatch, admission checks, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions and the type reported for each. Fixed values.
MIME_TYPES = {
    ".md": "text/markdown",
    ".txt": "text/plain",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".csv": "text/csv",
    ".json": "application/json",
}
TEXT_EXTENSIONS = [".md", ".txt", ".csv", ".json"]

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files of ``folder`` as ``(path, modificationTime, length, content)``.

    Spark's file scan leaves out files of length zero.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for dot-files."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)\A\.*[^.].*?(\.[^.]+)\z|\z", 1))


def file_kind(files: DataFrame) -> DataFrame:
    """Add ``filename``, ``extension`` and ``mime_type`` (null for an unknown extension)."""
    types = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    named = files.select(
        "*", base_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension")
    )
    return named.withColumn("mime_type", types[F.col("extension")])


def with_admission(files: DataFrame) -> DataFrame:
    """Add ``reason``: null when the file is accepted, else why it is not.

    The extension must be known and the content must fit it: text formats must
    be valid UTF-8 without NUL bytes and must not start like a PDF or a ZIP
    container; the two binary formats must start with their signature. Empty
    files pass.
    """
    kind = file_kind(files)
    start = F.hex(F.substring("content", 1, 5))
    pdf = start.startswith("255044462D")
    container = start.startswith("504B0304")
    empty = F.length("content") == 0
    texty = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(
        F.col("content"), F.unhex(F.lit("00"))
    )
    fits = (
        F.when(empty, F.lit(True))
        .when(F.col("extension").isin(TEXT_EXTENSIONS), texty & ~pdf & ~container)
        .when(F.col("extension") == ".pdf", pdf)
        .otherwise(container)
    )
    reason = F.when(F.col("mime_type").isNull(), F.lit("unsupported extension")).when(
        ~fits, F.lit("content does not match extension")
    )
    return kind.withColumn("reason", reason)


def split_admission(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejects keep their reason as a table of their own."""
    checked = with_admission(files)
    accepted = checked.where(F.col("reason").isNull()).drop("reason")
    rejected = checked.where(F.col("reason").isNotNull()).select("path", "filename", "extension", "reason")
    return accepted, rejected


def rejected_files(files: DataFrame) -> DataFrame:
    """Every file that ``scan_documents`` leaves out, with the reason."""
    accepted, rejected = split_admission(files)
    unread = accepted.where(~F.col("extension").isin(TEXT_EXTENSIONS)).select(
        *rejected.columns[:-1], F.lit("no text extraction for this type").alias("reason")
    )
    return rejected.unionByName(unread)


def scan_documents(files: DataFrame) -> DataFrame:
    """Text of every accepted text-format file, with ``content_hash``.

    Markdown and plain text are read with universal newlines; CSV and JSON keep
    their bytes, because their parsers deal with line ends themselves.
    """
    accepted, _ = split_admission(files)
    raw = F.col("content").cast("string")
    return accepted.where(F.col("extension").isin(TEXT_EXTENSIONS)).select(
        "path",
        "filename",
        "extension",
        "mime_type",
        content_hash(F.col("content")).alias("content_hash"),
        F.when(
            F.col("extension").isin(".md", ".txt"), F.regexp_replace(raw, r"\r\n?", "\n")
        )
        .otherwise(raw)
        .alias("text"),
    )


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, as lower-case hex."""
    return F.sha2(content, 256)
