"""The register as a CSV file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that come first, in this order. Fixed values.
PREFERRED = ["name", "owner", "target_release", "status", "open_risks"]


def field_order(fields: T.StructType) -> list[str]:
    names = fields.fieldNames()
    return [n for n in PREFERRED if n in names] + sorted(n for n in names if n not in PREFERRED)


def flat_text(value: Column, kind: T.DataType) -> Column:
    """Text of a field: nothing for null, ``; `` between list items, JSON for objects."""
    if isinstance(kind, T.ArrayType):
        text = F.array_join(value.cast("array<string>"), "; ", "null")
    elif isinstance(kind, (T.StructType, T.MapType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def csv_cell(value: Column) -> Column:
    """Quoted only when it holds a quote, a comma or a line feed."""
    doubled = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(value, F.lit('[",\n]')), doubled).otherwise(value)


def register_export_csv(entries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One CSV line per entry, plus the ``keep`` columns."""
    fields = entries.schema["fields"].dataType
    cells = [
        csv_cell(flat_text(F.col(f"fields.{name}"), fields[name].dataType)) for name in field_order(fields)
    ]
    line = F.concat_ws(",", csv_cell(F.col("feature_key")), *cells)
    return entries.select(*keep, "feature_key", line.alias("line"))


def csv_header(entries: DataFrame) -> str:
    return ",".join(["feature_key", *field_order(entries.schema["fields"].dataType)])


def write_register_csv(entries: DataFrame, path: str) -> None:
    """Write the export with CRLF line ends.

    The lines are those of ``register_export_csv``, in order of the key. Part files in order of their names are
    the file: the header is the first line of the first one only.
    """
    header = entries.sparkSession.range(1).select(
        F.lit(0).alias("_part"), F.lit("").alias("feature_key"), F.lit(csv_header(entries)).alias("line")
    )
    lines = register_export_csv(entries).select(F.lit(1).alias("_part"), "feature_key", "line")
    (
        header.unionByName(lines)
        .orderBy("_part", "feature_key")
        .select("line")
        .write.mode("overwrite")
        .option("lineSep", "\r\n")
        .text(path)
    )
