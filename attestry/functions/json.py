"""JSON texts of structs and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """JSON with absent values written as null, so every record has all its keys."""
    return F.to_json(value, {"ignoreNullFields": "false"})
