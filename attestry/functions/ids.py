"""Stable identifiers derived from content, never from randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of proposal ids. Fixed value.
PROPOSAL_NAMESPACE = "8f2f6b1a-2c3d-4e5f-9a1b-6c7d8e9f0a1b"


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version-5 UUID text of ``name`` in ``namespace``."""
    raw = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(raw, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def proposal_id(run_id: Column, feature_key: Column, field: Column | None = None) -> Column:
    """Id of a proposed addition, or of a proposed change of one field."""
    parts = [run_id.cast("string"), F.lit(":"), feature_key]
    if field is not None:
        parts += [F.lit(":"), field]
    return uuid5(PROPOSAL_NAMESPACE, F.concat(*parts))
