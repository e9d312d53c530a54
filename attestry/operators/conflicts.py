"""Claims of one run that give one subject and predicate different objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.json import json_text
from attestry.functions.ids import PROPOSAL_NAMESPACE, uuid5

GROUP = ["run_id", "subject", "predicate"]

# Claims of one contested group that one join bucket holds. A larger group is
# spread over several buckets; a smaller one stays whole.
CLAIMS_PER_BUCKET = 2000


def group_sizes(claims: DataFrame) -> DataFrame:
    """Per run, subject and predicate: claims, and how many distinct objects they name.

    Claims are first combined per object, so a huge group reaches the second
    step as one row per object.
    """
    per_object = claims.groupBy(*GROUP, "object").agg(F.count("*").alias("_claims"))
    return per_object.groupBy(*GROUP).agg(
        F.sum("_claims").alias("claims"),
        F.count("*").alias("distinct_objects"),
        F.sum(F.col("_claims") * F.col("_claims")).alias("_squares"),
    )


def distinct_object_count(claims: DataFrame) -> DataFrame:
    """Every claim with the number of distinct objects of its group.

    An equi join instead of a window: the join can split a skewed group, a
    window cannot.
    """
    return claims.join(group_sizes(claims).select(*GROUP, "distinct_objects"), GROUP)


def contested_claims(claims: DataFrame) -> DataFrame:
    """The claims that take part in some conflict: the linear form of all pairs."""
    return distinct_object_count(claims).where(F.col("distinct_objects") > 1)


def conflict_counts(claims: DataFrame) -> DataFrame:
    """Conflicting pairs per run, counted from group sizes without building a pair."""
    pairs = F.expr("(claims * claims - _squares) div 2")
    return group_sizes(claims).groupBy("run_id").agg(F.sum(pairs).alias("conflicts"))


def detect_conflicts(claims: DataFrame) -> DataFrame:
    """Each unordered pair of claims that disagree, once, with ``claim_a_id < claim_b_id``.

    Pairs are the operator's result, so a large group costs what it yields; it
    must not cost one task. A group of n claims is cut into about n / 2000
    buckets: the first claim of a pair sits in one bucket, the second is sent
    to every bucket of its group. Groups that agree never reach the join.
    """
    sizes = (
        group_sizes(claims)
        .where(F.col("distinct_objects") > 1)
        .select(*GROUP, F.ceil(F.col("claims") / CLAIMS_PER_BUCKET).cast("int").alias("_buckets"))
    )
    contested = claims.select(*GROUP, "claim_id", "object").join(sizes, GROUP)
    left = contested.select(
        *GROUP,
        F.pmod(F.xxhash64("claim_id"), F.col("_buckets")).cast("int").alias("_bucket"),
        F.col("claim_id").alias("claim_a_id"),
        F.col("object").alias("object_a"),
    )
    right = contested.select(
        *GROUP,
        F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)).alias("_bucket"),
        F.col("claim_id").alias("claim_b_id"),
        F.col("object").alias("object_b"),
    )
    pairs = left.join(right, [*GROUP, "_bucket"]).where(
        (F.col("claim_a_id") < F.col("claim_b_id")) & (F.col("object_a") != F.col("object_b"))
    )
    name = F.concat_ws(
        ":", F.lit("conflict"), F.col("claim_a_id").cast("string"), F.col("claim_b_id").cast("string")
    )
    return pairs.select(
        uuid5(PROPOSAL_NAMESPACE, name).alias("conflict_id"),
        *GROUP,
        "claim_a_id",
        "claim_b_id",
        F.lit("unresolved").alias("resolution"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def conflict_events(conflicts: DataFrame) -> DataFrame:
    """One ``conflict_detected`` audit record per pair."""
    return conflicts.select(
        "run_id",
        F.lit("conflict_detected").alias("event_type"),
        json_text(
            F.struct(
                "conflict_id",
                "subject",
                "predicate",
                F.col("claim_a_id").cast("string").alias("claim_a_id"),
                F.col("claim_b_id").cast("string").alias("claim_b_id"),
            )
        ).alias("payload"),
    )
