"""Merge policies for incremental loads: base and delta frames in, one frame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(base: DataFrame, delta: DataFrame, key: str, policies: dict[str, str]) -> DataFrame:
    """UPS1-UPS4: full-outer merge; a column is ``replace``d, ``coalesce``d, kept as ``first``, its ``max`` or ``sum``."""
    b, d = base.alias("b"), delta.alias("d")
    pick = {
        "replace": lambda x, y: F.when(F.col(f"d.{key}").isNotNull(), y).otherwise(x),
        "coalesce": lambda x, y: F.coalesce(y, x),
        "first": lambda x, y: F.coalesce(x, y),
        "max": F.greatest,
        "sum": lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)),
    }
    cols = [pick[p](F.col(f"b.{c}"), F.col(f"d.{c}")).alias(c) for c, p in policies.items()]
    return b.join(d, F.col(f"b.{key}") == F.col(f"d.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"d.{key}").alias(key), *cols)


def insert_or_ignore(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """SNK1: rows of the delta whose key the base lacks, each once, appended."""
    return base.unionByName(delta.dropDuplicates(key).join(base, key, "left_anti"))


def edge_upsert(events: DataFrame, key: list[str], ts: str, confidence: str, evidence: str, order: str) -> DataFrame:
    """UPS5, GR1: occurrences, confidence min(100, first + 5 a repeat), latest non-empty evidence."""
    at = F.struct(ts, order)
    return events.groupBy(*key).agg(
        F.count("*").alias("occurrences"),
        F.least(F.lit(100), F.min_by(confidence, at) + 5 * (F.count("*") - 1)).cast("long").alias("confidence"),
        F.max_by(evidence, F.when(F.coalesce(F.col(evidence), F.lit("")) != "", at)).alias("evidence"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )
