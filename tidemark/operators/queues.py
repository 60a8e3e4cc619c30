"""Queue depths, seen-sets and provenance over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_worst(levels: DataFrame) -> DataFrame:
    """ST11: (queue, level) with the worst rank of all: 2 critical, 1 high, 0 normal. One row a queue, so few rows."""
    rank = F.when(F.col("level") == "CRITICAL", 2).when(F.col("level") == "HIGH", 1).otherwise(0)
    worst = levels.agg(F.max(rank)).first()[0]
    return levels.withColumn("worst", F.lit(worst).cast("int"))


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """SET4: the first row of each key that was not seen before; keys compare without case, null keys are none."""
    folded = F.lower(F.trim(F.col(key)))
    first = rows.filter(F.col(key).isNotNull()).withColumn("_key", folded).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    known = seen.select(folded.alias("_key")).distinct()
    return first.filter("_n = 1").join(known, "_key", "left_anti").drop("_key", "_n")


def left_preferred(first: DataFrame, second: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """SET1: rows of ``first``, then those of ``second`` whose key it lacks, ``k`` in all, with their place."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.join(first.select(key), key, "left_anti").withColumn("_side", F.lit(1)))
    return both.orderBy("_side", order, key).limit(k).drop("_side")


def provenance(found: DataFrame, key: str, source: str, ts: str) -> DataFrame:
    """ST9: (key, sources, n_sources, n, first_seen) of every key; null sources count as findings only."""
    grouped = found.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n"), F.min(ts).alias("first_seen"))
    return grouped.select(key, "sources", F.size("sources").alias("n_sources"), "n", "first_seen")


def appended(old: Column, value: Column) -> Column:
    """UPS6: the distinct values, then the new one; it may stand twice. ``array_union`` is the clean variant."""
    return F.concat(F.array_distinct(F.coalesce(old, F.array().cast("array<string>"))), F.array(value))


def expired(rows: DataFrame, until: str, as_of: str) -> DataFrame:
    """ST13: rows whose time is up; without a time they stay."""
    return rows.filter(F.col(until) <= F.lit(as_of).cast("timestamp_ntz"))


def last_of(logs: DataFrame, key: str, ts: str, order: str, columns: list[str]) -> DataFrame:
    """ST14: each key's last row, by time and then ``order``; one aggregation, no sort of a key's history."""
    last = F.max_by(F.struct(*columns), F.struct(ts, order)).alias("_last")
    return logs.filter(F.col(ts).isNotNull()).groupBy(key).agg(last).select(key, "_last.*")


def healthiest(accounts: DataFrame, states: list[str], health: str, state: str, cooldown: str, excluded: list, key: str, as_of: str) -> DataFrame:
    """TK12: the account of the best health among those in ``states``, not cooling down and not excluded."""
    free = F.col(cooldown).isNull() | (F.col(cooldown) <= F.lit(as_of).cast("timestamp_ntz"))
    kept = ~F.col(key).isin(*excluded) if excluded else F.lit(True)
    return accounts.filter(F.col(state).isin(*states) & free & kept).orderBy(F.desc(health), key).limit(1)


def preferred_session(sessions: DataFrame, key: str, score: str, limited: Column, preferred: Column, least: int = 30) -> DataFrame:
    """XT14: the preferred session if it is not limited and scores ``least`` or more, else the one of the highest score."""
    first = F.coalesce(preferred & ~limited & (F.col(score) >= least), F.lit(False))
    return sessions.orderBy(F.desc(first), F.desc(score), key).limit(1)
