"""Selections over job and channel tables: due channels, job states, stuck jobs and stale claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: job states that block a channel
OPEN = ("pending", "queued", "running")
CLASS_RANK = {"HOT": 1, "WARM": 2, "NORMAL": 3, "COLD": 4}


def _at(as_of: str, interval: str) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}' - interval {interval}")


def due(channels: DataFrame, jobs: DataFrame, as_of: str, batch: int) -> DataFrame:
    """SM3: channels whose crawl time has come and that have no open job of the last 30 minutes.

    ``channels`` (id, name, status, class, score, next_at), ``jobs`` (channel_id, channel_name, status,
    scheduled_at). A job fits by id or by name: two anti-joins on equality instead of one on "or".
    A null next time counts as due, a null status as rejected; ties go to the smaller id.
    """
    ready = channels.filter((F.col("status") != "rejected") & (F.col("next_at").isNull() | (F.col("next_at") <= F.expr(f"timestamp_ntz'{as_of}'"))))
    held = jobs.filter(F.col("status").isin(*OPEN) & (F.col("scheduled_at") > _at(as_of, "30 minutes")))
    ready = ready.join(held.select(F.col("channel_id").alias("id")), "id", "left_anti").join(held.select(F.col("channel_name").alias("name")), "name", "left_anti")
    rank = F.lit(5)
    for name, r in CLASS_RANK.items():
        rank = F.when(F.col("class") == name, r).otherwise(rank)
    return ready.orderBy(rank, F.desc_nulls_last("score"), "id").limit(batch).select(*channels.columns)


def job_states(log: DataFrame, order: list[str]) -> DataFrame:
    """SM4: each job's state is that of its last log row."""
    at = F.struct(*order)
    return log.groupBy("job_id").agg(F.max_by("status", at).alias("status"), F.count("*").alias("changes"), F.max(order[0]).alias("since"))


def stuck(jobs: DataFrame, as_of: str) -> DataFrame:
    """SM5: jobs of the last two hours that failed to be queued, or wait for more than two minutes."""
    waits = (F.col("status") == "pending") & (F.col("scheduled_at") < _at(as_of, "2 minutes"))
    return jobs.filter(((F.col("status") == "enqueue_failed") | waits) & (F.col("scheduled_at") > _at(as_of, "2 hours")))


def stale_running(jobs: DataFrame, as_of: str, started: str = "executed_at") -> DataFrame:
    """SM5: jobs that have been running for more than 30 minutes."""
    return jobs.filter((F.col("status") == "running") & (F.col(started) < _at(as_of, "30 minutes")))


def reconciled(claims: DataFrame, delivered: DataFrame, as_of: str, minutes: int, most: int) -> DataFrame:
    """SM7: what becomes of claims in work for too long: sent if delivered, else pending again or failed."""
    stale = claims.filter((F.col("status") == "processing") & (F.col("last_attempt_at") < _at(as_of, f"{minutes} minutes")))
    mark = delivered.select("campaign_id", "lead_id").distinct().withColumn("_sent", F.lit(True))
    out = stale.join(mark, ["campaign_id", "lead_id"], "left")
    return out.withColumn("status", F.when(F.col("_sent"), "sent").when(F.col("attempt_count") < most, "pending").otherwise("failed")).drop("_sent")


def least_loaded(accounts: DataFrame) -> DataFrame:
    """TK13: the account of least load: (name, active, errors, idle, recovering), ties by name."""
    load = 100 * F.col("active") + 20 * F.col("errors") - F.least(F.lit(50), F.col("idle")) + F.when(F.col("recovering"), 50).otherwise(0)
    return accounts.withColumn("load", load).orderBy("load", "name").limit(1)


def queue_of(score: Column) -> Column:
    """SM10: queue by score."""
    return F.when(score > 80, "critical").when(score > 60, "high").when(score > 40, "normal").otherwise("low")


def queue_of_risk(risk: Column) -> Column:
    """SM10: queue by a job's risk; what is neither low nor medium, and a null, waits longest."""
    return F.when(risk == "LOW", "high").when(risk == "MEDIUM", "normal").otherwise("low")


def queue_of_seed(source: Column, trusted: tuple[str, ...]) -> Column:
    """SM10: queue of a seed: high for sources of ``trusted`` (in lower case), else normal."""
    return F.when(F.lower(source).isin(*trusted), "high").otherwise("normal")


def delay_band(health: Column) -> Column:
    """XT15: band of delays by health."""
    return F.when(health >= 80, "short").when(health >= 50, "medium").when(health >= 30, "long").otherwise("longest")
