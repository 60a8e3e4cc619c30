"""Eligibility of leads: eight ordered checks over joined facts, the first failing one decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^@+", "")


def eligibility(leads: DataFrame, logs: DataFrame, blacklist: DataFrame, campaign: str, as_of: str, aliases: tuple[str, ...] = (), failures: int = 3, risk: int = 75) -> DataFrame:
    """SC32: (id, eligibility, reason) of each lead for a campaign.

    ``leads``: id, contact, status, next_eligible_at, risk, about; ``logs``: lead_id, campaign_id,
    status; ``blacklist``: name. Names are compared without ``@`` and case. The logs are summed by
    lead, then by contact, before they are joined. Null names and unknown leads match nothing.
    """
    sent = F.count_if(F.col("status") == "sent")
    by_lead = logs.filter("lead_id is not null").groupBy("lead_id").agg(sent.alias("_sent"), F.count_if((F.col("status") == "sent") & (F.col("campaign_id") == campaign)).alias("_here"), F.count_if(F.col("status") == "failed").alias("_failed"))
    rows = leads.select("id", _bare(F.col("contact")).alias("_name"), F.col("status").alias("_status"), F.col("next_eligible_at").alias("_next"), F.col("risk").alias("_risk"), F.col("about").alias("_about"))
    joined = rows.join(by_lead, rows.id == by_lead.lead_id, "left").drop("lead_id")
    by_name = joined.filter("_name <> ''").dropDuplicates(["id", "_name"]).groupBy(F.col("_name").alias("_of")).agg(F.sum("_sent").alias("_all_sent"), F.sum("_failed").alias("_all_failed"))
    listed = blacklist.select(_bare(F.col("name")).alias("_bad")).filter("_bad <> ''").distinct()
    joined = joined.join(by_name, F.col("_name") == F.col("_of"), "left").join(listed, F.col("_name") == F.col("_bad"), "left")
    checks = (
        (F.col("_name") == "", "BLOCKED", "empty contact"),
        (F.col("_name").isin(*aliases, ""), "BLOCKED", "system name"),
        (F.col("_name").endswith("bot"), "BLOCKED", "bot"),
        (F.col("_bad").isNotNull(), "BLOCKED", "blacklisted"),
        (F.col("_status") == "rejected", "BLOCKED", "rejected"),
        (F.startswith(F.lower(F.trim("_about")), F.lit("inactive channel")), "BLOCKED", "inactive"),
        (F.col("_here") > 0, "CONTACTED", "in this campaign"),
        (F.col("_all_sent") > 0, "CONTACTED", "by another lead"),
        (F.col("_next") > F.lit(as_of).cast("timestamp_ntz"), "COOLDOWN", "cooling down"),
        (F.col("_all_failed") >= failures, "FAILED", "failure history"),
        (F.col("_risk") > risk, "RISKY", "risk"),
    )
    verdict = F.coalesce(*[F.when(test, F.struct(F.lit(v).alias("eligibility"), F.lit(r).alias("reason"))) for test, v, r in checks], F.struct(F.lit("ELIGIBLE").alias("eligibility"), F.lit("eligible").alias("reason")))
    return joined.select("id", verdict.alias("_v")).select("id", "_v.*")
