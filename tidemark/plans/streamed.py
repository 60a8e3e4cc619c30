"""Registered queries over streams: each drains the events into a Parquet table and reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import messages  # noqa: F401  has the oracle of connector health
from tidemark.plans.catalog import ORACLES, c, query
from tidemark.sources.io import scratch
from tidemark.streaming import folds, streams

DAY = 86400


def _drained(s, d, job, shape=lambda e: e):
    found = folds.run_folds(s, lambda own: shape(streams.events(own, d)), job, "user_id", "ts", scratch(s, "stream"))
    return found.drop("expired")


@query(ORACLES["st6_rate_limiter"])
def st6_stream(s, d):
    return _drained(s, d, folds.rate_limiter("event_id", DAY, 3))


@query(ORACLES["st7_breaker"])
def st7_stream(s, d):
    return _drained(s, d, folds.fixed_window_trips("event_id", 7 * DAY, 3, 2 * DAY), lambda e: e.filter("event_type = 'error'"))


@query(ORACLES["sm6_health"])
def sm6_stream(s, d):
    kind = F.when(c("event_type") == "error", "error").when(c("event_type") == "signup", "flood").when((c("event_type") == "view") & (c("value") > 99), "auth").otherwise("success")
    return _drained(s, d, folds.health_machine("event_id", "kind", "secs"), lambda e: e.withColumn("kind", kind).withColumn("secs", F.rint(c("value") * 1.5).cast("int")))


@query(ORACLES["sm9_connectors"])
def sm9_stream(s, d):
    kind = F.when(c("event_type") == "purchase", "success").when(c("event_type") == "error", "rate_limit").otherwise("failure")
    return _drained(s, d, folds.connector_health("event_id", "kind"), lambda e: e.withColumn("kind", kind))


@query("""with p as (select event_id, ts, case event_id % 9 when 0 then null when 1 then 'plain' when 2 then '[1]' when 3 then '{"k": "x"}' when 4 then '{"k": 1' else props end p from events),
    r as (select *, case when p is null then 'missing' when event_id % 9 in (1, 4) then 'no JSON' when event_id % 9 = 2 then 'no object' when event_id % 9 = 3 then 'does not fit the schema' end reason from p)
    select 'events' source, reason, p payload, length(p)::int length, sha256(p) digest, ts seen_at from r where reason is not null""")
def snk7_dead_letters(s, d):
    i = c("event_id") % 9
    payload = F.when(i == 0, None).when(i == 1, "plain").when(i == 2, "[1]").when(i == 3, '{"k": "x"}').when(i == 4, '{"k": 1').otherwise(c("props"))
    folder = scratch(s, "letters")
    rows = streams.events(s, d).select("event_id", "ts", payload.alias("payload"))
    counts = streams.split_dead_letters(rows, "payload", "k int", "events", "ts", folder)
    dead = s.read.parquet(f"{folder}/dead").drop("batch")
    return dead.withColumn("seen_at", c("seen_at").cast("timestamp_ntz")).filter(F.lit(counts["good"] + counts["dead"] == counts["all"]))
