"""Registered queries of running values and pointers along an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.plans.catalog import c, events, query


def _passes(key: str, ttl: str) -> str:
    return f"""with recursive e as (select {key} k, ts, min(event_id) event_id from events group by all), r(k, ts) as (select k, min(ts) from e group by 1
        union all select k, nxt from (select r.k, (select min(e.ts) from e where e.k = r.k and e.ts >= r.ts + interval {ttl}) nxt from r) where nxt is not null)
        select e.event_id from r join e using (k, ts)"""


@query(_passes("user_id", "1 day"))
def set5_ttl(s, d):
    return ordered.ttl_dedup(events(s, d), "user_id", "ts", "event_id", 86400).select("event_id")


@query(_passes("event_type", "1 hour"))
def set5_few_keys(s, d):
    return ordered.ttl_dedup(events(s, d), "event_type", "ts", "event_id", 3600).select("event_id")


@query("""with recursive e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) i, count(*) filter (event_type in ('click', 'view', 'purchase')) over w ok,
        count(*) filter (event_type = 'error') over w bad, count(*) filter (event_type = 'signup' and value > 80) over w floods from events window w as (partition by user_id, ts::date order by ts, event_id)),
    r as (select user_id, 0::bigint i, null::bigint event_id, 120.0::double delay from (select distinct user_id from e)
    union all select e.user_id, e.i, e.event_id, greatest(60.0, least(600.0, case when floods > 0 then greatest(delay * 2, 300) when ok / greatest(ok + bad, 1) >= 0.95 then delay * 0.9
        when ok / greatest(ok + bad, 1) >= 0.8 then delay * 0.95 when ok / greatest(ok + bad, 1) >= 0.5 then delay * 1.1 else delay * 1.5 end))::double
    from r join e on e.user_id = r.user_id and e.i = r.i + 1)
    select event_id, round(delay, 6) delay from r where i > 0""")
def ma4_delays(s, d):
    kind = c("event_type")
    rows = events(s, d).select("user_id", "ts", "event_id", F.to_date("ts").alias("day"), kind.isin("click", "view", "purchase").cast("int").alias("is_ok"),
        (kind == "error").cast("int").alias("is_bad"), ((kind == "signup") & (c("value") > 80)).cast("int").alias("is_flood"))
    told = ordered.running_sums(ordered.deal(rows, ["user_id", "day"], ["ts", "event_id"]), ["user_id", "day"], {"ok": "is_ok", "bad": "is_bad", "floods": "is_flood"})
    told = told.select("user_id", "ts", "event_id", "ok", "bad", "floods")
    return ordered.throttle_delays(told, "user_id", ["ts", "event_id"], c("ok"), c("bad"), c("floods")).select("event_id", F.round("delay", 6).alias("delay"))
