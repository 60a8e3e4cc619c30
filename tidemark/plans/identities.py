"""Registered queries of vertices under several names and of edges between platforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.plans.catalog import c, events, query

# each event is a found row: some have an id, some a name, some both, so that chains of names arise within a user and beyond
_FOUND = """with recursive g as (select event_id, ts, value, user_id, case when event_id % 5 < 3 then 'u' || user_id || '-' || event_id % 7 end cid,
        case when event_id % 5 > 1 then case when event_id % 2 = 0 then ' N' else 'n' end || user_id % 40 || '_' || event_id % 11 end nm, case event_type when 'error' then 'X' when 'view' then 'tele' when 'click' then 'Tele' else 'insta' end pf from events),
    r as (select *, 'c:' || cid by_id, 'n:' || lower(pf) || ':' || lower(trim(nm)) by_name from g),
    e as (select distinct coalesce(by_id, by_name) a, coalesce(by_name, by_id) b from r), l as (select a, b from e union select b, a from e),
    w(v, k) as (select a, a from l union select l.b, w.k from w join l on l.a = w.v), comp as (select v node, min(k) vertex from w group by 1),
    m as (select r.*, vertex from r join comp on node = coalesce(by_id, by_name))"""


def _found(s, d):
    i, u = c("event_id"), c("user_id")
    return events(s, d).select(
        "event_id", "ts", "value", "user_id", F.when(i % 5 < 3, F.concat(F.lit("u"), u, F.lit("-"), i % 7)).alias("cid"),
        F.when(i % 5 > 1, F.concat(F.when(i % 2 == 0, " N").otherwise("n"), u % 40, F.lit("_"), i % 11)).alias("nm"),
        F.when(c("event_type") == "error", "X").when(c("event_type") == "view", "tele").when(c("event_type") == "click", "Tele").otherwise("insta").alias("pf"),
    )


@query(f"""{_FOUND} select vertex, arg_min(trim(cid), (ts, event_id)) filter (cid is not null) canonical, arg_min(trim(nm), (ts, event_id)) filter (nm is not null) "name",
    arg_min(pf, (ts, event_id)) filter (nm is not null) platform, count(*) n_rows, min(ts) first_seen from m group by 1""")
def gr8_identities(s, d):
    return identity.resolve(_found(s, d), "event_id", "cid", "nm", "pf", "ts")


@query(f"""{_FOUND}, p as (select vertex, arg_min(lower(pf), event_id) filter (nm is not null) platform from m group by 1),
    k as (select a.vertex source, b.vertex target, a.ts, (a.value)::int confidence, a.event_id s, b.event_id t from m a join m b on b.event_id = a.event_id + 1 where a.vertex <> b.vertex),
    o as (select source, target, count(*) occurrences, arg_min(confidence, (ts, s, t)) first, max(ts) last_seen from k group by all)
    select source, target, x.platform source_platform, y.platform target_platform, coalesce(x.platform <> y.platform, false) "cross", occurrences, least(100, first + 5 * (occurrences - 1))::bigint confidence, last_seen
    from o join p x on x.vertex = source join p y on y.vertex = target""")
def gr9_cross_edges(s, d):
    found = _found(s, d)
    links = found.select(c("event_id").alias("src"), (c("event_id") + 1).alias("dst"), c("ts").alias("at"), F.rint("value").cast("int").alias("trust"))
    return identity.cross_edges(found, links, "event_id", "cid", "nm", "pf", "src", "dst", "at", "trust")
