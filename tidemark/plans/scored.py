"""Further registered queries: joins, merges, scorecards, schedules and reports, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import graph, merge, schedule, views
from tidemark.sources.io import edges, leads, table

from .catalog import AS_OF, EDGES, LEADS, customer, documents, events, lineitem, orders, query

c = F.col

_USERS = f"""u as (select user_id, count(*) m, count(*) filter (ts >= timestamp '{AS_OF}' - interval 24 hour) d, count(*) filter (ts >= timestamp '{AS_OF}' - interval 7 day) w,
    count(*) filter (event_type = 'click') k, count(*) filter (event_type = 'error') e, count(*) filter (event_type = 'purchase') p, count(*) filter (event_type = 'signup') s, count(*) filter (event_type = 'view') v,
    (epoch_us(timestamp '{AS_OF}') - epoch_us(max(ts))) / 3.6e9 h from events group by 1)"""


def users(s, d):
    """One row a user: event counts by kind and age, and hours since the last event."""
    n = lambda t: F.count_if(c("event_type") == t)
    hours = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 3.6e9
    return events(s, d).groupBy("user_id").agg(
        F.count("*").alias("m"), F.count_if(views.since("ts", AS_OF, "24 hours")).alias("d"), F.count_if(views.since("ts", AS_OF, "7 days")).alias("w"),
        n("click").alias("k"), n("error").alias("e"), n("purchase").alias("p"), n("signup").alias("s"), n("view").alias("v"), hours.alias("h"),
    )


_DAYS = f"""u as (select user_id * 100 + day(ts) user_id, count(*) m, count(*) filter (hour(ts) < 12) d, count(*) filter (value > 30) w,
    count(*) filter (event_type = 'click') k, count(*) filter (event_type = 'error') e, count(*) filter (event_type = 'purchase') p, count(*) filter (event_type = 'signup') s, count(*) filter (event_type = 'view') v,
    (epoch_us(timestamp '{AS_OF}') - epoch_us(max(ts))) / 3.6e9 h from events group by 1)"""


def user_days(s, d):
    """The same counts for each user and day of the month, which lie around the scorecards' bounds."""
    n = lambda t: F.count_if(c("event_type") == t)
    hours = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 3.6e9
    return events(s, d).groupBy((c("user_id") * 100 + F.day("ts")).alias("user_id")).agg(
        F.count("*").alias("m"), F.count_if(F.hour("ts") < 12).alias("d"), F.count_if(c("value") > 30).alias("w"),
        n("click").alias("k"), n("error").alias("e"), n("purchase").alias("p"), n("signup").alias("s"), n("view").alias("v"), hours.alias("h"),
    )


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def jn1_inner(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return customer(s, d).join(n, c("c_nationkey") == c("n_nationkey")).join(r, c("n_regionkey") == c("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("select c_custkey, o_orderkey, o_orderstatus from customer left join orders on o_custkey = c_custkey")
def jn2_left_fanout(s, d):
    return customer(s, d).select("c_custkey").join(orders(s, d), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query(f"{EDGES} select a.c_name source_name, s_name target_name, relation, seq from edges join customer a on a.c_custkey = source join supplier on s_suppkey = target")
def jn3_edge_names(s, d):
    a, b = customer(s, d).select("c_custkey", c("c_name").alias("source_name")), table(s, d, "supplier", ["s_suppkey", "s_name"])
    return edges(s, d).join(a, c("source") == c("c_custkey")).join(b, c("target") == c("s_suppkey")).select("source_name", c("s_name").alias("target_name"), "relation", "seq")


@query("select c_custkey, (select count(*) from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c_custkey and l_returnflag = 'R') returned from customer")
def jn9_correlated_join(s, d):
    r = lineitem(s, d).filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = orders(s, d).join(r, c("o_orderkey") == c("l_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n"))
    return customer(s, d).select("c_custkey").join(n, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("returned"))


@query(f"{LEADS} select id, coalesce(top, lead_score)::bigint lead_score from leads left join (select o_custkey, floor(max(o_totalprice))::bigint top from orders where o_orderstatus = 'P' group by 1) on o_custkey = id")
def jn10_update_from(s, d):
    new = orders(s, d).filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.floor(F.max("o_totalprice")).alias("top"))
    return leads(s, d).join(new, c("id") == c("o_custkey"), "left").select("id", F.coalesce("top", "lead_score").cast("long").alias("lead_score"))


@query("select l_orderkey, min(l_linenumber) l_linenumber from lineitem group by 1")
def jn11_keep_smallest(s, d):
    return views.top_per_group(lineitem(s, d).select("l_orderkey", "l_linenumber"), ["l_orderkey"], [c("l_linenumber")], 1).drop("rank")


@query("select o_orderkey from orders where o_orderpriority not ilike '%low%' and o_orderstatus in ('O', 'P') and o_totalprice between 1000 and 90000")
def flt2_window(s, d):
    keep = views.conjunction([~c("o_orderpriority").ilike("%low%"), c("o_orderstatus").isin("O", "P"), c("o_totalprice").between(1000, 90000)])
    return orders(s, d).filter(keep).select("o_orderkey")


_WINDOW = f"""with l as (select o_orderkey id, case when o_orderkey % 17 = 0 then 'a-b' || o_orderkey when o_orderkey % 13 = 0 then 'abc' else 'chan_' || o_orderkey end "name", o_orderdate seen, case o_orderkey % 19 when 0 then 'user_account' when 1 then 'other' end reason,
    case o_orderkey % 23 when 0 then 'user' when 1 then 'channel' end entity, (o_orderkey % 3)::int members, case when o_orderkey % 5 > 0 then (o_orderkey % 21)::int end score, case o_orderkey % 4 when 0 then '' when 1 then o_orderpriority end about, case o_orderstatus when 'P' then 'rejected' else 'new' end status,
    case when o_custkey % 3 = 0 then 'A' when o_custkey % 3 = 1 then 'B' end tier, case o_custkey % 7 when 0 then '' when 1 then 'HighRoller' when 2 then 'bob' end contact, case when o_custkey % 11 = 0 then '+1' end phone from orders),
    b as (select *, seen >= timestamp '2001-08-01' - interval 400 day and (reason is null or reason <> 'user_account') and (entity is null or entity <> 'user') and regexp_full_match("name", '[a-zA-Z0-9_]{{4,32}}') base,
        "name" ilike '%igh%' or about ilike '%igh%' or contact ilike '%igh%' found from l)
    select 'verified' mode, id from b where base and (members > 0 or score >= 10 or (about is not null and about <> '')) union all select 'new', id from b where base and status = 'new' and (score >= 10 or tier is not null) and found
    union all select 'rejected', id from b where base and status = 'rejected' and tier = 'A' union all select 'with_contact', id from b where (base and contact is not null and contact <> '') or (phone is not null and phone <> '' and tier = 'B' and found)
    union all select 'pending_scan', id from b where base and status = 'new' and score is null and tier is null union all select 'all', id from b where base and tier = 'B' and found"""


@query(_WINDOW)
def flt2_modes(s, d):
    """All modes of the window view, with tier and search where the view allows them."""
    k, n = c("o_orderkey"), c("o_custkey")
    rows = orders(s, d).select(
        k.alias("id"), F.when(k % 17 == 0, F.concat(F.lit("a-b"), k)).when(k % 13 == 0, F.lit("abc")).otherwise(F.concat(F.lit("chan_"), k)).alias("channel_username"), c("o_orderdate").alias("discovered_at"),
        F.when(k % 19 == 0, "user_account").when(k % 19 == 1, "other").alias("outreach_priority_reason"), F.when(k % 23 == 0, "user").when(k % 23 == 1, "channel").alias("entity_type"), (k % 3).cast("int").alias("member_count"),
        F.when(k % 5 > 0, (k % 21).cast("int")).alias("lead_score"), F.when(k % 4 == 0, "").when(k % 4 == 1, c("o_orderpriority")).alias("description"), F.when(c("o_orderstatus") == "P", "rejected").otherwise("new").alias("status"),
        F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").alias("tier"), F.when(n % 7 == 0, "").when(n % 7 == 1, "HighRoller").when(n % 7 == 2, "bob").alias("contact_username"), F.when(n % 11 == 0, "+1").alias("whatsapp"),
    )
    asked = {"verified": (None, None), "new": (None, " igh "), "rejected": ("A", ""), "with_contact": ("B", "igh"), "pending_scan": ("all", None), "all": ("B", "IGH")}
    modes = F.array_compact(F.array(*[F.when(views.lead_window("2001-08-01 00:00:00", m, tier, search, "400 days"), F.lit(m)) for m, (tier, search) in asked.items()]))
    return rows.select(F.explode(modes).alias("mode"), "id")


@query(f"{LEADS} select id from leads where segment = 'BUILDING' and lead_score >= 50 or tier = 'P0'")
def flt3_precedence(s, d):
    return leads(s, d).filter("segment = 'BUILDING' and lead_score >= 50 or tier = 'P0'").select("id")


@query("select c_custkey from customer where regexp_full_match(c_name, '[a-zA-Z0-9_#]{4,32}') and not regexp_matches(c_mktsegment, 'auto', 'i')")
def flt4_regex(s, d):
    return customer(s, d).filter(c("c_name").rlike("^[a-zA-Z0-9_#]{4,32}$") & ~c("c_mktsegment").rlike("(?i)auto")).select("c_custkey")


@query(f"{LEADS} select id, case when lead_score is null then 1 when lead_score > 80 then 24 when lead_score > 60 then 72 when lead_score > 40 then 168 else 720 end \"hours\" from leads")
def flt10_cooldown(s, d):
    v = c("lead_score")
    return leads(s, d).select("id", F.when(v.isNull(), 1).when(v > 80, 24).when(v > 60, 72).when(v > 40, 168).otherwise(720).alias("hours"))


@query(f"{EDGES} select source, target, relation, seq from edges order by ts desc, seq limit 15")
def tk8_recent_edges(s, d):
    return views.top_k(edges(s, d), [F.desc("ts"), c("seq")], 15).select("source", "target", "relation", "seq")


@query(f"{LEADS} select id, tier, lead_score from leads order by case tier when 'P0' then 0 when 'P1' then 1 when 'P2' then 2 else 9 end, lead_score desc nulls last, id limit 50")
def tk14_recipients(s, d):
    rank = F.when(c("tier") == "P0", 0).when(c("tier") == "P1", 1).when(c("tier") == "P2", 2).otherwise(9)
    return views.top_k(leads(s, d), [rank, F.desc_nulls_last("lead_score"), c("id")], 50).select("id", "tier", "lead_score")


@query("select l_suppkey k, count(*) total, count(*) filter (l_quantity >= 40) hq, round(count(*) filter (l_quantity >= 40) * 100.0 / count(*))::int quality, least(100, 10 + round(count(*) filter (l_quantity >= 40) * 100.0 / count(*))::int) boosted from lineitem group by 1")
def ups4_additive(s, d):
    q = F.round(c("hq") * 100.0 / c("total")).cast("int")
    y = lineitem(s, d).groupBy(c("l_suppkey").alias("k")).agg(F.count("*").alias("total"), F.count_if(c("l_quantity") >= 40).alias("hq"))
    return y.withColumn("quality", q).withColumn("boosted", F.least(F.lit(100), 10 + c("quality")))


@query("with h as (select o_custkey, o_orderdate >= timestamp '1998-01-01' late, max(o_totalprice) t, min(o_orderpriority) pr from orders group by all), b as (select * from h where not late), e as (select * from h where late) select coalesce(b.o_custkey, e.o_custkey) o_custkey, case when e.o_custkey is not null then e.t else b.t end top, coalesce(b.pr, e.pr) pr from b full join e on b.o_custkey = e.o_custkey")
def ups1_replace_first(s, d):
    cut = F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    half = lambda x: orders(s, d).filter(x).groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.min("o_orderpriority").alias("pr"))
    return merge.merge(half(c("o_orderdate") < cut), half(c("o_orderdate") >= cut), "o_custkey", {"top": "replace", "pr": "first"})


@query("select o_orderkey, date_trunc('hour', o_orderdate) \"hour\", floor((epoch_us(timestamp '2002-01-01') - epoch_us(o_orderdate)) / 8.64e10)::bigint age_days, greatest(0, (epoch_us(timestamp '1999-01-01') - epoch_us(o_orderdate)) / 3.6e9) age_hours from orders")
def dt2_ages(s, d):
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    age = lambda day, unit: (us(F.lit(day)) - us(c("o_orderdate"))) / unit
    return orders(s, d).select("o_orderkey", F.date_trunc("hour", "o_orderdate").alias("hour"), F.floor(age("2002-01-01", 8.64e10)).alias("age_days"), F.greatest(F.lit(0.0), age("1999-01-01", 3.6e9)).alias("age_hours"))


@query(f"""with {_DAYS}, x as (select *, user_id % 3 = 0 bio, user_id % 5 = 0 core, user_id % 2 = 0 targets from u)
    select user_id, case when k + v = 1 and e <= 1 and not bio and m >= 5 then 15 else least(100, case when bio then least(60, least(60, k * 12 + v * 10) + 15) else least(60, k * 12 + v * 10) end + least(40, trunc(e / m * 60)::int)) end topic,
    least(100, case when core then greatest(30, p * 18) else p * 18 end + trunc(e / m * 50)::int) gold, least(100, s * 15 + k * 18) method_points, least(100, p * 15 + case when targets then 25 else 0 end + trunc(s / m * 50)::int) signal from x""")
def sc1_topic(s, d):
    bio, core, targets = (c("user_id") % n == 0 for n in (3, 5, 2))
    return user_days(s, d).select("user_id", S.topic_score(c("k"), c("v"), c("e"), c("m"), bio).alias("topic"), S.gold_score(c("p"), c("e"), c("m"), core).alias("gold"), S.method_score(c("s"), c("k")).alias("method_points"), S.signal_score(c("p"), c("s"), c("m"), targets).alias("signal"))


@query(f"with {_DAYS} select user_id, least(100, 20 + case when m * 2 >= 10 then 25 when m * 2 >= 3 then 15 else 0 end + case when e >= 3 then 25 when e >= 1 then 15 else 0 end + case when user_id % 3 = 0 then 15 else 0 end + case when k >= 2 then 15 else 0 end) confidence, greatest(0, 100 - 35 * s) legitimacy from u")
def sc11_confidence(s, d):
    return user_days(s, d).select("user_id", S.confidence_score(c("m") * 2, c("e"), c("user_id") % 3 == 0, c("k")).alias("confidence"), S.legitimacy_score(c("s")).alias("legitimacy"))


@query(f"with {_USERS}, x as (select *, trunc((least(100, k * 9) * 0.28 + least(100, e * 8) * 0.14 + least(100, p * 7) * 0.14 + least(100, s * 6) * 0.10 + 0.0 + 0.0 + 0.0 + 0.0 + 0.0 + 0.0 + 0.0 + least(100, v * 5) * 0.08) * (greatest(0, 100 - 35 * (d % 3)) / 100.0))::int f from u) select user_id, case when k > 2 then f else least(15, f) end final from x")
def sc13_composite(s, d):
    part = lambda name, by: F.least(F.lit(100), c(name) * by)
    zero = {name: F.lit(0) for name in S.WEIGHTS}
    parts = zero | {"topic": part("k", 9), "gold": part("e", 8), "signal": part("p", 7), "method": part("s", 6), "new_channel": part("v", 5)}
    return users(s, d).select("user_id", S.composite(parts, S.legitimacy_score(c("d") % 3), c("k") > 2).alias("final"))


@query(f"with {_USERS} select user_id, least(100, greatest(0, trunc((k * 1.0 + v * 1.5 + p * 2.0) / m * 70 + e / m * 20)::int + case when user_id > 100 then 10 when user_id > 60 then 7 when user_id > 20 then 4 else 0 end)) score from u")
def sc24_marketplace(s, d):
    return users(s, d).select("user_id", S.marketplace_score(c("k"), c("v"), c("p"), c("e"), c("m"), F.when(c("user_id") > 100, 60000).when(c("user_id") > 60, 30000).when(c("user_id") > 20, 6000).otherwise(5000)).alias("score"))


@query(f"with {_USERS}, q as (select user_id, case when k > 0 then least(100, 40 + k * 10) else 20 end t, user_id * 150 n from u) select user_id, t topic, least(100, greatest(10, trunc(t * 0.7 + least(30, trunc(n / 1000)))::int)) lead, case when n >= 15000 and t >= 80 then 'A' when n >= 2500 and t >= 60 then 'B' when n >= 500 and t >= 40 then 'C' else 'D' end tier from q")
def sc25_quick(s, d):
    return users(s, d).select("user_id", S.quick_scores(c("k"), c("user_id") * 150).alias("q")).select("user_id", "q.*")


@query(f"with {_USERS}, x as (select *, least(15, greatest(0, trunc(least(100, e * 10) * 0.15)::int)) t from u), y as (select *, least(100, least(35, k * 3) + least(20, v * 2) + least(15, p) + t + case when m >= 10000 then 3 when m >= 1000 then 2 when m >= 100 then 1 else 0 end + least(5, d) + least(5, s)) g from x) select user_id, g score, case when g >= 70 and p >= 1 and least(5, s) >= 3 and t >= 3 then 'P0' when g >= 55 and (p >= 1 or least(35, k * 3) >= 18) and t >= 3 then 'P1' when g >= 38 and (p >= 1 or least(35, k * 3) >= 10 or t >= 8) then 'P2' when g >= 18 or t >= 8 then 'P3' else 'P4' end tier from y")
def sc30_priority(s, d):
    cap = lambda name, by, most: F.least(F.lit(most), c(name) * by)
    got = S.priority(cap("k", 3, 35), cap("v", 2, 20), cap("p", 1, 15), cap("d", 1, 5), cap("e", 10, 100), c("m"), cap("s", 1, 5), c("p"))
    return users(s, d).select("user_id", got.alias("x")).select("user_id", "x.*")


@query(f"with {_USERS}, x as (select user_id, least(100, case when 100 - 8 * e < 50 then 30 when 100 - 8 * e < 70 then 15 else 0 end + case when d >= 3 then 30 when d >= 1 then 15 else 0 end + case when e / m >= 0.3 then 25 when e / m >= 0.1 then 10 else 0 end + case when k * 7 < 25 then 20 when k * 7 < 50 then 10 when k * 7 < 75 then 5 else 0 end + case when s >= 3 then 20 when s >= 1 then 10 else 0 end) risk from u) select *, case when risk >= 75 then 'critical' when risk >= 50 then 'high' when risk >= 25 then 'medium' else 'low' end as \"level\" from x")
def sc31_risk(s, d):
    return users(s, d).select("user_id", S.risk(100 - 8 * c("e"), c("d"), c("e"), c("m"), c("k") * 7, c("s")).alias("x")).select("user_id", "x.*")


@query(f"""with a as (select event_id, event_id * 37 % 101 final, event_id * 53 % 101 topic, user_id % 97 activity, event_id * 29 % 101 fresh, event_id * 41 % 97 growth, event_id * 13 % 53 fledgling, event_id * 17 % 89 central, event_id % 5 failures, event_id % 8 d, event_id % 37 w, event_id % 3 m,
        case when event_id % 11 > 0 then (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 1.8e9 end h, event_id % 4 = 0 marked from events),
    b as (select *, coalesce(h / 24, 0) old, d >= 6 or w >= 30 or activity >= 80 busy from a),
    t as (select *, case when old > 30 and w = 0 and d = 0 then 'DORMANT' when ((final >= 65 and topic >= 40) or central >= 60) and (busy or fresh >= 80 or coalesce(h <= 24, false) or fledgling >= 30) then 'HOT'
        when (final >= 45 and topic >= 25) or busy or central >= 35 then 'WARM' when final >= 30 or w >= 3 or activity >= 40 then 'NORMAL' when m >= 1 or old <= 30 then 'COLD' else 'DORMANT' end tier from b),
    z as (select *, case tier when 'HOT' then 240 when 'WARM' then 1080 when 'NORMAL' then 4320 when 'COLD' then 14400 else 43200 end * (case when final >= 75 or central >= 60 then 0.75 when final <= 25 and central <= 15 then 1.35 else 1.0 end::double
        * case when growth >= 70 then 0.8 else 1.0 end::double * case when fledgling >= 30 then 0.7 else 1.0 end::double) * case when failures > 0 then least(4.0::double, 1.5::double ** failures) else 1.0 end::double x,
        case when marked then 'incremental' when fledgling >= 30 or (tier = 'HOT' and final >= 70) then 'deep' when tier in ('WARM', 'NORMAL') then 'standard' else 'light' end depth from t)
    select event_id, tier, least(43200, greatest(120, trunc(x)::int)) \"minutes\", depth, case depth when 'incremental' then 100 when 'deep' then 150 when 'standard' then 40 else 15 end budget from z""")
def sm2_crawl_plan(s, d):
    mix = lambda by, n: c("event_id") * by % n
    hours = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(c("ts").cast("timestamp"))) / 1.8e9
    hours = F.when(c("event_id") % 11 > 0, hours)
    plan = S.crawl_plan(mix(37, 101), mix(53, 101), c("user_id") % 97, mix(29, 101), mix(41, 97), mix(13, 53), mix(17, 89), mix(1, 5), mix(1, 8), mix(1, 37), mix(1, 3), hours, mix(1, 4) == 0)
    return events(s, d).select("event_id", plan.alias("x")).select("event_id", "x.*")


@query(f"with {_DAYS} select user_id, least(20, k * 4 + v * 5 + p * 2) boost, case when e = 0 then 15 * least(s, 3) else least(50, 15 * least(s, 3) + 8 * least(e, greatest(1, ceil((45 - 15 * least(s, 3)) / 8)::int))) end penalty from u")
def lm9_learned(s, d):
    return user_days(s, d).select("user_id", S.learned_boost(c("k"), c("v"), c("p")).alias("boost"), S.learned_penalty(c("s"), c("e")).alias("penalty"))


@query("select event_type keyword, sum(case when value > 50 then 5 else -1 end)::bigint weight from events group by 1")
def lm15_bandit(s, d):
    return events(s, d).groupBy(c("event_type").alias("keyword")).agg(F.sum(F.when(c("value") > 50, 5).otherwise(-1)).alias("weight"))


@query(f"{LEADS} select id, channel, segment, lead_score from leads where segment <> 'MACHINERY' and not exists (select 1 from orders where (o_custkey = id or o_orderkey = id) and o_orderstatus in ('O', 'P') and o_orderdate > timestamp '2001-07-01' - interval 30 minute) order by case segment when 'BUILDING' then 1 when 'FURNITURE' then 2 else 5 end, lead_score desc nulls last, id limit 50")
def sm3_due(s, d):
    klass = F.when(c("segment") == "BUILDING", "HOT").when(c("segment") == "FURNITURE", "WARM")
    ch = leads(s, d).select("id", F.col("id").alias("name"), F.when(c("segment") == "MACHINERY", "rejected").otherwise("new").alias("status"), klass.alias("class"), c("lead_score").alias("score"), F.lit(None).cast("timestamp_ntz").alias("next_at"), "channel", "segment")
    jobs = orders(s, d).select(c("o_custkey").alias("channel_id"), c("o_orderkey").alias("channel_name"), F.when(c("o_orderstatus") == "O", "queued").when(c("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), c("o_orderdate").alias("scheduled_at"))
    return schedule.due(ch, jobs, "2001-07-01 00:00:00", 50).select("id", "channel", "segment", c("score").alias("lead_score"))


@query("select user_id job_id, arg_max(event_type, (ts, event_id)) status, count(*) changes, max(ts) since from events group by 1")
def sm4_job_states(s, d):
    return schedule.job_states(events(s, d).select(c("user_id").alias("job_id"), c("event_type").alias("status"), "ts", "event_id"), ["ts", "event_id"])


@query(f"select event_id from events where (event_type = 'error' or (event_type = 'view' and ts < timestamp '{AS_OF}' - interval 2 minute)) and ts > timestamp '{AS_OF}' - interval 2 hour")
def sm5_stuck(s, d):
    st = F.when(c("event_type") == "error", "enqueue_failed").when(c("event_type") == "view", "pending").otherwise("running")
    return schedule.stuck(events(s, d).select("event_id", st.alias("status"), c("ts").alias("scheduled_at")), AS_OF).select("event_id")


@query(f"{LEADS} select id, case when lead_score > 80 then 'critical' when lead_score > 60 then 'high' when lead_score > 40 then 'normal' else 'low' end queue from leads")
def sm10_queue(s, d):
    return leads(s, d).select("id", schedule.queue_of(c("lead_score")).alias("queue"))


@query(f"{EDGES} select source id, 'channel' kind, count(*) weight from edges group by 1 union all select target, 'source', count(*) from edges group by 1")
def gr4_vertices(s, d):
    e = edges(s, d)
    part = lambda side, kind: e.groupBy(c(side).alias("id")).agg(F.count("*").alias("weight")).select("id", F.lit(kind).alias("kind"), "weight")
    return part("source", "channel").unionAll(part("target", "source"))


@query(f"""{EDGES.replace('with edges', 'with recursive edges')}, a as (select distinct source, -target target from edges union select distinct -target, source from edges), k as (select source, target from a qualify row_number() over (partition by source order by target) <= 3),
    r(vertex, hop) as (select c_custkey, 0 from customer where c_custkey % 97 = 7 union select k.target, hop + 1 from r join k on k.source = r.vertex where hop < 4) select vertex, min(hop)::int hop from r group by 1""")
def gr6_spider(s, d):
    """Customers reach suppliers and these their customers: four hops, three children a vertex."""
    e = edges(s, d).select("source", (-c("target")).alias("target"))
    both = e.unionAll(e.select(c("target").alias("source"), c("source").alias("target")))
    return graph.bounded_bfs(both, customer(s, d).filter("c_custkey % 97 = 7").select(c("c_custkey").alias("vertex")), 4, per_vertex=3, rows=2 * lineitem(s, d).count())


@query("with t as (select ts::date as \"day\", count(*) n from events group by 1), q as (select ts::date as \"day\", count(*) hq from events where value > 90 group by 1) select \"day\", n, coalesce(hq, 0) hq from t left join q using (\"day\")")
def xt1_series(s, d):
    day = F.to_date("ts").alias("day")
    n = events(s, d).groupBy(day).agg(F.count("*").alias("n"))
    return n.join(events(s, d).filter("value > 90").groupBy(day).agg(F.count("*").alias("hq")), "day", "left").fillna(0)


@query("with b as (select hour(ts) as \"hour\", count(*) n from events group by 1) select \"hour\", n, greatest(8, round(100.0 * n / max(n) over ())::int) bar, n = max(n) over () peak from b")
def xt3_peak(s, d):
    b = events(s, d).groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    top = b.agg(F.max("n").alias("top"))
    return b.crossJoin(F.broadcast(top)).select("hour", "n", F.greatest(F.lit(8), F.round(100.0 * c("n") / c("top")).cast("int")).alias("bar"), (c("n") == c("top")).alias("peak"))


@query(f"{LEADS} select count(*) filter (tier is not null) tiered, count(*) filter (lead_score > 0) fit, count(*) filter (channel is not null and channel <> '') named from leads")
def xt5_coverage(s, d):
    return leads(s, d).agg(F.count_if(c("tier").isNotNull()).alias("tiered"), F.count_if(c("lead_score") > 0).alias("fit"), F.count_if(F.coalesce("channel", F.lit("")) != "").alias("named"))


@query("select o_orderkey from orders where o_totalprice > 300000 or o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def xt10_or_semi(s, d):
    keys = customer(s, d).filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(True).alias("hit"))
    return orders(s, d).join(keys, c("o_custkey") == c("c_custkey"), "left").filter("o_totalprice > 300000 or hit").select("o_orderkey")


@query("select keyword, sum(n)::bigint freq from (select unnest(['the', 'secret', 'token']) keyword), lateral (select (length(lower(text)) - length(replace(lower(text), keyword, ''))) / length(keyword) n from documents) group by 1")
def tx3_frequencies(s, d):
    low = documents(s, d).select(F.lower("text").alias("t"))
    total = low.agg(*[F.sum(T.substring_count(c("t"), w)).alias(w) for w in ("the", "secret", "token")])
    return total.select(F.expr("stack(3, 'the', `the`, 'secret', `secret`, 'token', `token`) as (keyword, freq)"))
