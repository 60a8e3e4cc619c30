"""Registered queries over the driver's tables and their SQL oracles, by operator id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import text as T
from tidemark.operators import graph, lexicon, merge, mining, state, views
from tidemark.sources.io import edges, exposition, leads, table

AS_OF = "2024-01-30 00:00:00"
LEADS = "with leads as (select c_custkey id, c_name channel, c_nationkey nation, floor(c_acctbal / 100)::int lead_score, c_mktsegment segment, case when c_acctbal >= 7500 then 'P0' when c_acctbal >= 5000 then 'P1' when c_acctbal >= 2500 then 'P2' end tier from customer)"
EDGES = "with edges as (select o_custkey source, l_suppkey target, l_returnflag relation, l_shipdate ts, l_orderkey * 10 + l_linenumber seq, l_quantity::int confidence, l_linestatus evidence from orders join lineitem on o_orderkey = l_orderkey)"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(name: str, *columns: str):
    return lambda s, d: table(s, d, name, list(columns) or None)


events, documents, pages, orders, lineitem, customer = (_t(n) for n in ("events", "documents", "pages", "orders", "lineitem", "customer"))


@query(f"select count(*) total, count(*) filter (event_type = 'error') errors, count(*) filter (ts >= timestamp '{AS_OF}' - interval 24 hour) last_day, count(*) filter (value > 50) high, round(avg(value) filter (event_type = 'purchase'), 1) mean_purchase from events")
def ag1_kpi(s, d):
    return views.kpis(events(s, d), {"errors": c("event_type") == "error", "last_day": views.since("ts", AS_OF, "24 hours"), "high": c("value") > 50}, {"mean_purchase": F.when(c("event_type") == "purchase", c("value"))})


@query("select user_id, case when count(*) > 0 then round_even(count(*) filter (event_type = 'error') * 100.0::double / count(*), 1) else 0 end error_rate from events group by 1")
def ag2_rate(s, d):
    return events(s, d).groupBy("user_id").agg(views.rate(F.count_if(c("event_type") == "error"), F.count("*")).alias("error_rate"))


@query("select strftime(date_trunc('hour', ts), '%H:00') label, date_trunc('hour', ts) bucket, count(*) n, count(*) filter (event_type = 'error') errors from events group by all")
def ag3_hourly(s, d):
    return views.time_buckets(events(s, d), "ts", "HOUR", {"errors": c("event_type") == "error"}).withColumn("label", F.date_format("bucket", "HH:00"))


@query("select ts::date as \"day\", count(*) n from events group by 1 order by 1 desc limit 14")
def ag4_daily(s, d):
    return views.top_k(events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), [F.desc("day")], 14)


@query("select ts::date as \"day\", round(count(*) filter (event_type = 'purchase') * 100.0 / count(*))::int share from events group by 1")
def ag5_daily_ratio(s, d):
    return events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.count_if(c("event_type") == "purchase") * 100.0 / F.count("*")).cast("int").alias("share"))


@query(f"{LEADS} select coalesce(tier, 'Unassigned') as \"label\", count(*) n from leads group by tier")
def ag6_tiers(s, d):
    return views.labelled_counts(leads(s, d), "tier", "Unassigned")


@query("select l_suppkey, count(*) n, count(*) filter (l_quantity >= 40) hq, round(count(*) filter (l_quantity >= 40) * 100.0 / count(*))::int quality, max(l_shipdate) last_seen from lineitem group by 1 order by n desc, l_suppkey limit 20")
def ag7_source_yield(s, d):
    y = lineitem(s, d).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(c("l_quantity") >= 40).alias("hq"), F.round(F.count_if(c("l_quantity") >= 40) * 100.0 / F.count("*")).cast("int").alias("quality"), F.max("l_shipdate").alias("last_seen"))
    return views.top_k(y, [F.desc("n"), c("l_suppkey")], 20)


@query("select count(*) total, count(*) filter (o_orderstatus <> 'P') decided, count(*) filter (o_orderstatus = 'F') filled, count(*) filter (o_orderstatus = 'F' and o_totalprice > 200000) large from orders")
def ag8_funnel(s, d):
    st = c("o_orderstatus")
    return views.kpis(orders(s, d), {"decided": st != "P", "filled": st == "F", "large": (st == "F") & (c("o_totalprice") > 200000)}, {})


@query(f"{LEADS} select segment, count(*) n, round(avg(lead_score), 1) mean_score from leads group by 1")
def ag9_categories(s, d):
    return leads(s, d).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("lead_score"), 1).alias("mean_score"))


@query(f"{LEADS} select count(*) filter (lead_score >= 90) from_90, count(*) filter (lead_score >= 75 and lead_score < 90) from_75, count(*) filter (lead_score >= 50 and lead_score < 75) from_50, count(*) filter (lead_score >= 25 and lead_score < 50) from_25, count(*) filter (lead_score >= 0 and lead_score < 25) from_0 from leads")
def ag10_histogram(s, d):
    return views.histogram(leads(s, d), "lead_score", [90, 75, 50, 25, 0])


@query(f"{LEADS} select count(*) total, count(*) filter (lead_score < 0) negative, count(*) filter (tier is null) untiered, count(*) filter (segment = 'BUILDING' and lead_score < 25) weak from leads")
def ag11_rejections(s, d):
    return views.kpis(leads(s, d), {"negative": c("lead_score") < 0, "untiered": c("tier").isNull(), "weak": (c("segment") == "BUILDING") & (c("lead_score") < 25)}, {})


@query("select event_type, count(*) n from events group by 1 order by n desc, 1")
def ag12_group_count(s, d):
    return events(s, d).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("select c_custkey, count(o_orderkey) logs, count(case when o_orderstatus = 'F' then 1 end) sent, count(case when o_orderstatus = 'O' then 1 end) pending, count(case when o_orderpriority = '1-URGENT' then 1 end) urgent from customer left join orders on o_custkey = c_custkey group by 1")
def ag13_campaigns(s, d):
    o = orders(s, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    n = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("logs"), F.count_if(c("o_orderstatus") == "F").alias("sent"), F.count_if(c("o_orderstatus") == "O").alias("pending"), F.count_if(c("o_orderpriority") == "1-URGENT").alias("urgent"))
    j = customer(s, d).select("c_custkey").join(n, c("c_custkey") == c("o_custkey"), "left").drop("o_custkey")
    return j.fillna(0)


@query("select l_returnflag, count(distinct l_suppkey) suppliers, count(distinct l_partkey) parts from lineitem group by 1")
def ag14_distinct(s, d):
    return lineitem(s, d).groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("select o_custkey, count(*) n from orders group by 1 having count(*) filter (o_orderstatus = 'F') > 5")
def ag15_having(s, d):
    return orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("f")).filter("f > 5").drop("f")


@query("select 'customer' as name, count(*) n from customer union all select 'orders', count(*) from orders union all select 'events', count(*) from events")
def ag16_table_counts(s, d):
    one = lambda t: table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("customer").unionAll(one("orders")).unionAll(one("events"))


@query("select source, count(*) posts, count(*) filter (contains(text, 'the')) with_term, count(*) filter (contains(text, '!!')) shouted from documents group by 1")
def ag17_recurrence(s, d):
    return documents(s, d).groupBy("source").agg(F.count("*").alias("posts"), F.count_if(c("text").contains("the")).alias("with_term"), F.count_if(c("text").contains("!!")).alias("shouted"))


@query("with n as (select user_id, event_type, count(*) n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, event_type) r from n), t as (select user_id, sum(n) total from n group by 1) select user_id, event_type, n, round(n / total::double, 3) share from r join t using (user_id) where r <= 2")
def ag18_top_origins(s, d):
    n = events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = n.groupBy("user_id").agg(F.sum("n").alias("total"))
    top = views.top_per_group(n, ["user_id"], [F.desc("n"), c("event_type")], 2)
    return top.join(total, "user_id").select("user_id", "event_type", "n", F.round(c("n") / c("total"), 3).alias("share"))


@query("select user_id, trunc(avg(value))::int mean_recent from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 10 group by 1")
def ag19_recent_mean(s, d):
    return views.top_per_group(events(s, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).groupBy("user_id").agg(F.avg("value").cast("int").alias("mean_recent"))


@query(f"select user_id, count(*) filter (ts >= timestamp '{AS_OF}' - interval 72 hour) posts_72h, count(*) filter (ts >= timestamp '{AS_OF}' - interval 7 day) posts_7d, count(*) filter (ts >= timestamp '{AS_OF}' - interval 72 hour) < 3 inactive from events group by 1")
def ag20_activity(s, d):
    near, week = F.count_if(views.since("ts", AS_OF, "72 hours")), F.count_if(views.since("ts", AS_OF, "7 days"))
    return events(s, d).groupBy("user_id").agg(near.alias("posts_72h"), week.alias("posts_7d"), (near < 3).alias("inactive"))


@query("with m as (select count(*) filter (event_type <> 'error')::double ok, count(*) filter (event_type = 'error')::double bad from events) select 'success_rate' as name, round(ok / (ok + bad), 4) as value from m union all select 'failure_rate', round(bad / (ok + bad), 4) from m")
def ag21_metrics(s, d):
    m = events(s, d).agg(F.count_if(c("event_type") != "error").alias("ok"), F.count_if(c("event_type") == "error").alias("bad"))
    return m.select(F.expr("stack(2, 'success_rate', round(ok / (ok + bad), 4), 'failure_rate', round(bad / (ok + bad), 4)) as (name, value)"))


@query(f"{LEADS} select id, channel, lead_score from leads where segment = 'AUTOMOBILE' and lead_score >= 10 order by lead_score desc, id limit 10")
def tk1_leaderboard(s, d):
    keep = views.conjunction([c("segment") == "AUTOMOBILE", c("lead_score") >= 10])
    return views.top_k(leads(s, d).filter(keep).select("id", "channel", "lead_score"), [F.desc_nulls_last("lead_score"), c("id")], 10)


@query(f"{EDGES}, o as (select source v, count(*) n from edges group by 1 union all select target, count(*) from edges group by 1) select v vertex, sum(n)::bigint degree from o group by 1 order by degree desc, v limit 10")
def tk2_most_connected(s, d):
    return views.top_k(graph.degrees(edges(s, d)).select("vertex", (c("in_degree") + c("out_degree")).alias("degree")), [F.desc("degree"), c("vertex")], 10)


@query(f"{EDGES} select target, count(*) n from edges group by 1 order by n desc, target limit 10")
def tk3_most_mentioned(s, d):
    return views.top_k(edges(s, d).groupBy("target").agg(F.count("*").alias("n")), [F.desc("n"), c("target")], 10)


@query("select c_custkey, coalesce(n, 0) fresh from customer left join (select o_custkey, count(*) n from orders where o_orderdate >= timestamp '2001-07-01' - interval 30 day group by 1) on o_custkey = c_custkey order by fresh desc, c_custkey limit 15")
def tk4_fastest_growing(s, d):
    n = orders(s, d).filter(views.since("o_orderdate", "2001-07-01 00:00:00", "30 days")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = customer(s, d).select("c_custkey").join(n, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("fresh"))
    return views.top_k(j, [F.desc("fresh"), c("c_custkey")], 15)


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_totalprice desc nulls last, o_orderkey limit 20")
def tk9_ranked_order(s, d):
    rank = F.when(c("o_orderpriority") == "1-URGENT", 0).when(c("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return views.top_k(orders(s, d).select("o_orderkey", "o_orderpriority", "o_totalprice"), [rank, F.desc_nulls_last("o_totalprice"), c("o_orderkey")], 20)


@query(f"{LEADS} select id, lead_score from leads order by lead_score desc, id limit 25 offset 50")
def tk10_page(s, d):
    return views.top_k(leads(s, d).select("id", "lead_score"), [F.desc("lead_score"), c("id")], 25, 50)


@query("""select c_custkey from customer
    where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 200000)""")
def jn4_anti(s, d):
    large = orders(s, d).filter("o_orderstatus = 'P' and o_totalprice > 200000")
    return customer(s, d).select("c_custkey").join(large, c("c_custkey") == c("o_custkey"), "left_anti")


@query("""with k as (select case when c_custkey % 5 > 0 then c_custkey end k from customer), o as (select o_custkey from orders where o_orderstatus = 'P')
    select 'none null' kind, k from k where k not in (select o_custkey from o)
    union all select 'null', k from k where k not in (select nullif(o_custkey, (select min(o_custkey) from o)) from o)
    union all select 'empty', k from k where k not in (select o_custkey from o where false)""")
def jn5_not_in(s, d):
    keys = customer(s, d).select(F.when(c("c_custkey") % 5 > 0, c("c_custkey")).alias("k"))
    o = orders(s, d).filter("o_orderstatus = 'P'").select("o_custkey")
    least = o.agg(F.min("o_custkey")).first()[0]
    sets = {"none null": o, "null": o.select(F.nullif("o_custkey", F.lit(least)).alias("o_custkey")), "empty": o.filter("false")}
    found = [views.not_in(keys, "k", x, "o_custkey").select(F.lit(kind).alias("kind"), "k") for kind, x in sets.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def jn6_semi(s, d):
    return customer(s, d).select("c_custkey").join(orders(s, d).filter("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_orderstatus = 'P' and (o_custkey = c_custkey or o_orderkey = c_custkey))")
def jn7_or_anti(s, d):
    p = orders(s, d).filter("o_orderstatus = 'P'")
    return customer(s, d).select("c_custkey").join(p.select(c("o_custkey").alias("k")), c("c_custkey") == c("k"), "left_anti").join(p.select(c("o_orderkey").alias("k")), c("c_custkey") == c("k"), "left_anti")


@query(f"{EDGES} select v vertex, coalesce(i, 0) in_degree, coalesce(o, 0) out_degree from (select source v from edges union select target from edges) left join (select target v, count(*) i from edges group by 1) using (v) left join (select source v, count(*) o from edges group by 1) using (v)")
def jn8_degrees(s, d):
    return graph.degrees(edges(s, d))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) r from orders) where r = 1")
def wn1_first_row(s, d):
    return views.top_per_group(orders(s, d), ["o_custkey"], [c("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("select user_id, arg_min(value, (ts, event_id)) first_value, arg_max(value, (ts, event_id)) last_value from events group by 1")
def wn2_first_last(s, d):
    at = F.struct("ts", "event_id")
    return events(s, d).groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@query("with i as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) g from events) select event_id, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, g order by ts, event_id rows unbounded preceding)::bigint failures from i")
def wn5_streaks(s, d):
    return views.streaks(events(s, d), "user_id", ["ts", "event_id"], c("event_type") == "error").select("event_id", "failures")


def _halves(s, d):
    o = orders(s, d)
    cut = F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    half = lambda x: o.filter(x).groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n"), F.min("o_orderpriority").alias("pr"))
    return half(c("o_orderdate") < cut), half(c("o_orderdate") >= cut)


@query("with h as (select o_custkey, o_orderdate >= timestamp '1998-01-01' late, max(o_totalprice) t, count(*) n, min(o_orderpriority) pr from orders group by all), b as (select * from h where not late), e as (select * from h where late) select coalesce(b.o_custkey, e.o_custkey) o_custkey, greatest(b.t, e.t) top, coalesce(b.n, 0) + coalesce(e.n, 0) n, coalesce(e.pr, b.pr) pr from b full join e on b.o_custkey = e.o_custkey")
def ups3_merge(s, d):
    base, delta = _halves(s, d)
    return merge.merge(base, delta, "o_custkey", {"top": "max", "n": "sum", "pr": "coalesce"})


@query(f"{EDGES} select source, target, relation, count(*) occurrences, least(100, arg_min(confidence, (ts, seq)) + 5 * (count(*) - 1)) confidence, arg_max(evidence, (ts, seq)) filter (evidence <> '') evidence, min(ts) first_seen, max(ts) last_seen from edges where source <> target group by all")
def ups5_edges(s, d):
    return merge.edge_upsert(edges(s, d).filter("source <> target"), ["source", "target", "relation"], "ts", "confidence", "evidence", "seq")


@query("""with p as (select l_orderkey target, count(*) in_degree, count(distinct l_suppkey) sources, count(distinct l_returnflag) relations,
    count(*) filter (l_returnflag = 'A') recommendations, count(*) filter (l_returnflag in ('R', 'X')) forwards from lineitem group by 1)
    select *, least(100, case when in_degree >= 20 then 40 when in_degree >= 10 then 30 when in_degree >= 5 then 20 when in_degree >= 2 then 12 when in_degree >= 1 then 6 else 0 end
    + case when recommendations >= 5 then 20 when recommendations >= 2 then 15 when recommendations >= 1 then 10 else 0 end
    + case when forwards >= 10 then 15 when forwards >= 3 then 10 when forwards >= 1 then 5 else 0 end
    + case when relations >= 4 then 15 when relations >= 2 then 10 when relations >= 1 then 5 else 0 end
    + case when sources >= 3 then 10 when sources >= 2 then 6 when sources >= 1 then 2 else 0 end) importance from p""")
def sc33_importance(s, d):
    e = lineitem(s, d).select(c("l_suppkey").alias("source"), c("l_orderkey").alias("target"), c("l_returnflag").alias("relation"))
    return graph.importance(graph.in_profile(e, {"recommendation": ["A"], "forward": ["R", "X"]}))



@query(f"{EDGES} select target, relation, count(*) occurrences, max(ts) last_seen from edges where source = 7 group by all order by occurrences desc, last_seen desc, target, relation limit 10")
def gr2_neighbours(s, d):
    e = edges(s, d).groupBy("source", "target", "relation").agg(F.count("*").alias("occurrences"), F.max("ts").alias("last_seen"))
    return graph.neighbours(e, 7, 10).drop("source")


@query("with recursive e as (select distinct o_custkey a, -l_suppkey b from orders join lineitem on o_orderkey = l_orderkey), g as (select a s, b t from e union select b, a from e), r(v, hop) as (select 7::bigint, 0 union select t, hop + 1 from r join g on s = v where hop < 3) select v vertex, min(hop) hop from r group by 1")
def gr5_bfs(s, d):
    j = orders(s, d).join(lineitem(s, d), c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("source"), (-c("l_suppkey")).alias("target"))
    both = j.unionAll(j.select(c("target").alias("source"), c("source").alias("target")))
    return graph.bounded_bfs(both, s.createDataFrame([(7,)], "vertex long"), 3)


@query(ORACLES["gr5_bfs"])
def gr5_bfs_all(s, d):
    return gr5_bfs(s, d)


@query("with t as (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 2 and not regexp_full_match(t, '[0-9]+')) w, quality = 1 p from documents join labels using (doc_id)), f as (select p, unnest(list_distinct(list_filter(w, lambda x: length(x) >= 3))) feature from t), z as (select count(*) filter (p) np, greatest(1, count(*) filter (not p)) nn from t), k as (select feature, count(*) filter (p) df_pos, count(*) filter (not p) df_neg from f group by 1 having count(*) filter (p) >= 2), r as (select feature, df_pos, df_neg, round_even(log2((df_pos + 0.5) / (np - df_pos + 0.5)) - log2((df_neg + 0.5) / (nn - df_neg + 0.5)), 3) contrast from k, z) select * from r where contrast >= 0.2")
def lm4_contrast(s, d):
    docs = documents(s, d).join(table(s, d, "labels"), "doc_id").select("text", (c("quality") == 1).alias("positive"))
    return mining.contrast(docs, T.tokens(c("text")), 1)


@query(ORACLES["lm4_contrast"])
def lm4_contrast_all(s, d):
    return lm4_contrast(s, d)


@query("""with t as (select doc_id, coalesce(text, '') || repeat('سلام ', (doc_id % 9 * 10)::int) t from documents),
    n as (select doc_id, length(regexp_replace(t, '[^\\x{600}-\\x{6FF}]', '', 'g')) a, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) latin from t)
    select doc_id, case when a + latin > 0 then round_even(a / (a + latin), 3) else 0.0 end ratio, latin from n""")
def str3_script_ratio(s, d):
    t = F.concat(F.coalesce("text", F.lit("")), F.expr("repeat('سلام ', cast(doc_id % 9 * 10 as int))"))
    rows = documents(s, d).select("doc_id", t.alias("t"))
    return rows.select("doc_id", T.script_ratio(c("t")).alias("ratio"), F.length(F.regexp_replace("t", "[^A-Za-z]", "")).cast("long").alias("latin"))


@query("select doc_id, ((length(text) - length(replace(text, 'th', ''))) / 2)::int n_th from documents")
def str6_substring_count(s, d):
    return documents(s, d).select("doc_id", T.substring_count(c("text"), "th").alias("n_th"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) n_links, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') links from pages")
def src8_pages(s, d):
    return pages(s, d).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(T.links(c("html"))).alias("n_links"), F.array_join(T.links(c("html")), " ").alias("links"))


@query("select page_id, array_to_string(regexp_extract_all(lower(url), 'https?://([a-z0-9.-]+)', 1), ' ') hosts from pages")
def tx18_domains(s, d):
    return pages(s, d).select("page_id", F.array_join(T.link_hosts(c("url")), " ").alias("hosts"))


@query("select doc_id, array_to_string(list_filter(['secret', 'password', 'token', 'the'], lambda t: contains(lower(text), t)), ' ') terms from documents")
def tx1_lexicon(s, d):
    return documents(s, d).select("doc_id", F.array_join(T.matched_terms(c("text"), ["secret", "password", "token", "the"]), " ").alias("terms"))


@query(ORACLES["tx1_lexicon"])
def tx1_lexicon_all(s, d):
    """The same terms by one automaton, as for a lexicon of any size."""
    terms = s.createDataFrame([(i, "all", t, 1) for i, t in enumerate(("secret", "password", "token", "the"))], "position int, category string, term string, weight int")
    hits = lexicon.term_hits(documents(s, d), "text", terms, T.normalize_arabic, ("doc_id",))
    return hits.select("doc_id", F.array_join(F.transform("hits", lambda x: x["term"]), " ").alias("terms"))


_TERMS = r"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) term from benchmark),
    l as (select term, row_number() over (order by term) - 1 "position", 'c' || ascii(term) % 4 category, ascii(term) % 4 * 10 + 5 weight from w)"""


def _taxonomy(s, d):
    """The words of the benchmark as a lexicon of four categories."""
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term")).distinct()
    rows = words.select(F.row_number().over(Window.orderBy("term")).alias("n"), "term")  # a lexicon's size
    return rows.select((c("n") - 1).alias("position"), F.concat(F.lit("c"), F.ascii("term") % 4).alias("category"), "term", (F.ascii("term") % 4 * 10 + 5).alias("weight"))


@query(f"""{_TERMS}, h as (select doc_id, category, term, "position", weight from documents join l on contains(lower(text), term)),
    g as (select doc_id, category, max(weight) weight, string_agg(term, ' ' order by "position") terms from h group by all)
    select d.doc_id, coalesce(string_agg(category || ': ' || terms, '; ' order by category), '') found, coalesce(sum(weight), 0)::int points from documents d left join g using (doc_id) group by 1""")
def tx2_taxonomy(s, d):
    hits = lexicon.term_hits(documents(s, d), "text", _taxonomy(s, d), T.normalize_arabic, ("doc_id",))
    entries = F.transform(F.map_entries(lexicon.categories(c("hits"))), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], " ")))
    return hits.select("doc_id", F.array_join(entries, "; ").alias("found"), lexicon.weighted(c("hits")).alias("points"))


@query(f"""{_TERMS}, g as (select source, term, sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::bigint n from documents, l group by all)
    select source, term, n, n / sum(n) over (partition by source) share from g where n > 0""")
def tx3_shares(s, d):
    hits = lexicon.term_hits(documents(s, d), "text", _taxonomy(s, d), T.normalize_arabic, ("source",))
    return lexicon.shares(hits, "source")


@query(f"""with h as (select user_id, case when user_id % 4 > 0 then (epoch_us(timestamp '{AS_OF}') - epoch_us(max(ts))) / 3.6e9 end hrs,
    count(*) filter (ts >= timestamp '{AS_OF}' - interval 24 hour) a, count(*) filter (ts >= timestamp '{AS_OF}' - interval 7 day) b, count(*) filter (value > 95) m from events group by 1)
    select user_id, case when hrs <= 24.5 then 100 when hrs <= 72.5 then 80 when hrs <= 168.5 then 60 when hrs <= 336.5 then 45 when hrs <= 720.5 then 30 when hrs is not null then 15
    when a > 0 then 90 when b > 0 then 60 when m > 0 then 35 else 10 end freshness from h""")
def sc8_freshness(s, d):
    hours = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 3.6e9)
    counts = [F.count_if(x).alias(k) for k, x in {"a": views.since("ts", AS_OF, "24 hours"), "b": views.since("ts", AS_OF, "7 days"), "m": c("value") > 95}.items()]
    k = events(s, d).groupBy("user_id").agg(hours.alias("h"), *counts)
    return k.select("user_id", L.freshness(F.when(c("user_id") % 4 > 0, c("h")), c("a"), c("b"), c("m")).alias("freshness"))


@query(f"with k as (select user_id, count(*) filter (ts >= timestamp '{AS_OF}' - interval 24 hour) a, count(*) filter (ts >= timestamp '{AS_OF}' - interval 7 day) b, count(*) m from events group by 1) select user_id, greatest(5, least(100, case when a >= 5 then 50 when a >= 1 then 30 when b >= 7 then 20 else 0 end + case when b >= 20 then 30 when b >= 5 then 15 when b >= 1 then 10 else 0 end + case when m >= 50 then 20 when m >= 10 then 10 when m >= 1 then 5 else 0 end)) activity, case when a >= 5 or b >= 35 then 'HOT' when a >= 1 or b >= 7 or m >= 20 then 'WARM' when b >= 1 or m >= 1 then 'COLD' else 'DORMANT' end class from k")
def sc7_activity(s, d):
    k = events(s, d).groupBy("user_id").agg(F.count_if(views.since("ts", AS_OF, "24 hours")).alias("a"), F.count_if(views.since("ts", AS_OF, "7 days")).alias("b"), F.count("*").alias("m"))
    return k.select("user_id", L.activity_score(c("a"), c("b"), c("m")).alias("activity"), L.activity_class(c("a"), c("b"), c("m"), F.lit(None).cast("double")).alias("class"))


@query("with g as (select user_id, arg_min(value, (ts, event_id)) a, arg_max(value, (ts, event_id)) b, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10, 0.01) dd, count(*) n from events group by 1), p as (select *, (b - a) * 100.0 / greatest(1.0, a) p from g) select user_id, case when n < 2 then 0 when p >= 50 and dd <= 30 then 95 when p >= 25 and dd <= 14 then 90 when p >= 10 then 75 when p >= 0 then least(70, 50 + trunc(2 * p)::int) when p >= -5 then 45 else greatest(10, 50 - trunc(abs(p))::int) end growth from p")
def sc10_growth(s, d):
    at, us = F.struct("ts", "event_id"), lambda x: F.unix_micros(x.cast("timestamp"))
    g = events(s, d).groupBy("user_id").agg(F.min_by("value", at).alias("a"), F.max_by("value", at).alias("b"), ((us(F.max("ts")) - us(F.min("ts"))) / 8.64e10).alias("days"), F.count("*").alias("n"))
    return g.select("user_id", F.when(c("n") < 2, 0).otherwise(L.growth_score(c("a"), c("b"), c("days"))).alias("growth"))


@query(f"{LEADS} select id, case when lead_score >= 75 then 'A' when lead_score >= 55 then 'B' when lead_score >= 35 then 'C' else 'D' end tier from leads")
def sc14_tier(s, d):
    return leads(s, d).select("id", L.ladder(c("lead_score"), L.TIERS, "D").alias("tier"))


@query("select user_id, count(*) // 30 windows from events group by 1 having count(*) >= 30")
def st3_count_windows(s, d):
    b = state.count_windows(events(s, d), "user_id", ["ts", "event_id"], 30).groupBy("user_id", "bucket").agg(F.count("*").alias("n")).filter("n = 30")
    return b.groupBy("user_id").agg(F.count("*").alias("windows"))


_ORDERED = "with recursive e as (select *, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) i from events"


@query(f"""{_ORDERED}), r as (select user_id, 0 i, cast([] as bigint[]) log, 0::bigint admitted, 0::bigint rejected from (select distinct user_id from events)
    union all select user_id, i, case when len(kept) < 3 then list_append(kept, t) else kept end, admitted + (len(kept) < 3)::int, rejected + (len(kept) >= 3)::int
    from (select r.user_id, e.i, t, admitted, rejected, list_filter(log, lambda x: x > t - 86400000000) kept from r join e on e.user_id = r.user_id and e.i = r.i + 1))
    select user_id, arg_max(admitted, i) admitted, arg_max(rejected, i) rejected from r group by 1""")
def st6_rate_limiter(s, d):
    return state.rate_limiter(events(s, d), "user_id", "ts", "event_id", 86400, 3)


@query(f"""{_ORDERED} where event_type = 'error'), r as (select user_id, 0 i, null::bigint since, 0 n, 0 trips, null::bigint until from (select distinct user_id from e)
    union all select user_id, i, since, n, trips + (n >= 3 and (until is null or t >= until))::int, case when n >= 3 then t + 86400000000 * 2 else until end
    from (select r.user_id, e.i, t, trips, until, case when since is null or t >= since + 86400000000 * 7 then t else since end since,
        case when since is null or t >= since + 86400000000 * 7 then 1 else n + 1 end n from r join e on e.user_id = r.user_id and e.i = r.i + 1))
    select user_id, arg_max(trips, i)::int trips, make_timestamp(max(until)) open_until from r group by 1""")
def st7_breaker(s, d):
    return state.fixed_window_trips(events(s, d).filter("event_type = 'error'"), "user_id", "ts", "event_id", 7 * 86400, 3, 2 * 86400)


@query(f"""{_ORDERED}), k as (select user_id, i, t, case when event_type = 'error' then 'error' when event_type = 'signup' then 'flood' when event_type = 'view' and value > 99 then 'auth' else 'success' end kind, (value * 1.5)::int secs from e),
    f as (select *, count(*) filter (kind = 'flood') over (partition by user_id order by t range between 1799999999 preceding and current row) peers from k),
    r as (select user_id, 0 i, 100 health, 'HEALTHY' state from (select distinct user_id from k)
    union all select r.user_id, f.i, case kind when 'success' then least(100, health + 1) when 'flood' then greatest(0, health - case when secs <= 60 then 5 else 15 end) when 'error' then greatest(0, health - 10) else 0 end,
        case when state = 'QUARANTINED' or kind = 'auth' then 'QUARANTINED' when kind = 'flood' and state = 'HEALTHY' then case when secs > 60 or peers >= 3 then 'DEGRADED' else state end
            when kind = 'flood' and state = 'COOLDOWN' then 'RESTRICTED' when kind in ('flood', 'error') and state = 'DEGRADED' then 'COOLDOWN'
            when kind = 'success' and state = 'DEGRADED' and least(100, health + 1) >= 90 then 'HEALTHY' else state end
    from r join f on f.user_id = r.user_id and f.i = r.i + 1)
    select user_id, arg_max(health, i) health, arg_max(state, i) state from r group by 1""")
def sm6_health(s, d):
    kind = F.when(c("event_type") == "error", "error").when(c("event_type") == "signup", "flood").when((c("event_type") == "view") & (c("value") > 99), "auth").otherwise("success")
    rows = events(s, d).withColumn("kind", kind).withColumn("secs", F.rint(c("value") * 1.5).cast("int"))
    return state.health_machine(rows, "user_id", "ts", "event_id", "kind", "secs")


@query("select 'events_total{type=\"' || event_type || '\"} ' || count(*) line from events group by event_type")
def snk6_exposition(s, d):
    return events(s, d).groupBy("event_type").agg(F.count("*").alias("n")).select(exposition("events_total", "type", c("event_type"), c("n")).alias("line"))


@query("select event_id, json_extract_string(props, '$.k')::int k from events")
def js2_field(s, d):
    return events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select o_orderpriority, count(*) filter (o_orderstatus = 'F') \"F\", count(*) filter (o_orderstatus = 'O') \"O\", count(*) filter (o_orderstatus = 'P') \"P\" from orders group by 1")
def xt4_pivot(s, d):
    return orders(s, d).groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).fillna(0)


@query("""with known as (select c_custkey k from customer where c_custkey % 3 > 0), now as (select distinct o_custkey k from orders where o_custkey % 4 > 0)
    select 'gone' side, k from (select k from known except select k from now) union all select 'new', k from (select k from now except select k from known)""")
def xt8_difference(s, d):
    known = customer(s, d).filter("c_custkey % 3 > 0").select(c("c_custkey").alias("k"))
    now = orders(s, d).filter("o_custkey % 4 > 0").select(c("o_custkey").alias("k"))
    gone, new = known.exceptAll(now.distinct()), now.distinct().exceptAll(known)
    return gone.select(F.lit("gone").alias("side"), "k").unionAll(new.select(F.lit("new").alias("side"), "k"))