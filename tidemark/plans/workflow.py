"""Registered queries of queues, seen-sets, purges, claims and further leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import mining, queues, views
from tidemark.plans.catalog import AS_OF, EDGES, LEADS, ORACLES, c, customer, documents, edges, events, orders, query
from tidemark.plans.relevance import DOCS, _said
from tidemark.sources.io import leads, spread, table


@query("with f as (select user_id, min_by(event_id, (ts, event_id)) event_id from events where user_id % 4 > 0 and ts >= timestamp '2024-01-15' group by 1) select user_id, event_id from f where user_id not in (select user_id from events where ts < timestamp '2024-01-02')")
def set4_unseen(s, d):
    rows = events(s, d).filter("user_id % 4 > 0 and ts >= timestamp_ntz'2024-01-15'").withColumn("k", F.concat(F.lit(" User"), c("user_id")))
    seen = events(s, d).filter("ts < timestamp_ntz'2024-01-02'").select(F.concat(F.lit("USER"), c("user_id"), F.lit(" ")).alias("k"))
    return queues.unseen(rows, seen, "k", [c("ts"), c("event_id")]).select("user_id", "event_id")


@query(f"{LEADS}, g as (select id, lead_score from leads where tier = 'P0'), o as (select id, lead_score from leads where lead_score > 60 and id not in (select id from g)) select id from (select id, 0 side from g union all select id, 1 from o) order by side, id limit 300")
def set1_union(s, d):
    rows = leads(s, d).select("id", "lead_score", "tier")
    return queues.left_preferred(rows.filter("tier = 'P0'"), rows.filter("lead_score > 60"), "id", "id", 300).select("id")


@query("select user_id, array_to_string(list_sort(list(distinct nullif(event_type, 'view'))), ',') sources, count(distinct nullif(event_type, 'view'))::int n_sources, count(*) n, min(ts) first_seen from events group by 1")
def st9_provenance(s, d):
    found = events(s, d).withColumn("source", F.nullif("event_type", F.lit("view")))
    return queues.provenance(found, "user_id", "source", "ts").withColumn("sources", F.array_join("sources", ","))


@query("select c_custkey, case c_nationkey % 3 when 0 then 'a,b,a' when 1 then 'a,b,c' else 'a' end found from customer")
def ups6_append(s, d):
    old = F.when(c("c_nationkey") % 3 < 2, F.array(F.lit("a"), F.lit("b"), F.lit("a")))
    new = F.when(c("c_nationkey") % 3 == 1, "c").otherwise("a")
    return customer(s, d).select("c_custkey", F.array_join(queues.appended(old, new), ",").alias("found"))


@query(f"select event_id from events where case when event_id % 7 > 0 then ts + (event_id % 5) * interval 1 day end <= timestamp '{AS_OF}'")
def st13_expired(s, d):
    until = F.when(c("event_id") % 7 > 0, c("ts") + F.make_dt_interval((c("event_id") % 5).cast("int")))
    return queues.expired(events(s, d).withColumn("until", until), "until", AS_OF).select("event_id")


@query(f"with l as (select user_id, arg_max(event_type, (ts, event_id)) last_type, max(ts) last_ts from events group by 1) select user_id, last_type, last_type <> 'click' and last_ts >= timestamp '{AS_OF}' - interval 24 hour unreplied from l")
def st14_reply_state(s, d):
    last = queues.last_of(events(s, d), "user_id", "ts", "event_id", ["event_type", "ts"])
    return last.select("user_id", c("event_type").alias("last_type"), ((c("event_type") != "click") & views.since("ts", AS_OF, "24 hours")).alias("unreplied"))


@query("with b as (select event_id, user_id, event_type, floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 30)::bigint bucket from events) select user_id, bucket, count(distinct event_id % 4) filter (event_type = 'purchase') promoters from b group by all having count(*) = 30")
def st4_promoters(s, d):
    from tidemark.operators import state

    rows = state.count_windows(events(s, d), "user_id", ["ts", "event_id"], 30)
    return rows.groupBy("user_id", "bucket").agg(F.countDistinct(F.when(c("event_type") == "purchase", c("event_id") % 4)).alias("promoters"), F.count("*").alias("n")).filter("n = 30").drop("n")


@query(f"{LEADS} select id, lead_score from leads where segment in ('BUILDING', 'MACHINERY') and (nation is null or nation % 3 > 0) and id not in (3, 5) order by lead_score desc, id limit 1")
def tk12_healthiest(s, d):
    rows = leads(s, d).withColumn("cool", F.when(c("nation") % 3 > 0, F.lit("2024-01-01")).otherwise(F.lit("2024-02-02")).cast("timestamp_ntz"))
    return queues.healthiest(rows, ["BUILDING", "MACHINERY"], "lead_score", "segment", "cool", [3, 5], "id", AS_OF).select("id", "lead_score")


@query(f"""{LEADS}, p as (select nation, segment, lead_score, id, id % 50 = 1 and nation % 2 > 0 and lead_score >= 30 first from leads)
    select nation, arg_max(id, (first::int, lead_score, -id)) id from p where nation is not null group by 1""")
def xt14_sessions(s, d):
    rows = leads(s, d).filter("nation is not null")
    first = F.coalesce((c("id") % 50 == 1) & (c("nation") % 2 > 0) & (c("lead_score") >= 30), F.lit(False))
    return rows.groupBy("nation").agg(F.max_by("id", F.struct(first, c("lead_score"), -c("id"))).alias("id"))


@query(f"with g as (select o_custkey source, count(*) n from orders where o_orderdate >= timestamp '2001-08-01' - interval 7 day group by 1) {LEADS.replace('with leads', ', leads')} select source, channel, n from g join leads on id = source order by n desc, source limit 20")
def tk5_growing(s, d):
    g = orders(s, d).filter("o_orderdate >= timestamp_ntz'2001-08-01' - interval 7 days").groupBy(c("o_custkey").alias("source")).agg(F.count("*").alias("n"))
    return views.top_k(g.join(leads(s, d).select(c("id").alias("source"), "channel"), "source"), [F.desc("n"), c("source")], 20)


@query(f"{LEADS} select id, channel, lead_score from leads where segment = 'BUILDING' and lead_score > 20 order by lead_score desc, id limit 30")
def tk6_marketplace(s, d):
    return views.top_k(leads(s, d).filter("segment = 'BUILDING' and lead_score > 20").select("id", "channel", "lead_score"), [F.desc("lead_score"), c("id")], 30)


@query(f"{LEADS}, m as (select o_custkey id, count(*) posts, count(*) filter (o_orderstatus = 'P') promos from orders group by 1) select id, channel, posts, promos from m join leads using (id) order by promos desc, posts desc, id limit 50")
def tk7_metrics(s, d):
    m = orders(s, d).groupBy(c("o_custkey").alias("id")).agg(F.count("*").alias("posts"), F.count_if(c("o_orderstatus") == "P").alias("promos"))
    return views.top_k(m.join(leads(s, d).select("id", "channel"), "id").select("id", "channel", "posts", "promos"), [F.desc("promos"), F.desc("posts"), c("id")], 50)


@query("with g as (select user_id, count(*) n, count(*) filter (value > 80) hq from events group by 1), t as (select * from g order by n desc, user_id limit 20) select (select round(100.0 * sum(hq) / (select sum(n) from g))::int from t) top_share, round(100.0 * sum(hq) / sum(n))::int all_share from g")
def xt2_share(s, d):
    g = events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(c("value") > 80).alias("hq"))
    total = g.agg(F.sum("n").alias("n"), F.sum("hq").alias("hq")).first()  # one row
    share = lambda hq: F.round(100.0 * hq / F.lit(total["n"])).cast("int")
    return g.orderBy(F.desc("n"), "user_id").limit(20).agg(share(F.sum("hq")).alias("top_share")).withColumn("all_share", share(F.lit(total["hq"])))


@query(f"{LEADS} select segment, count(*) filter (tier is not null) valid, count(*) filter (tier is null) invalid from leads join orders on o_custkey = id where o_orderstatus = 'F' group by 1")
def xt6_failed(s, d):
    j = orders(s, d).filter("o_orderstatus = 'F'").join(leads(s, d).select("id", "segment", "tier"), c("o_custkey") == c("id"))
    return j.groupBy("segment").agg(F.count_if(c("tier").isNotNull()).alias("valid"), F.count_if(c("tier").isNull()).alias("invalid"))


@query("""with e as (select event_id, case event_id % 5 when 0 then 'Username NOT occupied' when 1 then 'FLOOD wait 30' when 2 then 'Peer flood, privacy' when 3 then null else 'x' end msg, case event_id % 3 when 0 then 'FAILED' when 1 then 'failed' else 'sent' end st from events)
    select case when msg ilike '%flood%' and not msg ilike '%privacy%' then 'flood' when msg ilike '%privacy%' then 'privacy' when msg ilike '%not occupied%' then 'missing' else 'other' end kind, count(*) n from e where lower(st) in ('failed', 'error') group by 1""")
def xt7_errors(s, d):
    msg = F.expr("case event_id % 5 when 0 then 'Username NOT occupied' when 1 then 'FLOOD wait 30' when 2 then 'Peer flood, privacy' when 3 then null else 'x' end")
    rows = events(s, d).select(msg.alias("msg"), F.expr("case event_id % 3 when 0 then 'FAILED' when 1 then 'failed' else 'sent' end").alias("st")).filter(F.lower("st").isin("failed", "error"))
    return rows.groupBy(T.error_kind(c("msg")).alias("kind")).agg(F.count("*").alias("n"))


@query("with h as (select c_custkey, case c_custkey % 4 when 0 then 'ab' when 1 then 'ok_name' || c_custkey when 2 then 'bad-name' else 'näme' || c_custkey end h from customer) select c_custkey from h where length(h) < 4 or regexp_matches(h, '[^A-Za-z0-9_]')")
def xt9_invalid(s, d):
    h = F.expr("case c_custkey % 4 when 0 then 'ab' when 1 then concat('ok_name', c_custkey) when 2 then 'bad-name' else concat('näme', c_custkey) end")
    return customer(s, d).select("c_custkey", h.alias("h")).filter(T.invalid_handle(c("h"))).select("c_custkey")


@query(f"{LEADS}, a as (select o_custkey id, max(o_orderdate) late_at from orders group by 1) select id, 'inactive' reason from leads left join a using (id) where lead_score is not null and segment <> 'FURNITURE' and (late_at is null or late_at < timestamp '2001-08-01' - interval 14 day)")
def xt11_inactive(s, d):
    a = orders(s, d).groupBy(c("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("at"))
    late = c("at").isNull() | (c("at") < F.expr("timestamp_ntz'2001-08-01' - interval 14 days"))
    return leads(s, d).filter("lead_score is not null and segment <> 'FURNITURE'").join(a, "id", "left").filter(late).select("id", F.lit("inactive").alias("reason"))


@query(f"{LEADS} select id from leads where nation % 2 = 0 and (segment = 'FURNITURE' or lead_score < 40)")
def xt12_rejected_groups(s, d):
    return leads(s, d).filter("nation % 2 = 0 and (segment = 'FURNITURE' or lead_score < 40)").select("id")


@query(f"""{LEADS}, a as (select o_custkey id, max(o_orderdate) late_at from orders group by 1) select id from leads join a using (id)
    where late_at < timestamp '2001-08-01' - interval 1 day * case when nation % 2 = 0 then case when lead_score > 80 then 1 when lead_score > 50 then 3 else 7 end else case when lead_score > 80 then 3 when lead_score > 50 then 7 else 14 end end""")
def flt9_stale(s, d):
    a = orders(s, d).groupBy(c("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("at"))
    return leads(s, d).join(a, "id").filter(views.stale("at", c("lead_score"), c("nation") % 2 == 0, "2001-08-01 00:00:00")).select("id")


@query(f"""{DOCS} select doc_id from t join labels using (doc_id) where quality = 0 and length(text) > 200 and not regexp_matches(low, 'gold|forex') and not regexp_matches(text, '[؀-ۿ]') and doc_id not in (select item_id from benchmark) order by doc_id desc limit 200""")
def flt13_negatives(s, d):
    rows = _said(s, d).join(table(s, d, "labels"), "doc_id").filter("quality = 0 and length(text) > 200")
    rows = rows.filter(~F.lower("text").rlike("gold|forex") & ~c("text").rlike("[؀-ۿ]")).join(table(s, d, "benchmark").select(c("item_id").alias("doc_id")), "doc_id", "left_anti")
    return views.top_k(rows.select("doc_id"), [F.desc("doc_id")], 200)


@query(f"{EDGES} select target, array_to_string(list(source order by ts, seq)[1:3], ',') evidence from edges group by 1")
def wn4_evidence(s, d):
    return mining.first_rows(edges(s, d), "target", ["ts", "seq"], "source", 3).select("target", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("evidence"))


@query("""select event_id, json_extract(j, '$.k')::varchar k, json_extract(j, '$.n')::varchar n, json_extract(j, '$.z')::varchar z, json_extract(j, '$.o')::varchar o
    from (select event_id, json_merge_patch(props, case event_id % 3 when 0 then '{"k": 7, "n": 1.5, "z": true}' when 1 then '{"z": "q", "o": {"a": [1, "2"]}}' else '{}' end) j from events)""")
def js3_merge(s, d):
    other = F.when(c("event_id") % 3 == 0, '{"k": 7, "n": 1.5, "z": true}').when(c("event_id") % 3 == 1, '{"z": "q", "o": {"a": [1, "2"]}}').otherwise("no object")
    rows = events(s, d).select("event_id", F.parse_json(T.json_merge(c("props"), other)).alias("j"))
    return rows.select("event_id", *[F.to_json(F.try_variant_get("j", f"$.{k}", "variant")).alias(k) for k in "knzo"])


@query("with m as (select 'event_' || event_type || '_' || k.name \"name\", ts::date \"day\", k.name kind, value, k.ok from events, (values ('all', true), ('high', false)) k(name, ok)) select \"name\", \"day\", count(*) filter (ok or value > 50)::double \"value\" from m group by all")
def snk5_metrics(s, d):
    g = events(s, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("all"), F.count_if(c("value") > 50).alias("high"))
    return views.long_form(g, ["event_type", "day"], ["all", "high"], F.concat(F.lit("event_"), c("event_type"), F.lit("_"), c("metric"))).select("name", "day", "value")


_LM4 = ORACLES["lm4_contrast_all"]


def _labelled(s, d):
    """Labelled texts; the labels are broadcast only if a count proves them few, else a text counts as 20 rows when both sides are dealt."""
    labels, docs = table(s, d, "labels").select("doc_id", "quality"), documents(s, d).select("doc_id", "text")
    n = labels.count()
    if n <= 1_000_000:
        labels = F.broadcast(labels)
    else:
        rows = 20 * docs.count()
        labels, docs = spread(labels, rows, "doc_id"), spread(docs, rows, "doc_id")
    return docs.join(labels, "doc_id").select("doc_id", "text", (c("quality") == 1).alias("positive"))


@query(_LM4.replace("unnest(list_distinct(list_filter(w, lambda x: length(x) >= 3)))", "unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"))
def lm1_bigrams(s, d):
    return mining.contrast_levels(_labelled(s, d), "doc_id", T.tokens(c("text")), 2)


@query(_LM4.replace("unnest(list_distinct(list_filter(w, lambda x: length(x) >= 3)))", "unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"))
def lm1_trigrams(s, d):
    return mining.contrast_levels(_labelled(s, d), "doc_id", T.tokens(c("text")), 3)


@query(_LM4.replace("count(*) filter (p) df_pos", "count(*) filter (p and not regexp_matches(feature, 'tion|sch')) df_pos").replace("having count(*) filter (p) >= 2", "having count(*) filter (p and not regexp_matches(feature, 'tion|sch')) >= 2"))
def lm3_blocked(s, d):
    docs = documents(s, d).join(table(s, d, "labels"), "doc_id").select("text", (c("quality") == 1).alias("positive"))
    return mining.contrast(docs, T.tokens(c("text")), 1, blocked=("tion", "sch"))


_SIGNALS = """with s as (select p_partkey, case when p_size % 7 = 0 then 'negative_spam' when p_size > 30 then 'gold' when p_size > 10 then 'forex' end category,
        case p_size % 5 when 0 then 'active' when 1 then 'validated' when 2 then 'candidate' when 3 then 'deprecated' else 'observed' end status, case when p_size <> 8 then p_size / 10.0 - 2 end contrast,
        case p_partkey % 4 when 0 then 'keyword' when 1 then 'phrase' when 2 then 'symbol' else 'domain' end kind from part)"""


# only signals in use are read, whatever their category; of the negative and the candidate ones only keywords and phrases serve
@query(f"""{_SIGNALS}, u as (select * from s where status in ('active', 'validated', 'candidate'))
    select p_partkey, 'negative' part from u where (category = 'negative_spam' or contrast < -1) and kind in ('keyword', 'phrase')
    union all select p_partkey, 'active' from u where not coalesce(category = 'negative_spam', false) and coalesce(contrast, 0) >= -1 and status <> 'candidate'
    union all select p_partkey, 'candidate' from u where not coalesce(category = 'negative_spam', false) and coalesce(contrast, 0) >= -1 and status = 'candidate' and kind in ('keyword', 'phrase')""")
def lm8_model(s, d):
    size, key = c("p_size"), c("p_partkey") % 4
    status = F.when(size % 5 == 0, "active").when(size % 5 == 1, "validated").when(size % 5 == 2, "candidate").when(size % 5 == 3, "deprecated").otherwise("observed")
    rows = table(s, d, "part").select(
        "p_partkey", F.when(size % 7 == 0, "negative_spam").when(size > 30, "gold").when(size > 10, "forex").alias("category"), status.alias("status"),
        F.when(size != 8, size / 10.0 - 2).alias("contrast"), F.when(key == 0, "keyword").when(key == 1, "phrase").when(key == 2, "symbol").otherwise("domain").alias("kind"),
    )
    return mining.model_part(rows, "category", "status", "contrast", "kind").select("p_partkey", "part")


# a channel (nation) shows the names of its customers; features are found without case, the known ones are those of the first customers
@query("""with f as (select distinct c_nationkey channel, lower(c_mktsegment) || c_custkey % 30 "value" from customer), r as (select *, row_number() over (partition by channel order by "value") k from f),
    n as (select "value", count(*) n from r where k <= 15 and length("value") >= 10 group by 1),
    b as (select distinct lower(c_mktsegment) || c_custkey % 30 "value" from customer where c_custkey <= 40)
    select coalesce(n."value", b."value") "value", case when b."value" is null then 'negative_spam' else 'gold' end category, case when b."value" is null then 'active' else 'candidate' end status,
        case when b."value" is null then greatest(0.0, 0.1 - 0.15 * (n - 1)) else greatest(0.0, 0.5 - 0.15 * coalesce(n, 0)) end::double confidence,
        case when b."value" is null then -2.5 - 1.0 * (n - 1) else 1.0 - 1.0 * coalesce(n, 0) end::double contrast, case when b."value" is null then n else 2 + coalesce(n, 0) end negatives from n full join b on n."value" = b."value" """)
def lm11_rejections(s, d):
    value = F.concat(F.lower("c_mktsegment"), c("c_custkey") % 30).alias("value")
    known = customer(s, d).filter("c_custkey <= 40").select(value).distinct()
    known = known.select("value", F.lit("gold").alias("category"), F.lit("candidate").alias("status"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("contrast"), F.lit(2).cast("long").alias("negatives"))
    return mining.rejected(known, customer(s, d).select(c("c_nationkey").alias("channel"), value), "keyword", "channel", least_length=10)
