"""Registered queries of intake, names, resolution, claims and vertex merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import text as T
from tidemark.operators import intake
from tidemark.plans.catalog import AS_OF, EDGES, LEADS, c, customer, documents, edges, events, lineitem, orders, pages, query
from tidemark.sources.io import leads, spread, table


@query("select c_custkey from customer where lower(c_name) = lower('cUSTOMER#000000042') or lower(c_mktsegment) = 'machinery'")
def src2_lookup(s, d):
    return customer(s, d).filter((F.lower("c_name") == "customer#000000042") | (F.lower("c_mktsegment") == "machinery")).select("c_custkey")


_NAMES = "case c_custkey % 4 when 0 then 'Name' || c_custkey when 1 then 'https://x.org/NAME' || c_custkey when 2 then 'x.org/a/name' || c_custkey || ' ' else null end"


@query(f"""with r as (select c_custkey, lower(trim({_NAMES})) n from customer), b as (select lower('Host/nAme' || s_suppkey) e from supplier union all select 'name' || s_suppkey * 3 from supplier)
    select c_custkey from r where exists (select 1 from b where e = n or e = string_split(n, '/')[-1] or ends_with(e, '/' || string_split(n, '/')[-1]) or string_split(e, '/')[-1] = n)""")
def src3_blacklist(s, d):
    rows = customer(s, d).select("c_custkey", F.expr(_NAMES).alias("n"))
    sup = table(s, d, "supplier")
    black = sup.select(F.concat(F.lit("Host/nAme"), "s_suppkey").alias("e")).unionAll(sup.select(F.concat(F.lit("name"), c("s_suppkey") * 3)))
    return intake.listed(rows, "n", black, "e").select("c_custkey")


@query("select event_id from events where not coalesce(case when event_type = 'view' then true when event_type = 'error' then null else false end, false) order by ts, event_id limit 120")
def src5_seeds(s, d):
    done = F.when(c("event_type") == "view", True).when(c("event_type") == "error", F.lit(None)).otherwise(False)
    return intake.next_seeds(events(s, d).withColumn("processed", done), "processed", ["ts", "event_id"], 120).select("event_id")


@query("""with t as (select doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 2 and not regexp_full_match(t, '[0-9]+')))) w from documents),
    l as (select distinct lower(unnest(string_split_regex(text, '\\s+'))) w from benchmark where item_id % 4 = 0) select doc_id, count(*) n, array_to_string(list_sort(list(w)), ' ') terms from t semi join l using (w) group by 1""")
def jn13_tokens(s, d):
    lexicon = table(s, d, "benchmark").filter("item_id % 4 = 0").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    return intake.tokens_in(documents(s, d), "doc_id", T.tokens(c("text")), lexicon, "w").withColumn("terms", F.array_join("terms", " "))


@query("select event_id, c_name chat from events left join customer on c_custkey = user_id and c_custkey % 3 > 0")
def jn14_chats(s, d):
    chats = customer(s, d).filter("c_custkey % 3 > 0").select(c("c_custkey").alias("user_id"), c("c_name").alias("chat"))
    return events(s, d).join(chats, "user_id", "left").select("event_id", "chat")


@query(f"""{LEADS}, k as (select o_orderkey k from orders where o_orderstatus = 'P' order by o_orderdate desc, o_orderkey desc limit 1), done as (select distinct lower(c_name) n from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT' and o_totalprice > 250000)
    select id lead_id, k campaign_id from leads, k where channel is not null and lower(channel) not in (select n from done)""")
def jn15_enqueue(s, d):
    last = orders(s, d).filter("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey").first()  # one row
    sent = orders(s, d).filter("o_orderpriority = '1-URGENT' and o_totalprice > 250000").join(customer(s, d), c("c_custkey") == c("o_custkey")).select(F.lower("c_name").alias("n")).distinct()
    rows = leads(s, d).filter("channel is not null").join(sent, F.lower("channel") == c("n"), "left_anti")
    return rows.select(c("id").alias("lead_id"), F.lit(last[0] if last else None).cast("long").alias("campaign_id"))


@query("with w as (select p_partkey, case when p_partkey % 2 = 0 then upper(p_brand) else ' ' || lower(p_brand) end w from part) select p_partkey, w from w qualify row_number() over (partition by lower(trim(w)) order by p_partkey) = 1")
def set2_spellings(s, d):
    w = F.when(c("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit(" "), F.lower("p_brand")))
    return intake.first_spellings(table(s, d, "part").select("p_partkey", w.alias("w")), "w", ["p_partkey"])


_HANDLES = "case c_custkey % 8 when 0 then ' @name' || c_custkey || '!' when 1 then '__' || c_custkey || '__.' when 2 then '/a_b_' when 3 then '@ab' when 4 then repeat('x', (c_custkey % 50)::int) when 5 then '_ab_' when 6 then '' end"


@query(rf"""with h as (select c_custkey, regexp_replace(ltrim(ltrim(trim({_HANDLES}), '@'), '/'), '[.,;:)!?*~`"''/\\]+$', '') h from customer),
    r as (select c_custkey, case when length(rtrim(h, '_')) >= 3 then rtrim(h, '_') else h[1:greatest(3, length(rtrim(h, '_')))] end h from h),
    l as (select c_custkey, case when length(ltrim(h, '_')) >= 3 then ltrim(h, '_') when length(h) > 3 then h[-3:] else h end h from r)
    select c_custkey, case when length(h) between 3 and 35 then h end handle from l""")
def str14_handles(s, d):
    return customer(s, d).select("c_custkey", N.clean_handle(F.expr(_HANDLES.replace("(c_custkey % 50)::int", "cast(c_custkey % 50 as int)"))).alias("handle"))


@query("select distinct regexp_extract(url, 'https?://([^/]+)', 1) host from pages where regexp_matches(url, 'https?://')")
def str16_capture(s, d):
    return pages(s, d).filter(c("url").rlike("https?://")).select(F.regexp_extract("url", "https?://([^/]+)", 1).alias("host")).distinct()


@query("""select page_id, case when page_id % 3 = 0 then 'https://bing.com/ck/a?x=1' when page_id % 3 = 1 then url else url end target from pages""")
def str21_redirects(s, d):
    packed = F.concat(F.lit("https://www.bing.com/ck/a?!&&p=1&u=a1"), F.translate(F.regexp_replace(F.base64(F.encode("url", "UTF-8")), "[=\r\n]", ""), "+/", "-_"), F.lit("&ntb=1"))
    href = F.when(c("page_id") % 3 == 0, "https://bing.com/ck/a?x=1").when(c("page_id") % 3 == 1, packed).otherwise(c("url"))
    return pages(s, d).select("page_id", N.redirect_target(href, "bing.com/ck/a").alias("target"))


@query("""with l as (select page_id, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1) || ['HTTP://A.b/C', 'http://a.b/c', 'x.y/MyBot'], lambda x: not ends_with(lower(x), 'bot')) l from pages)
    select page_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ' ') links from l""")
def tx15_links(s, d):
    more = F.array(F.lit("HTTP://A.b/C"), F.lit("http://a.b/c"), F.lit("x.y/MyBot"))
    return pages(s, d).select("page_id", F.array_join(N.listed_once(F.concat(T.links(c("html")), more)), " ").alias("links"))


_JOBS = """case event_id % 4 when 0 then concat('{"id": "j', event_id, '", "payload": {"k": 1}}') when 1 then concat('{"channel": "c', event_id, '"}') when 2 then concat(' raw', event_id, ' ') else '{broken' end"""


@query("select event_id, case event_id % 4 when 0 then 'j' || event_id when 1 then 'c' || event_id when 2 then 'raw' || event_id else '{broken' end id, case event_id % 4 when 0 then '{\"k\":1}' when 1 then '{\"channel\": \"c' || event_id || '\"}' end payload from events")
def js4_payloads(s, d):
    return events(s, d).select("event_id", N.job_payload(F.expr(_JOBS)).alias("j")).select("event_id", "j.*")


@query("select event_id, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' j from events")
def js1_build(s, d):
    return events(s, d).select("event_id", F.to_json(F.struct("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("j"))


@query(f"""with o as (select user_id, max(event_id) mark, max(ts) marked_at from events where ts < timestamp '2024-01-10' group by 1), l as (select * from o where marked_at >= timestamp '{AS_OF}' - interval 21 day),
    n as (select user_id, max(event_id) mark, max(ts) marked_at from events where ts >= timestamp '2024-01-25' and user_id % 2 = 0 group by 1) select user_id, max(mark) mark, max(marked_at) marked_at from (select * from l union all select * from n) group by 1""")
def st2_marks(s, d):
    old = events(s, d).filter("ts < timestamp_ntz'2024-01-10'").groupBy("user_id").agg(F.max("event_id").alias("mark"), F.max("ts").alias("marked_at"))
    return intake.marks(old, events(s, d).filter("ts >= timestamp_ntz'2024-01-25' and user_id % 2 = 0"), "user_id", "event_id", "ts", AS_OF, 21)


@query("""with t as (select *, p_brand || ' ' || p_type v from part), k as (select distinct v, 0.9::double confidence, length(v)::bigint n from t where p_size > 10), f as (select v, count(*) n from t where p_size % 3 = 0 group by 1)
    select k.v "value", round(least(1.0::double, confidence + coalesce(f.n, 0) * 0.02::double), 9) confidence, k.n + coalesce(f.n, 0) discoveries from k left join f using (v)""")
def lm12_yields(s, d):
    part = table(s, d, "part").withColumn("value", F.concat("p_brand", F.lit(" "), "p_type"))
    known = part.filter("p_size > 10").select("value").distinct().select("value", F.lit(0.9).alias("confidence"), F.length("value").cast("long").alias("discoveries"))
    return intake.yields(known, part.filter("p_size % 3 = 0").select("value")).withColumn("confidence", F.round("confidence", 9))


@query("""with v as (select 'c' || c_custkey id, c_name "name", c_mktsegment platform, case when c_custkey % 2 = 0 then 'u' || c_custkey end url from customer),
    f0 as (select case when c_custkey % 3 = 0 then 'c' || c_custkey else 'x' || c_custkey end id, case when c_custkey % 3 = 1 then c_name else 'new' || c_custkey end "name", c_mktsegment platform, 'f' || c_custkey url from customer where c_custkey % 5 > 0),
    f as (select f0.*, coalesce(a.id, b.id) hit from f0 left join v a on a.id = f0.id left join v b on b."name" = f0."name" and b.platform = f0.platform)
    select v.id canonical_id, v."name", v.platform, coalesce(v.url, f.url) url from v left join f on f.hit = v.id union all select id, "name", platform, url from f where hit is null""")
def gr8_vertices(s, d):
    rows, k = customer(s, d), c("c_custkey")
    v = rows.select(F.concat(F.lit("c"), k).alias("canonical_id"), c("c_name").alias("name"), c("c_mktsegment").alias("platform"), F.when(k % 2 == 0, F.concat(F.lit("u"), k)).alias("url"))
    name = F.when(k % 3 == 1, c("c_name")).otherwise(F.concat(F.lit("new"), k))
    f = rows.filter("c_custkey % 5 > 0").select(F.concat(F.when(k % 3 == 0, "c").otherwise("x"), k).alias("canonical_id"), name.alias("name"), c("c_mktsegment").alias("platform"), F.concat(F.lit("f"), k).alias("url"))
    return intake.ensure_vertices(v, f)


@query(f"""{EDGES}, e as (select source, target, relation, max(confidence) confidence, count(*) occurrences from edges where confidence > 30 group by all), l as (select distinct source, target, relation from edges where confidence < 10)
    select * from e union all select source, target, relation, 100, 1 from l where (source, target, relation) not in (select (source, target, relation) from e)""")
def gr10_sync(s, d):
    e, n, key = edges(s, d), lineitem(s, d).count(), ["source", "target", "relation"]
    # dealt once by the whole key, which the groups, the distinct rows and the join share
    now = spread(e.filter("confidence > 30"), n, *key).groupBy(*key).agg(F.max("confidence").alias("confidence"), F.count("*").alias("occurrences"))
    return intake.sync_edges(now, spread(e.filter("confidence < 10").select(*key), n, *key))


@query(f"""{LEADS} select o_orderkey id from orders join leads on leads.id = o_custkey where o_orderstatus = 'P'
    order by case coalesce(tier, left('P' || (o_orderkey % 7), 2)) when 'P0' then 0 when 'P1' then 1 when 'P2' then 2 when 'P3' then 3 when 'P4' then 4 else 5 end, coalesce(case when lead_score > 20 then lead_score end, 25) desc,
    case when o_orderkey % 3 > 0 then o_orderdate end desc nulls last, o_orderkey % 4, o_totalprice, o_orderkey limit 40""")
def tk11_claims(s, d):
    rows = orders(s, d).filter("o_orderstatus = 'P'").join(leads(s, d), c("id") == c("o_custkey")).select(
        c("o_orderkey").alias("id"), c("tier").alias("lead_priority"), F.concat(F.lit("P"), c("o_orderkey") % 7).alias("priority"), F.when(c("lead_score") > 20, c("lead_score")).alias("lead_score"), F.lit(None).cast("int").alias("score"),
        F.when(c("o_orderkey") % 3 > 0, c("o_orderdate")).alias("commercial_last_seen"), F.lit(None).cast("timestamp_ntz").alias("intent_detected_at"), (c("o_orderkey") % 4).alias("attempts"), c("o_totalprice").alias("created_at"))
    return intake.claim_order(rows, 40).select("id")


@query(f"""with r as (select c_custkey id, case c_custkey % 9 when 0 then 'invite_' when 1 then 'admin_' else 'x' end || c_custkey "name", case c_custkey % 7 when 0 then 'Blacklisted entity: y' when 1 then null else 'fine' end about, case when c_mktsegment = 'FURNITURE' then 'rejected' else 'new' end status,
        nullif(c_nationkey % 5, 4) depth, case when c_custkey % 4 > 0 then timestamp '2024-01-30' - (c_custkey % 11) * interval 1 day end last_scan, floor(c_acctbal / 100)::int score, case c_nationkey % 6 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' end tier,
        case c_nationkey % 3 when 0 then 'unknown' when 1 then 'gold' end category, nullif(c_custkey % 60, 7)::int intent from customer)
    select id from r where status <> 'rejected' and "name" not like 'invite@_%' escape '@' and "name" not like 'admin@_%' escape '@' and (about is null or (about not like 'Blacklisted entity%' and about not like 'Entity does not exist%'))
        and (depth is null or depth < 3) and (last_scan is null or last_scan < timestamp '{AS_OF}' - interval 3 day) and (coalesce(score, 0) >= 40 or tier in ('A', 'B', 'C') or (category is not null and category <> 'unknown') or intent >= 35)
    order by coalesce(score, 0) desc, case tier when 'A' then 1 when 'B' then 2 when 'C' then 3 else 4 end, last_scan nulls first, id limit 60""")
def flt12_expansion(s, d):
    k, n = c("c_custkey"), c("c_nationkey")
    rows = customer(s, d).select(
        k.alias("id"), F.concat(F.when(k % 9 == 0, "invite_").when(k % 9 == 1, "admin_").otherwise("x"), k).alias("name"), F.when(k % 7 == 0, "Blacklisted entity: y").when(k % 7 > 1, "fine").alias("about"),
        F.when(c("c_mktsegment") == "FURNITURE", "rejected").otherwise("new").alias("status"), F.nullif(n % 5, F.lit(4)).alias("depth"),
        F.when(k % 4 > 0, F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((k % 11).cast("int"))).alias("last_scan"), F.floor(c("c_acctbal") / 100).cast("int").alias("score"),
        F.when(n % 6 == 0, "A").when(n % 6 == 1, "B").when(n % 6 == 2, "C").when(n % 6 == 3, "D").alias("tier"), F.when(n % 3 == 0, "unknown").when(n % 3 == 1, "gold").alias("category"), F.nullif((k % 60).cast("int"), F.lit(7)).alias("intent"))
    return intake.expansion_candidates(rows, AS_OF, 3, 60).select("id")


@query("""select user_id, round(sum(value), 4) confidence, array_to_string(list_sort(list(distinct event_type)), ',') reasons, count(distinct event_id % 7) channels, array_to_string(list(event_id order by ts, event_id)[1:3], ',') snippets from events group by 1""")
def ag22_miner(s, d):
    rows = events(s, d).withColumn("channel", c("event_id") % 7)
    found = intake.mined_contacts(rows, "user_id", "value", "event_type", "channel", "event_id", ["ts", "event_id"])
    return found.select("user_id", F.round("confidence", 4).alias("confidence"), F.array_join("reasons", ",").alias("reasons"), "channels", F.array_join(F.transform("snippets", lambda x: x.cast("string")), ",").alias("snippets"))
