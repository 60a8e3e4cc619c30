"""Registered queries over messages: contacts, links, labels, routes, connector health and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import messages as M
from tidemark.operators import state
from tidemark.plans.catalog import EDGES, LEADS, c, customer, documents, events, pages, query
from tidemark.sources.io import edges, leads


@query(r"""with u as (select page_id, rtrim(regexp_extract(url, 'https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,6}[^\s]*)', 1, 'i'), '.,;)!}"''') u from pages) select page_id, case when u <> '' then 'https://' || u end website from u""")
def tx5_websites(s, d):
    return pages(s, d).select("page_id", M.websites(c("url"))["website"].alias("website"))


@query(r"select c_custkey, lower(nullif(regexp_extract('Mail ' || replace(c_name, '#', '.') || '@' || c_mktsegment || '.COM, or a@b', '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'), '')) email from customer")
def tx6_email(s, d):
    text = F.concat(F.lit("Mail "), F.replace(c("c_name"), F.lit("#"), F.lit(".")), F.lit("@"), c("c_mktsegment"), F.lit(".COM, or a@b"))
    return customer(s, d).select("c_custkey", M.email(text).alias("email"))


_CALLS = "concat(coalesce(text, ''), case doc_id % 6 when 0 then concat(' wa.me/96650000', 1000 + doc_id) when 1 then concat(' Phone: +44 20 7946-0', 100 + doc_id) when 2 then concat(' call +44 20 7946-0', 100 + doc_id) when 3 then ' phone 12 34' else '' end)"


@query(r"""with p as (select doc_id, coalesce(text, '') || case doc_id % 6 when 0 then ' wa.me/96650000' || 1000 + doc_id when 1 then ' Phone: +44 20 7946-0' || 100 + doc_id when 2 then ' call +44 20 7946-0' || 100 + doc_id when 3 then ' phone 12 34' else '' end text from documents),
f as (select doc_id, nullif(regexp_extract(text, '(?:wa\.me/|api\.whatsapp\.com/send\?phone=|whatsapp:)\+?([0-9]{9,16})', 1, 'i'), '') direct,
    case when regexp_matches(lower(text), 'واتس|whatsapp|هاتف|phone') then regexp_replace(regexp_extract(text, '\+?(?:966|971|965|968|973|962|961|963|967|964|20|90|44|1)[0-9\s-]{7,15}'), '[\s+-]', '', 'g') end loose from p)
select doc_id, coalesce(direct, case when length(loose) >= 8 then loose end) number, case when direct is not null then 100 when length(loose) >= 8 then 85 end confidence from f""")
def tx7_phone(s, d):
    return documents(s, d).select("doc_id", M.phone(F.expr(_CALLS)).alias("p")).select("doc_id", "p.number", "p.confidence")


@query(r"""with t as (select page_id, 'telegram:chan' || page_id % 9 self, url || ' t.me/Chan' || page_id % 10 || ' T.ME/joinchat/abc' || page_id % 3 || 'bot https://tiktok.com/@user' || page_id % 7 || ' https://www.facebook.com/groups/g' || page_id % 5 || ' ' || html text from pages),
n as (select page_id, self, 'telegram' platform, 95 confidence, 'link' relation, lower(unnest(regexp_extract_all(text, '(?:https?://)?(?:t\.me|telegram\.me)/(?:joinchat/)?\+?([a-zA-Z0-9_.-]{4,32})', 1, 'i'))) name from t
  union all select page_id, self, 'tiktok', 95, 'social_link', lower(unnest(regexp_extract_all(text, '(?:https?://)?(?:www\.)?tiktok\.com/@([a-zA-Z0-9_.-]{2,32})', 1, 'i'))) from t
  union all select page_id, self, 'facebook', 95, 'social_link', lower(unnest(regexp_extract_all(text, '(?:https?://)?(?:www\.|m\.)?facebook\.com/(?:pages/|groups/)?([a-zA-Z0-9_.-]{3,64})', 1, 'i'))) from t
  union all select page_id, self, 'web', 90, 'external_site', split_part(lower(unnest(regexp_extract_all(text, 'https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+/[a-zA-Z0-9_.~!*''();:@&=+$,/?%#-]*|[a-zA-Z0-9-]+\.[a-zA-Z]{2,})', 1, 'i'))), '/', 1) from t)
select distinct page_id, platform || ':' || name target, platform, relation, confidence from n where platform || ':' || name <> self
  and (platform <> 'telegram' or not ends_with(name, 'bot')) and (platform <> 'tiktok' or (length(name) >= 3 and name <> 'user6')) and (platform <> 'facebook' or length(name) >= 3)
  and (platform <> 'web' or (length(name) >= 4 and not regexp_matches(name, 't\.me|telegram\.me|tiktok\.com|facebook\.com|wa\.me|whatsapp\.com|(^|\.)example\.net$')))""")
def tx9_cross_links(s, d):
    n = lambda k: (c("page_id") % k).cast("string")
    text = F.concat(c("url"), F.lit(" t.me/Chan"), n(10), F.lit(" T.ME/joinchat/abc"), n(3), F.lit("bot https://tiktok.com/@user"), n(7), F.lit(" https://www.facebook.com/groups/g"), n(5), F.lit(" "), c("html"))
    rows = pages(s, d).select("page_id", text.alias("text"))
    return M.cross_links(rows, "page_id", "text", F.concat(F.lit("telegram:chan"), n(9)), ("user6",), ("example.net",))


@query(f"{EDGES}, k as (select source, target, relation = 'R' link, evidence = 'F' promo, case when relation = 'R' then seq else -seq end o from edges) select source, target, arg_max(case when promo then 'advertisement' when link then 'link' else 'mention' end, (link, o, promo)) as \"label\" from k group by 1, 2")
def tx13_labels(s, d):
    kind = F.when(c("relation") == "R", "link").otherwise("mention")
    return M.label_references(edges(s, d), "source", "target", kind, c("seq"), c("evidence") == "F")


@query("""select event_id, case when event_type in ('purchase', 'click', 'signup') or user_id % 10 = 0 then 'critical' when value > 50 or event_type = 'error' then 'high' else 'normal' end queue,
case when event_type in ('purchase', 'signup') and not (event_type = 'signup' and value > 80) then 'ad_exchange_feedback' when event_type = 'click' or (event_type = 'signup' and value > 80) then 'ad_copywriting_pattern' when user_id % 10 = 0 then 'verified_partner' when event_type = 'error' then 'advertisement' else 'channel_mention' end method,
case when event_type = 'purchase' then 30 when event_type = 'click' or (event_type = 'signup' and value > 80) then 25 when event_type = 'signup' then 30 end weight from events""")
def tx14_routes(s, d):
    kind, big = c("event_type"), c("value")
    r = M.route((kind == "click") | ((kind == "signup") & (big > 80)), kind == "purchase", kind == "signup", c("user_id") % 10 == 0, big > 50, F.when(kind == "error", "advertisement"))
    return events(s, d).select("event_id", r.alias("r")).select("event_id", "r.*")


@query("""with k as (select user_id, ts, event_type, row_number() over w i, max(case when event_type = 'purchase' then event_id end) over w last_ok, count(*) filter (event_type = 'purchase') over w runs from events window w as (partition by user_id order by ts, event_id)),
n as (select *, row_number() over (partition by user_id, runs, event_type <> 'purchase' order by i) f from k),
e as (select *, case when event_type = 'purchase' then 'HEALTHY' when event_type = 'error' then 'RATE_LIMITED' when f >= 3 then 'DEGRADED' end st from n)
select user_id, coalesce(arg_max(st, i) filter (st is not null), 'HEALTHY') status, case when arg_max(event_type, i) = 'purchase' then 0 else arg_max(f, i) end::int failures, max(ts) filter (event_type = 'error') + interval 300 second cool_until from e group by 1""")
def sm9_connectors(s, d):
    kind = F.when(c("event_type") == "purchase", "success").when(c("event_type") == "error", "rate_limit").otherwise("failure")
    return state.connector_health(events(s, d).withColumn("kind", kind), "user_id", "ts", "event_id", "kind")


@query(f"{LEADS} select id, case when nation = 3 then 'BLOCKED_BY_KILL_SWITCH' when lead_score < -5 then 'OUTREACH_DISABLED' when segment = 'MACHINERY' then 'SECURITY_VIOLATION' when tier is null then 'APPROVAL_REQUIRED' when tier = 'P0' then 'DRY_RUN' when ends_with(channel, '7') then 'INVALID_TARGET' else 'ALLOWED' end reason from leads")
def sm11_gate(s, d):
    target = F.when(c("channel").endswith("7"), F.concat(F.lit("@x"), c("channel"), F.lit("Bot"))).otherwise(c("channel"))
    gate = state.safety_gate(c("nation") == 3, c("lead_score") >= -5, c("segment") != "MACHINERY", F.when(c("tier").isNotNull(), "approved"), c("tier") == "P0", target)
    return leads(s, d).select("id", gate.alias("reason"))


@query("""select event_id, case when event_type <> 'view' then case when user_id % 3 > 0 then user_id::varchar when user_id % 2 = 0 then 's' || user_id end end channel_id,
case when event_type <> 'view' then case when event_type = 'error' then 'chat' || user_id % 5 when user_id % 4 = 0 then 'nick' when user_id % 4 = 1 then 'from_' || user_id end end username, case when event_type <> 'view' then ts end observed_at from events""")
def tx11_forwards(s, d):
    text, no = (lambda x: F.concat(F.lit(x), c("user_id"))), F.lit(None)
    u = c("user_id")
    parts = {
        "from_id": F.struct(F.when(u % 3 > 0, u.cast("string")).alias("channel_id"), no.cast("string").alias("user_id"), no.cast("string").alias("chat_id")),
        "saved_from_peer": F.struct(F.when(u % 2 == 0, text("s")).alias("channel_id")), "channel_post": no.cast("bigint"), "saved_from_msg_id": c("event_id"),
        "from_name": F.when(u % 4 == 1, text("see t.me/from_")), "from_username": F.when(u % 4 == 0, "@nick"), "chat_username": F.when(c("event_type") == "error", F.concat(F.lit("chat"), u % 5)), "date": c("ts"),
    }
    header = F.when(c("event_type") != "view", F.struct(*[v.alias(k) for k, v in parts.items()]))
    return events(s, d).select("event_id", M.forward_origin(header, c("event_id")).alias("o")).select("event_id", "o.channel_id", "o.username", "o.observed_at")
