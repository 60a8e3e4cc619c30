"""Registered queries of rescoring, handle mining, search templates, checkpoints and clipped texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import commercial as K
from tidemark.functions import relevance as R
from tidemark.functions.text import clip
from tidemark.operators import intake, rescore
from tidemark.plans.catalog import c, documents, events, query
from tidemark.plans.commercial import _word
from tidemark.plans.relevance import _n_words
from tidemark.sources.io import table

NAME = "concat(source, '_', lang)"


@query(f"""with recursive l as (select row_number() over (order by source, lang) id, source || '_' || lang "name", source, lang, count(*) n from documents where source is not null and lang is not null group by source, lang),
    r as (select *, row_number() over (partition by source, lang order by doc_id desc) r from documents),
    p as (select source || '_' || lang "name", string_agg(text, ' \n ' order by doc_id desc) filter (coalesce(text, '') <> '') body from r where r <= 10 group by 1),
    t as (select l.*, lang in ('fr', 'de') grp, lower(l."name" || ' ' || case when n % 3 = 0 then 'the que' else '' end || ' ' || coalesce(body, '')) low from l left join p on p."name" = l."name"),
    h as (select *, low text, {_n_words('casino')} = 0 and {_n_words('the')} + {_n_words('les')} + {_n_words('der')} + {_n_words('que')} > 0 and {_n_words('of')} + {_n_words('to')} + {_n_words('und')} + {_n_words('en')} >= case when grp then 5 else 3 end fit from t),
    g as (select *, {' + '.join(map(_word, ['the', 'que', 'der']))} core, {' + '.join(map(_word, ['to', 'of', 'und', 'en']))} signals, 10 * regexp_matches(low, 'vip|funded')::int + 10 * contains(low, 'sch')::int biz from h),
    i as (select *, case when core > 0 and signals > 0 then least(100, least(40, core * 10) + least(30, signals * 5) + biz + case when n % 2 = 0 then 7 else 0 end) else 0 end intent from g),
    w as (select *, least(100, least(15, (select count(*) from documents d where d.source = i.source and d.lang = i.lang and d.doc_id % 2 = 0)) + case when n * 2000 > 50000 then 10 when n * 2000 > 20000 then 7 when n * 2000 > 5000 then 4 else 0 end
        + least(10, 2 * (select count(*) from documents d join labels b on b.doc_id = d.doc_id where d.source = i.source and d.lang = i.lang and quality = 1)) + case when n % 2 = 0 then 15 else 0 end + case when n % 3 > 0 then 15 else 0 end + case when lang = 'en' then 15 else 0 end) weight from i where n % 7 <> 3 and n % 11 <> 5),
    x as (select *, case when grp then fit and intent >= 35 and n * 8 >= 50 else fit and intent >= 40 and weight >= 50 end ok from w),
    y as (select *, case when not ok then 0 when grp then case when n % 2 = 0 then n * 9 % 101 else 50 end else weight end score from x)
    select "name" username, case when ok then 'new' else 'rejected' end status, score::int score, case when ok and score >= 75 then 'Tier_A' when ok and score >= 50 then 'Tier_B' when ok and score >= 25 then 'Tier_C' else 'Tier_D' end tier, intent from y""")
def xt13_rescored(s, d):
    """Sources by language as channels, their documents as posts, counts and labels as keywords and links."""
    docs = documents(s, d).filter("source is not null and lang is not null").withColumn("username", F.expr(NAME))
    n = c("n")
    leads = docs.groupBy("username", "lang").agg(F.count("*").alias("n")).select(
        c("username").alias("id"), "username", "n", "lang", F.when(n % 3 == 0, "the que").otherwise("").alias("description"), c("lang").isin("fr", "de").alias("is_group"),
        F.when(n % 7 == 3, "rejected").otherwise("new").alias("status"), F.when(n % 11 != 5, F.lit(1)).alias("last_scan"), (n * 8).alias("script_score"))
    texts = rescore.newest_texts(docs, "username", "text", [c("doc_id")], 10)
    keywords = docs.filter("doc_id % 2 = 0").select(c("username").alias("channel"), F.lit(1).alias("frequency"))
    edges = docs.join(table(s, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").select(c("username").alias("target"))
    metrics = leads.filter("n % 2 = 0").select(c("id").alias("group_id"), (n * 9 % 101).alias("marketplace_score"))
    gate = lambda t, g: R.niche_gate(t, g, ["casino"], ["the", "les", "der", "que"], ["of", "to", "und", "en"])
    wants = lambda t: K.intent_score(K.distinct_words(t, ["the", "que", "der"]), K.distinct_words(t, ["to", "of", "und", "en"]), [K.has_any(t, ["vip", "funded"]), K.has_any(t, ["sch"])], n % 2 == 0, n % 2 == 0, F.lit(False), F.lit(0))
    weigh = lambda words, degree: R.weighted_score(words, n * 2000, degree, {"website": n % 2 == 0, "contact": n % 3 > 0, "arabic": c("lang") == "en"})["score"]
    out = rescore.rescore(leads, texts, keywords, edges, metrics, gate, wants, weigh)
    return out.withColumnRenamed("id", "username")


_MINED = """with r as (select doc_id, source, case doc_id % 4 when 0 then '@Mega_Ads' || doc_id % 50 when 1 then 'plain' || doc_id % 5 when 2 then 'exchange_bot' end contact,
    case doc_id % 6 when 0 then 'for ads: @Buyer_' || doc_id % 30 || E'\\n  for promotion - t.me/promo' || doc_id % 7 when 1 then 'see @media' || doc_id % 9 || ' and @nobody and @joinchat, ads manager » adsbot' when 2 then 'tell @helper_bot for ads @x' else '' end || ' ' || coalesce(text, '') body from documents),
    m as (select doc_id, source, body, lower(unnest(regexp_extract_all(body, '(?:for ads?|for promotion|ads manager)[\\s:\\-»>]+(?:@|https?://t\\.me/|t\\.me/)?([a-zA-Z0-9_]{4,32})', 1, 'i'))) handle, 'introduced' reason, 25 confidence from r
        union all select doc_id, source, body, lower(h), 'named', 15 from (select *, unnest(regexp_extract_all(body, '(?:@|https?://t\\.me/|t\\.me/)([a-zA-Z0-9_]{4,32})', 1, 'i')) h from r) where regexp_full_match(h, '[a-zA-Z0-9_]*(?:ads?|exchange|promo|media|buyer)[a-zA-Z0-9_]*', 'i')
        union all select doc_id, source, body, lower(ltrim(contact, '@')), 'contact', 30 from r where regexp_full_match(ltrim(contact, '@'), '[a-zA-Z0-9_]*(?:ads?|exchange|promo|media|buyer)[a-zA-Z0-9_]*', 'i')),
    k as (select *, trim(regexp_replace(body, '\\s+', ' ', 'g')) b from m where handle not in ('joinchat', 'admin') and (not ends_with(handle, 'bot') or regexp_matches(handle, 'ad|exchange|promo|media|buyer')))
    select handle, sum(confidence)::bigint confidence, array_to_string(list_sort(list(distinct reason)), ',') reasons, count(distinct source) channels, array_to_string(list(left(b, 160) order by doc_id, reason)[1:3], '|') snippets from k group by 1"""


@query(_MINED)
def tx23_handles(s, d):
    k, text = c("doc_id"), lambda x: x.cast("string")
    body = (
        F.when(k % 6 == 0, F.concat(F.lit("for ads: @Buyer_"), text(k % 30), F.lit("\n  for promotion - t.me/promo"), text(k % 7)))
        .when(k % 6 == 1, F.concat(F.lit("see @media"), text(k % 9), F.lit(" and @nobody and @joinchat, ads manager » adsbot"))).when(k % 6 == 2, F.lit("tell @helper_bot for ads @x")).otherwise("")
    )
    contact = F.when(k % 4 == 0, F.concat(F.lit("@Mega_Ads"), text(k % 50))).when(k % 4 == 1, F.concat(F.lit("plain"), text(k % 5))).when(k % 4 == 2, "exchange_bot")
    rows = documents(s, d).select("doc_id", "source", contact.alias("contact"), F.concat(body, F.lit(" "), F.coalesce("text", F.lit(""))).alias("body"))
    link = r"(?:@|https?://t\.me/|t\.me/)"
    found = rescore.handle_mentions(
        rows, "source", "body", ["doc_id"], [rf"(?:for ads?|for promotion|ads manager)[\s:\-»>]+{link}?([a-zA-Z0-9_]{{4,32}})"], rf"{link}([a-zA-Z0-9_]{{4,32}})",
        r"^[a-zA-Z0-9_]*(?:ads?|exchange|promo|media|buyer)[a-zA-Z0-9_]*$", {"introduced": ("introduced", 25), "mention": ("named", 15), "contact": ("contact", 30)}, ("joinchat", "admin"), "contact")
    out = intake.mined_contacts(found, "handle", "confidence", "reason", "channel", "snippet", ["doc_id", "reason"])
    return out.select("handle", "confidence", F.array_join("reasons", ",").alias("reasons"), "channels", F.array_join("snippets", "|").alias("snippets"))


@query("""with s as (select p_name seed, min(p_partkey) k from part where p_name is not null group by 1), t as (select unnest(range(4)) i),
    q as (select 'tiktok' platform, seed, k, i, case i when 0 then '"' || seed || '" site:example.com/@' when 1 then 'site:example.com/tag/' || replace(seed, ' ', '') when 2 then seed || ' trading' end "query" from s, t where i < 3
        union all select 'web', seed, k, i, '"' || seed || '" community' from s, t where i = 0 union all select 'else', seed, k, i, seed || ' trading forex' from s, t where i = 0)
    select platform, seed, "query" from (select *, row_number() over (partition by platform order by k, i) r from q) where r <= 50""")
def str19_queries(s, d):
    seeds = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    templates = {"tiktok": ['"{seed}" site:example.com/@', "site:example.com/tag/{joined}", "{seed} trading"], "web": ['"{seed}" community']}
    made = [intake.search_queries(seeds, "p_name", ["k"], templates, ["{seed} trading forex"], p) for p in ("tiktok", "web", "else")]
    return made[0].unionAll(made[1]).unionAll(made[2])


@query("""with l as (select *, case when event_type = 'error' then 'reset' else 'save' end kind, case when event_type = 'purchase' then 'completed' else 'in_progress' end status from events),
    z as (select user_id, max(case when kind = 'reset' then event_id end) r, max(case when kind = 'save' then event_id end) k from l where user_id % 3 > 0 or event_id % 5 = 0 group by 1)
    select z.user_id, case when coalesce(r > k, false) or status <> 'in_progress' then 0 else l.event_id % 1000 end offset_id, case when coalesce(r > k, false) or status <> 'in_progress' then 1 else (l.event_id % 7)::int end page_number, case when coalesce(r > k, false) then 'reset' else status end status, case when coalesce(r > k, false) then r else k end changed
    from z join l on l.event_id = k""")
def st12_checkpoints(s, d):
    kind = F.when(c("event_type") == "error", "reset").otherwise("save")
    log = events(s, d).filter("user_id % 3 > 0 or event_id % 5 = 0").select("user_id", "event_id", kind.alias("kind"), F.when(c("event_type") == "purchase", "completed").otherwise("in_progress").alias("status"), (c("event_id") % 1000).alias("offset_id"), (c("event_id") % 7).cast("int").alias("page_number"))
    saved = intake.checkpoints(log, ["user_id"], "kind", ["offset_id", "page_number"], ["event_id"])
    return intake.resume_point(saved, {"offset_id": F.lit(0).cast("long"), "page_number": F.lit(1)}).withColumn("changed", c("changed.event_id"))


@query("select doc_id, left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 160) snippet, left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1000) evidence from documents")
def str15_clipped(s, d):
    return documents(s, d).select("doc_id", clip(c("text"), 160).alias("snippet"), clip(c("text"), 1000).alias("evidence"))
