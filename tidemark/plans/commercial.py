"""Registered queries of the text-fed scorecards and of eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import commercial as K
from tidemark.operators.eligibility import eligibility
from tidemark.plans.catalog import LEADS, ORACLES, c, customer, documents, orders, query
from tidemark.plans.scored import _DAYS, _USERS, user_days, users
from tidemark.sources.io import leads

CORE, SIGNALS, VIP, MANAGED = ["the", "and", "que", "der"], ["to", "of", "les", "und", "en"], ["tion", "vip"], ["sch"]


def _word(t: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^A-Za-z0-9_؀-ۿ]){t}($|[^A-Za-z0-9_؀-ۿ])')::int"


@query(f"""with h as (select doc_id, {' + '.join(map(_word, CORE))} core, {' + '.join(map(_word, SIGNALS))} signals, 10 * regexp_matches(lower(text), 'tion|vip')::int + 10 * contains(lower(text), 'sch')::int biz,
4 * contains(text, 'a')::int + 3 * contains(text, 'b')::int + 3 * (lang = 'en')::int trust, case when lang = 'de' then 5 else 0 end bonus from (select doc_id, lang, coalesce(text, '') text from documents))
select doc_id, case when core > 0 and signals > 0 then least(100, least(40, core * 10) + least(30, signals * 5) + biz + trust + bonus) else 0 end score from h""")
def sc17_intent(s, d):
    t = c("text")
    # the words are columns of their own, as the score asks for them more than once
    rows = documents(s, d).select("doc_id", "lang", K.distinct_words(t, CORE).alias("core"), K.distinct_words(t, SIGNALS).alias("signals"), K.has_any(t, VIP).alias("vip"), K.has_any(t, MANAGED).alias("managed"), t.contains("a").alias("a"), t.contains("b").alias("b"))
    score = K.intent_score(c("core"), c("signals"), [c("vip"), c("managed")], c("a"), c("b"), c("lang") == "en", F.when(c("lang") == "de", 5))
    return rows.select("doc_id", score.alias("score"))


@query(ORACLES["sc17_intent"])
def sc17_intent_all(s, d):
    return sc17_intent(s, d)


@query(f"with {_USERS} select user_id, case when k % 2 = 0 then 20 else 0 end + case when v % 3 = 0 then 20 else 0 end + trunc(s / m * 40)::int + case when p > 3 or e > 4 or (d > 0 and (k % 2 = 0 or v % 3 = 0)) then 20 else 0 end score from u")
def sc18_arabic(s, d):
    word = lambda hit: F.when(hit, "ذهب").otherwise("gold")
    return users(s, d).select("user_id", K.arabic_score(word(c("k") % 2 == 0), word(c("v") % 3 == 0), c("s"), c("m"), c("p") > 3, c("e") > 4, c("d") > 0).alias("score"))


@query("with k as (select c_custkey, coalesce(c_mktsegment, '') seg, coalesce(c_nationkey, -1) nat from customer) select c_custkey, least(100, 20 * (seg in ('BUILDING', 'MACHINERY') or nat = 1)::int + 20 * (seg = 'HOUSEHOLD' or nat = 2)::int + 40 * (nat = 1)::int + 40 * (nat = 2)::int) score from k")
def sc19_region(s, d):
    rows = customer(s, d)
    phone = F.concat(F.lit("+"), c("c_nationkey"), F.lit("-555"))
    return rows.select("c_custkey", K.region_score(c("c_mktsegment"), phone, {"one": (["building", "machin"], "+1-"), "two": (["house"], "+2-")}).alias("score"))


@query(f"{LEADS}, x as (select id, case when lead_score >= 60 then 25 when lead_score >= 30 then 15 when lead_score >= 10 then 5 else 0 end + case when id * 10 >= 10000 then 25 when id * 10 >= 3000 then 20 when id * 10 >= 1000 then 15 when id * 10 >= 300 then 10 when id * 10 >= 50 then 5 else 0 end + case when tier is not null then 20 else 0 end + case segment when 'BUILDING' then 8 when 'MACHINERY' then 6 when 'HOUSEHOLD' then 4 when 'FURNITURE' then 2 else 0 end + case when nation < 12 then 10 else 0 end score from leads) select id, score, case when score >= 75 then 'Tier 1' when score >= 50 then 'Tier 2' when score >= 30 then 'Tier 3' else 'Unqualified' end tier from x")
def sc23_legacy(s, d):
    of = lambda name: c("segment") == name
    card = K.legacy_score(c("id") * 10, c("lead_score") / 100, c("tier").isNotNull(), of("BUILDING"), of("MACHINERY"), of("HOUSEHOLD"), of("FURNITURE"), c("nation") < 12)
    return leads(s, d).select("id", card.alias("x")).select("id", "x.*")


_MODELS = f"""{_DAYS}, f as (select *, k >= 2 a, e >= 2 b, p >= 2 g, s >= 2 i, v >= 2 j from u),
x as (select *, a::int + b::int + g::int + i::int + j::int models, least(20, 12 * a::int + 10 * b::int + 10 * g::int + 8 * i::int + 8 * j::int) model_score from f),
y as (select *, least(35, case when p >= 3 or (models >= 1 and p >= 1) then 15 when p >= 1 then 10 else 0 end + case when k >= 2 or (s = 1 and models >= 1) then 10 when k >= 1 then 6 else 0 end + case when e > 0 then 8 else 0 end + case when v > 4 then 4 else 0 end) commercial,
least(15, case when d >= 6 or w >= 30 then 5 when d >= 2 or w >= 10 then 3 when m >= 15 then 2 else 0 end + case when e >= 3 then 4 when e >= 1 then 2 else 0 end + case when v >= 1 and e >= 1 then 3 when v >= 1 then 2 else 0 end + case when s >= 2 then 3 else 0 end) complexity from x)"""


def _models(s, d):
    card = K.business_models(dict(zip(K.MODEL_POINTS, (c("k") >= 2, c("e") >= 2, c("p") >= 2, c("s") >= 2, c("v") >= 2), strict=True)))
    rows = user_days(s, d).withColumn("b", card).withColumn("models", F.size("b.models"))
    rows = rows.withColumn("commercial", K.commercial_activity(c("p"), c("k"), c("e"), c("models"), c("s") == 1, c("v") > 4))
    return rows.withColumn("complexity", K.complexity(c("d"), c("w"), c("m"), c("e"), c("v") >= 1, c("s")))


@query(f"with {_MODELS} select user_id, models, model_score, commercial, complexity from y")
def sc26_models(s, d):
    return _models(s, d).select("user_id", "models", c("b.score").alias("model_score"), "commercial", "complexity")


@query(f"""with {_MODELS} select user_id, coalesce(nullif(concat_ws(',', case when complexity >= 6 or (d >= 4 and p >= 1) or (models >= 1 and w >= 15) then 'channel_management' end, case when commercial >= 18 or a then 'advertising_management' end,
case when models >= 1 and (commercial >= 12 or p >= 2) then 'growth_marketing' end, case when models >= 2 and commercial >= 20 then 'verification' end, case when b then 'account_management' end, case when g or i then 'partnerships' end, case when v >= 1 and w >= 15 then 'content_media' end), ''), 'none') services,
case when p = 0 then case when k > 2 then 5 else 0 end when h / 24 <= 3 then 5 when h / 24 <= 7 then 4 when h / 24 <= 14 then 3 when h / 24 <= 30 then 2 when h / 24 <= 60 then 1 else 0 end fresh,
round(least(0.98, greatest(0.40, 0.45 + 0.12 * (models + (p > 0)::int + (e > 0)::int + (s > 0)::int)))::double, 2) confidence from y""")
def sc29_services(s, d):
    fit = K.services(c("b.models"), c("commercial"), c("complexity"), c("p"), c("d"), c("w"), c("v") >= 1)
    fresh = K.commercial_freshness(F.when(c("p") > 0, c("h") / 24), c("k") > 2)
    return _models(s, d).select("user_id", F.concat_ws(",", fit).alias("services"), fresh.alias("fresh"), K.inference_confidence(c("models"), c("p"), c("e"), c("s")).alias("confidence"))


@query(f"""{LEADS}, l as (select id, lower(segment) || nation contact, case when lead_score < -5 then 'rejected' end status, lead_score risk from leads),
g as (select o_custkey lead_id, count(*) filter (o_orderpriority = '1-URGENT' and o_totalprice > 480000) sent, count(*) filter (o_orderpriority = '1-URGENT' and o_totalprice > 480000 and o_orderstatus = 'F') here, count(*) filter (o_orderpriority = '2-HIGH' and o_totalprice > 400000) failed from orders group by 1),
j as (select l.*, coalesce(here, 0) here, sum(coalesce(sent, 0)) over (partition by contact) all_sent, sum(coalesce(failed, 0)) over (partition by contact) all_failed from l left join g on lead_id = id)
select id, case when ends_with(contact, '13') or contact = 'building4' or status = 'rejected' then 'BLOCKED' when here > 0 or all_sent > 0 then 'CONTACTED' when id % 11 = 0 then 'COOLDOWN' when all_failed >= 3 then 'FAILED' when risk > 75 then 'RISKY' else 'ELIGIBLE' end eligibility,
case when ends_with(contact, '13') then 'empty contact' when contact = 'building4' then 'blacklisted' when status = 'rejected' then 'rejected' when here > 0 then 'in this campaign' when all_sent > 0 then 'by another lead' when id % 11 = 0 then 'cooling down' when all_failed >= 3 then 'failure history' when risk > 75 then 'risk' else 'eligible' end reason from j""")
def sc32_eligibility(s, d):
    stamp = F.when(c("id") % 11 == 0, F.lit("2024-02-01")).otherwise(F.lit("2024-01-01")).cast("timestamp_ntz")
    contact = F.when(c("nation") != 13, F.concat(F.lit("@"), c("segment"), c("nation")))
    rows = leads(s, d).select("id", contact.alias("contact"), F.when(c("lead_score") < -5, "rejected").alias("status"), stamp.alias("next_eligible_at"), c("lead_score").alias("risk"), F.lit(None).cast("string").alias("about"))
    status = F.when((c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 480000), "sent").when((c("o_orderpriority") == "2-HIGH") & (c("o_totalprice") > 400000), "failed")
    logs = orders(s, d).select(c("o_custkey").alias("lead_id"), c("o_orderstatus").alias("campaign_id"), status.alias("status"))
    bad = leads(s, d).filter("nation = 4 and segment = 'BUILDING'").select(contact.alias("name"))
    return eligibility(rows, logs, bad, "F", "2024-01-15")


@query("""with h as (select doc_id, source, 25 * (contains(lower(coalesce(text, '') || source), 'zu')::int + contains(lower(coalesce(text, '') || source), 'ión')::int + contains(lower(coalesce(text, '') || source), 'ough')::int) score from documents)
select doc_id, not ends_with(source, '7') pass, case when ends_with(source, '7') then 'bot' when score > 0 then 'terms' else 'second stage' end reason, case when ends_with(source, '7') then 0 when score > 0 then score else 20 end score from h""")
def sc15_first_stage(s, d):
    name = F.when(c("source").endswith("7"), F.concat("source", F.lit("bot"))).otherwise(c("source"))
    card = K.first_stage(F.lit(None).cast("string"), c("text"), name, ["zu", "ión", "ough"], ["vip"])
    return documents(s, d).select("doc_id", card.alias("x")).select("doc_id", "x.*")
