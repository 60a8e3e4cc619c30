"""Registered queries over texts with planted signals: relevance, links, scripts, categories, gates, mined signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import relevance as R
from tidemark.operators import queues
from tidemark.plans.catalog import LEADS, c, customer, documents, events, query
from tidemark.sources.io import leads

#: what each seventh document says besides its own text; the same CASE serves Spark and the oracle
SAID = """case doc_id % 7 when 0 then ' Buy gold xauusd now, TP1: 2400 SL: 2300 vip' when 1 then ' توصيات الذهب والفوركس، تحليل يومي وشارت'
    when 2 then ' casino bonus and forex signals' when 3 then ' eurusd gbpusd usdjpy entry: 5, signals and chart of the broker' when 4 then ' long dca 10x 1:3 rr scalping course'
    when 5 then ' funded account, copy trading, premium' else '' end"""
TEXT = f"coalesce(text, '') || {SAID}"
DOCS = f"with recursive t as (select doc_id, {TEXT} text, lower({TEXT}) low from documents)"
# the oracle's word borders are ASCII only, so other letters become an ASCII one
PLAIN = f"with recursive t as (select doc_id, regexp_replace(lower({TEXT}), '[^ -~\\s]', 'x', 'g') plain from documents)"
PAIRS, FOREX, GOLD, SIGNALS, METHODS = ["eurusd", "gbpusd", "usdjpy", "xauusd"], ["forex", "trading"], ["gold", "xauusd"], ["signals", "entry", "tp1"], ["dca", "order block"]
STYLES, SALES, PROPS, BROKERS, BAD = ["scalping", "swing"], ["vip", "premium"], ["funded account"], ["broker"], ["casino", "poker"]
LEXICA = {"pairs": PAIRS, "forex": FOREX, "gold": GOLD, "signals": SIGNALS, "methods": METHODS, "styles": STYLES, "commercial": SALES, "props": PROPS, "brokers": BROKERS}
RULES = [("funded", ["funded account", "prop firm"]), ("scalping", ["scalping", "futures"]), ("copying", ["copy trading"]), ("vip", ["vip", "premium"]), ("gold", ["gold", "ذهب"]), ("forex", ["forex", "eurusd"]), ("education", ["course", "tutorial"])]


def _said(s, d):
    return documents(s, d).select("doc_id", F.expr(TEXT).alias("text"))


def _hits(terms: list[str]) -> str:
    return " + ".join(f"contains(low, '{t}')::int" for t in terms)


_SYNTAX = r"\b(sl\s*[:=-]?\s*\d+|tp\s*[:=-]?\s*\d+|tp[1-4]\s*[:=-]?\s*\d+|entry\s*[:=-]?\s*\d+|stop\s*loss|take\s*profit|long|short|leverage|cross|isolated|target\s*[1-4]?|dca)\b"


@query(f"{PLAIN} select doc_id, len(regexp_extract_all(plain, '{_SYNTAX}'))::int n from t")
def tx16_syntax(s, d):
    return _said(s, d).select("doc_id", R.signal_syntax(c("text")).alias("n"))


@query(rf"""{PLAIN} select doc_id, concat_ws(',', case when regexp_matches(plain, '\bbuy\s+([a-z]{{3,6}}|gold|oil)\b') then 'buy_entry' end, case when regexp_matches(plain, '\bsell\s+([a-z]{{3,6}}|gold|oil)\b') then 'sell_entry' end,
    case when regexp_matches(plain, '\b(tp\s*[0-9]?|target\s*[0-9]?)\s*[:=-]?\s*[0-9]+') then 'take_profit' end, case when regexp_matches(plain, '\b(sl|stop\s*loss)\s*[:=-]?\s*[0-9]+') then 'stop_loss' end,
    case when regexp_matches(plain, '\b[0-9]+\s*(pip|pips)\b') then 'pips_gain' end, case when regexp_matches(plain, '\b([0-9]+x|[0-9]+:[0-9]+)\b') then 'leverage' end,
    case when regexp_matches(plain, '\b(1\s*:\s*[2-9]|rr|r:r)\b') then 'risk_reward' end) names from t""")
def tx19_names(s, d):
    return _said(s, d).select("doc_id", F.array_join(R.syntax_names(c("text")), ",").alias("names"))


@query(f"{DOCS} select doc_id, case when contains(low, 'casino') then 'casino' when contains(low, 'ألذهب') or contains(low, 'الذهب') then 'الذهب' when contains(low, 'course') then 'course' end term from t")
def tx21_disqualifier(s, d):
    return _said(s, d).select("doc_id", R.first_term(c("text"), ["casino", "الذهب", "course"]).alias("term"))


@query(f"{DOCS} select doc_id, case when n > 0 then least(100, 20 + 10 * n) else 0 end score from (select doc_id, {_hits([*PAIRS, *FOREX, *SIGNALS])} n from t)")
def tx22_candidate(s, d):
    n = sum(c("text").ilike(f"%{t}%").cast("int") for t in [*PAIRS, *FOREX, *SIGNALS])
    return _said(s, d).select("doc_id", R.candidate_relevance(n).alias("score"))


@query(f"""{DOCS}, k as (select doc_id, low, {', '.join(f'{_hits(v)} {name}' for name, v in LEXICA.items())}, len(regexp_extract_all(regexp_replace(low, '[^ -~]', 'x', 'g'), '{_SYNTAX}')) syntax, doc_id % 11 = 0 strong, doc_id % 7 = 0 recommended, doc_id % 4 degree,
        (doc_id % 5) * 4.5 boost, case when doc_id % 13 = 0 then 32 else 0 end penalty, doc_id % 5 learned, contains(low, 'casino') bad from t),
    p as (select *, (case when pairs >= 3 then 35 when pairs >= 1 or regexp_matches(low, 'gold|xau|forex|ذهب|فوركس') then 25 else 0 end
        + case when signals >= 2 then 15 when signals >= 1 then 10 else 0 end + case when syntax > 0 then 25 else 0 end + case when methods >= 1 then 15 else 0 end + case when styles >= 1 then 10 else 0 end
        + case when regexp_matches(low, 'chart|تحليل|شارت') then 10 else 0 end + case when commercial >= 1 or contains(low, 'vip') then 15 else 0 end + case when props >= 1 or brokers >= 1 then 10 else 0 end
        + case when strong or recommended then 20 else 0 end + case when degree >= 2 then 10 else 0 end + round_even(boost, 0)::int) raw,
        pairs > 0 or syntax > 0 or forex > 0 or gold > 0 or methods > 0 or (signals > 0 and commercial > 0) or learned > 0 shown from k),
    q as (select *, least(100, greatest(0, raw - penalty)) sc from p)
    select doc_id, case when bad then 0 else sc end score,
        case when bad then 'REJECTED' when penalty < 30 and sc >= 65 and shown then 'HIGH_CONFIDENCE_FOREX' when penalty < 30 and sc >= 45 and shown then 'LIKELY_FOREX' when penalty < 30 and sc >= 25 and (shown or strong) then 'POSSIBLE_FOREX' else 'LOW_CONFIDENCE' end class,
        case when bad then 'Tier_D' when penalty < 30 and sc >= 65 and shown then 'Tier_A' when penalty < 30 and sc >= 45 and shown then 'Tier_B' when penalty < 30 and sc >= 25 and (shown or strong) then 'Tier_C' else 'Tier_D' end tier,
        not bad and penalty < 30 and ((sc >= 45 and shown) or (sc >= 25 and (shown or strong))) qualified from q""")
def sc16_relevance(s, d):
    low = F.lower("text")
    hits = {k: sum(low.contains(t).cast("int") for t in v) for k, v in LEXICA.items()} | {"syntax": R.shows_syntax(c("text")).cast("int")}
    rows = _said(s, d).select("doc_id", R.text_signs(c("text")).alias("signs"), R.first_term(c("text"), ["casino"]).alias("bad"), *[n.alias(k) for k, n in hits.items()])
    i = c("doc_id")
    card = R.judged(c("signs"), {k: c(k) for k in hits}, i % 11 == 0, i % 7 == 0, i % 4, (i % 5) * 4.5, F.when(i % 13 == 0, 32), i % 5, c("bad"))
    return rows.select("doc_id", card.alias("r")).select("doc_id", "r.score", "r.class", "r.tier", "r.qualified")


_LINKS = """case c_custkey % 12 when 0 then 'https://t.me/' || replace(c_name, '#', '_') when 1 then 't.me/joinchat/AbC-' || c_custkey when 2 then 'http://telegram.me/+Inv' || c_custkey || '/x' when 3 then '@name_' || c_custkey
    when 4 then 'T.ME/trade' || c_custkey || 'Bot' when 5 then 't.me/' || (100000 + c_custkey) when 6 then 'https://t.me/support' when 7 then 'ab' when 8 then ' plain' || c_custkey || ' ' when 9 then 'https://x.org/plain' when 10 then '' end"""


@query(rf"""with l as (select c_custkey, trim(coalesce({_LINKS}, '')) l from customer), p as (select *, regexp_extract(l, '(?i)(?:t\.me|telegram\.me)/joinchat/([a-zA-Z0-9_-]+)', 1) j,
    regexp_extract(l, '(?i)(?:t\.me|telegram\.me)/([a-zA-Z0-9_]{{5,32}})', 1) u, case when contains(l, 't.me') or contains(l, '/') then '' else regexp_extract(l, '^@?([a-zA-Z0-9_]{{4,32}})$', 1) end b from l),
    n as (select *, u <> '' and lower(u) not in ('support', 'joinchat') and not ends_with(lower(u), 'bot') and not regexp_full_match(u, '[0-9]+') ok, b <> '' and not ends_with(lower(b), 'bot') okb from p)
    select c_custkey, case when contains(l, '/+') or j <> '' then 'private' when ok or okb then 'public' end kind, case when contains(l, '/+') then split_part(split_part(l, '/+', 2), '/', 1) when j <> '' then j when ok then u when okb then b end "name",
        case when lower(h) like 't.me/%' then 'https://' || h else 'https://t.me/' || h end link
    from (select *, regexp_replace(regexp_replace(l, '^https?://', '', 'i'), '^telegram\.me/', 't.me/', 'i') h from n)""")
def str10_links(s, d):
    link = F.expr(_LINKS)
    rows = customer(s, d).select("c_custkey", R.parse_link(link).alias("p"), R.normal_link(F.coalesce(link, F.lit(""))).alias("link"))
    return rows.select("c_custkey", "p.kind", "p.name", "link")


@query(f"""{DOCS}, w as (select doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') words, case when doc_id % 3 = 0 then [] else [text, 'سلام', null, 'x'][1:doc_id % 5] end posts from t),
    n as (select doc_id, coalesce(100.0 * len(regexp_extract_all(text, '[\\x{{600}}-\\x{{6FF}}]')) / nullif(len(regexp_extract_all(text, '[a-zA-Z0-9\\x{{600}}-\\x{{6FF}}]')), 0), 0) a,
        coalesce(100.0 * len(list_filter(words, lambda w: regexp_matches(w, '[\\x{{600}}-\\x{{6FF}}]'))) / nullif(len(words), 0), 0) b,
        coalesce(100.0 * len(list_filter(posts, lambda p: regexp_matches(coalesce(p, ''), '[\\x{{600}}-\\x{{6FF}}]'))) / nullif(len(posts), 0), 0) p from w)
    select doc_id, trunc(a)::int chars, trunc(b)::int words, trunc(p)::int posts, trunc((a + b + p) / 3)::int mean from n""")
def str4_scripts(s, d):
    posts = F.when(c("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.slice(F.array(c("text"), F.lit("سلام"), F.lit(None), F.lit("x")), F.lit(1), (c("doc_id") % 5).cast("int")))
    return _said(s, d).select("doc_id", R.script_triple(c("text"), posts).alias("r")).select("doc_id", "r.*")


@query(f"{DOCS} select doc_id, case {' '.join('when ' + ' or '.join(f'contains(low, {chr(39)}{t}{chr(39)})' for t in terms) + f' then {chr(39)}{name}{chr(39)}' for name, terms in RULES)} else 'unknown' end category from t")
def sc20_category(s, d):
    return _said(s, d).select("doc_id", R.category(c("text"), RULES).alias("category"))


def _n_words(word: str) -> str:
    # neighbours share a border, so each occurrence's border is kept for the next one by doubling white space
    return f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9_؀-ۿ])', '\\1\\1', 'g'), '(?:^|[^a-z0-9_؀-ۿ]){word}(?:$|[^a-z0-9_؀-ۿ])'))"


@query(f"{DOCS} select doc_id, {_n_words('casino')} = 0 and {_n_words('the')} > 0 and {_n_words('of')} + {_n_words('signals')} + {_n_words('gold')} >= case when doc_id % 2 = 0 then 5 else 3 end pass from t")
def sc21_gate(s, d):
    return _said(s, d).select("doc_id", R.niche_gate(c("text"), c("doc_id") % 2 == 0, ["casino"], ["the"], ["of", "signals", "gold"]).alias("pass"))


@query(f"""{LEADS}, x as (select id, least(15, greatest(0, lead_score)) + case when id * 40 > 50000 then 10 when id * 40 > 20000 then 7 when id * 40 > 5000 then 4 else 0 end + least(10, nation * 2)
    + case when segment = 'BUILDING' then 30 else 0 end + case when segment = 'MACHINERY' then 25 else 0 end + case when tier = 'P0' then 15 else 0 end + case when tier is not null then 15 else 0 end + case when nation > 12 then 15 + 5 else 0 end s from leads)
    select id, least(100, s) score, case when s >= 75 then 'Tier_A' when s >= 50 then 'Tier_B' when s >= 25 then 'Tier_C' else 'Tier_D' end tier from x""")
def sc22_weighted(s, d):
    of = {"account_management": c("segment") == "BUILDING", "private": c("segment") == "MACHINERY", "vip": c("tier") == "P0", "contact": c("tier").isNotNull(), "arabic": c("nation") > 12, "arabic_title": c("nation") > 12}
    return leads(s, d).select("id", R.weighted_score(F.greatest(F.lit(0), c("lead_score")), c("id") * 40, c("nation"), of).alias("r")).select("id", "r.*")


@query(f"{DOCS} select doc_id, regexp_matches(low, 'signal|توصي') subscription, regexp_matches(low, 'monthly|funded') plans, contains(low, 'الذهب') gold from t")
def tx20_flags(s, d):
    return _said(s, d).select("doc_id", R.flags(c("text"), {"subscription": "SIGNAL|توصي", "plans": "monthly|funded", "gold": "الذهب"}).alias("r")).select("doc_id", "r.*")


@query("""with g as (select user_id, count(*) filter (event_type = 'purchase' or (event_type = 'click' and value > 20)) sig, count(*) filter (event_type = 'click' and value > 97) safe from events group by 1)
    select user_id, user_id % 5 > 0 and ((sig > 5 and safe = 0) or user_id % 17 = 0) flagged from g""")
def ag23_suspicious(s, d):
    post = F.when(c("event_type") == "purchase", "BUY now").when((c("event_type") == "click") & (c("value") > 97), "sell, stop loss 3").when((c("event_type") == "click") & (c("value") > 20), "entry 5").otherwise("hello")
    g = events(s, d).groupBy("user_id").agg(F.collect_list(post).alias("posts"))
    return g.select("user_id", R.suspicious(c("posts"), ["buy", "sell", "entry"], ["stop loss"], c("user_id") % 17 == 0, c("user_id") % 5 > 0).alias("flagged"))


_VALUES = "case c_custkey % 10 when 0 then 'BTC' || c_custkey when 1 then 'XAUUSD' when 2 then 'EURUSD' when 3 then 'gold tips' when 4 then 'my bitcoin' when 5 then 'ذهب' when 6 then 'توصيات' when 7 then 'vip room' when 8 then 'forex' else c_mktsegment end"


@query(f"""with v as (select c_custkey, c_custkey % 10 < 3 and c_custkey % 4 > 0 symbol, lower({_VALUES}) v from customer)
    select c_custkey, case when symbol then case when v like 'btc%' then 'crypto' when contains(v, 'xau') then 'gold' else 'forex' end when regexp_matches(v, 'gold|xau|ذهب') then 'gold' when contains(v, 'bitcoin') then 'crypto'
    when regexp_matches(v, 'توصيات|signals|tp|sl') then 'signals' when contains(v, 'vip') then 'commercial' when contains(v, 'forex') then 'forex' else 'general_trading' end category from v""")
def lm5_category(s, d):
    kind = F.when((c("c_custkey") % 10 < 3) & (c("c_custkey") % 4 > 0), "symbol").otherwise("keyword")
    return customer(s, d).select("c_custkey", R.signal_category(kind, F.expr(_VALUES)).alias("category"))


@query("""with g as (select event_type q, count(*) filter (value > 80) n from events group by 1), l as (select q, case when n >= 410 then 'CRITICAL' when n >= 390 then 'HIGH' else 'NORMAL' end level from g)
    select q queue, level, max(case level when 'CRITICAL' then 2 when 'HIGH' then 1 else 0 end) over () worst from l""")
def st11_pressure(s, d):
    g = events(s, d).groupBy(c("event_type").alias("queue")).agg(F.count_if(c("value") > 80).alias("n"))
    return queues.with_worst(g.select("queue", R.pressure(c("n"), 390, 410).alias("level")))
