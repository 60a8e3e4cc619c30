"""Registered queries of normalisers, parsers, message edges, ladders, queues, claims, sinks and plain stream windows.

The driver's tables hold no Arabic letters, handles or phone numbers, so each row gets a planted part that follows from its
id, before or after its own whole text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import names as N
from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import merge, schedule
from tidemark.operators import messages as M
from tidemark.plans.catalog import c, customer, documents, events, orders, pages, query
from tidemark.sources import io
from tidemark.sources.io import scratch, table
from tidemark.streaming import streams


def _cases(key, among: int, *texts: str):
    """The planted text of a row: the expression whose place is the key's remainder, else empty."""
    return F.expr(f"case {key} % {among} " + " ".join(f"when {i} then {t}" for i, t in enumerate(texts)) + " else '' end")


# a planted Arabic part, as an expression of both engines
_ARABIC = ("'مُحَلِّلٌ أسواق  الذهــب '", "'إشارات ٱليوم على المدى '", "'قناة آمنة للفوركس ئ '", "concat('توصية ', doc_id, ' الى الأبد ')")
_ARABIC_SQL = "case doc_id % 5 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_ARABIC)) + " else '' end || coalesce(text, '')"


def _arabic():
    return F.concat(_cases("doc_id", 5, *_ARABIC), F.coalesce("text", F.lit("")))


@query(f"""with t as (select doc_id, trim(regexp_replace(translate(regexp_replace({_ARABIC_SQL}, '[ً-ْٰـ]', '', 'g'), 'أإآٱىئ', 'ااااييي'[1:6]), '\\s+', ' ', 'g')) n from documents)
    select doc_id, n norm, translate(n, 'ة', 'ه') final_haa from t""")
def str1_normalized(s, d):
    text = _arabic()
    return documents(s, d).select("doc_id", T.normalize_arabic(text).alias("norm"), T.normalize_arabic(text, final_haa=True).alias("final_haa"))


@query(f"select doc_id, translate(regexp_replace({_ARABIC_SQL}, '[ً-ْٰـ]', '', 'g'), 'أإآى', 'اااي') mined from documents")
def str2_mined(s, d):
    return documents(s, d).select("doc_id", T.normalize_for_mining(_arabic()).alias("mined"))


_NOISE = ("'Join https://x.example/a?b=1, now! '", "'ask @some_one (at) +966 50 123-4567 ok '", "concat('call 00', 9000000 + doc_id, ' or 12-34: yes/no; ')", "'«ذهب» 50% & more… '")


@query(f"""with t as (select doc_id, case doc_id % 6 {' '.join(f"when {i} then {t}" for i, t in enumerate(_NOISE))} else '' end || coalesce(text, '') x from documents),
    a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(x, 'https?://\\S+', ' ', 'g'), '@\\w+', ' ', 'g'), '\\+?\\d[\\d\\s-]{{7,}}\\d', ' ', 'g') x from t)
    select doc_id, trim(regexp_replace(regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\s.,\\-:/]', ' ', 'g'), '\\s+', ' ', 'g')) clean from a""")
def str7_cleaned(s, d):
    return documents(s, d).select("doc_id", T.clean_for_mining(F.concat(_cases("doc_id", 6, *_NOISE), F.coalesce("text", F.lit("")))).alias("clean"))


_NUMBERS = "case event_id % 6 when 0 then concat(event_id % 100, '.', event_id % 10, 'k') when 1 then concat(' ', event_id % 50, 'M ') when 2 then concat(event_id % 9 + 1, ',', 100 + event_id % 900) when 3 then 'members' when 4 then concat(event_id % 7, 'K5') when 5 then concat('', event_id) end"


@query(f"""with t as (select event_id, upper(replace(trim({_NUMBERS}), ',', '')) n from events)
    select event_id, coalesce(trunc(try_cast(rtrim(n, 'KM') as double) * case when ends_with(n, 'K') then 1000 when ends_with(n, 'M') then 1000000 else 1 end), 0)::bigint members from t""")
def str9_numbers(s, d):
    return events(s, d).select("event_id", T.human_number(F.expr(_NUMBERS)).alias("members"))


_LINKS = ("'https://t.me/s/Gold_Room?before=5'", "concat('@User', page_id)", "' www.example.com/Some.Name/12#top '", "concat('HTTP://Example.org/s/Chan', page_id)")


@query(f"""with t as (select page_id, case page_id % 5 {' '.join(f"when {i} then {t}" for i, t in enumerate(_LINKS))} else url end u from pages)
    select page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(u)), '^(https?://)?(www\\.)?[a-z0-9-]+\\.[a-z]+/(s/)?', ''), '[?#/].*$', ''), '^@', '') handle from t""")
def str12_canonical(s, d):
    link = F.when(c("page_id") % 5 < 4, _cases("page_id", 5, *_LINKS)).otherwise(c("url"))
    return pages(s, d).select("page_id", T.canonical_handle(link).alias("handle"))


_NAMED = (
    ("telegram", "concat('https://T.me/@Gold', page_id, '/?x=1')"), ("telegram", "'joinchat/AbC '"), ("tiktok", "concat('https://www.tiktok.com/@User', page_id, '/video/9')"),
    ("facebook", "concat('https://m.facebook.com/groups/G', page_id, '/posts/1')"), ("Facebook ", "concat('https://www.facebook.com/pages/Name/', page_id, '/')"), ("facebook", "'SomePage/about?x'"),
    ("web", "url"), ("web", "concat('WWW.Example.org/Path', page_id, '/;p?q#f')"), ("forum", "concat(' Nick', page_id)"), ("web", "''"),
)
_PLATFORM = "case page_id % 10 " + " ".join(f"when {i} then '{p}'" for i, (p, _) in enumerate(_NAMED)) + " end"
_NAME = "case page_id % 10 " + " ".join(f"when {i} then {x}" for i, (_, x) in enumerate(_NAMED)) + " end"


@query(f"""with t as (select page_id, lower(trim({_PLATFORM})) k, trim(coalesce({_NAME}, '')) u from pages),
    f as (select *, split(trim(split_part(regexp_replace(u, '^https?://(?:www\\.|m\\.)?facebook\\.com/', '', 'i'), '?', 1), '/'), '/') p, regexp_replace(u, '^https?://', '') w from t),
    n as (select page_id, k, case k when 'telegram' then lower(trim(trim(ltrim(split_part(regexp_replace(u, '^https?://(?:www\\.)?(?:t\\.me|telegram\\.me)/', '', 'i'), '?', 1), '@'), '/')))
        when 'tiktok' then lower(split_part(ltrim(split_part(regexp_replace(u, '^https?://(?:www\\.)?tiktok\\.com/', '', 'i'), '?', 1), '@'), '/', 1))
        when 'facebook' then lower(case p[1] when 'groups' then p[2] when 'pages' then p[-1] else p[1] end)
        when 'web' then regexp_replace(lower(regexp_extract(w, '^[^/?#]*')), '^www\\.', '') || rtrim(regexp_extract(w, '^[^/?#]*([^?#;]*)', 1), '/') else lower(u) end n from f)
    select page_id, case when n <> '' then k || ':' || n else '' end identity from n""")
def str13_identity(s, d):
    return pages(s, d).select("page_id", N.canonical_identity(F.expr(_PLATFORM), F.expr(_NAME)).alias("identity"))


_WORD = "case p_partkey % 6 when 0 then concat('الذهب ', p_name) when 1 then concat('توصيات  ', p_name, ' أ') when 2 then concat('gold ', p_name) when 3 then concat('قناة فوركس', p_partkey) when 4 then concat('smc ', p_name) else concat('  ', p_name) end"


@query(f"""with w as (select p_partkey, trim(regexp_replace({_WORD}, '\\s+', ' ', 'g')) w from part),
    v as (select *, trim(regexp_replace(translate(regexp_replace(w, '[ً-ْٰـ]', '', 'g'), 'أإآٱىئ', 'ااااييي'[1:6]), '\\s+', ' ', 'g')) n, split_part(w, ' ', 1) f from w),
    l as (select p_partkey, w, [w, n, translate(n, 'ة', 'ه'), array_to_string(list_transform(split(w, ' '), lambda x: case when x[1:2] = 'ال' and length(x) > 3 then x[3:] else x end), ' '),
        case when f[1:2] <> 'ال' and length(f) > 2 and regexp_matches(f, '[؀-ۿ]') then 'ال' || w end,
        case when contains(w, 'ذهب') or contains(lower(w), 'gold') then w || ' XAUUSD' when contains(w, 'فوركس') then w || ' Forex' when contains(w, 'توصيات') then w || ' VIP' when regexp_matches(lower(w), 'smc|ict') then w || ' تحليل' end] l from v),
    k as (select p_partkey, w, list_filter(l, lambda x: x is not null) l from l)
    select p_partkey, case when w <> '' then array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], '|') else '' end variants from k""")
def str18_variants(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(N.query_variants(F.expr(_WORD)), "|").alias("variants"))


_LETTERS = ("''", "'Hi {first_name}, '", "'see http:// and '", "repeat('more ', 900)", "'https://x.example/only'")
_LETTER = "case doc_id % 7 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_LETTERS)) + " end"


@query(f"""with t as (select doc_id, case when doc_id % 7 in (0, 4) then '' else coalesce(text, '') end || coalesce({_LETTER}, '') m from documents)
    select doc_id, concat_ws(',', case when trim(m) = '' then 'empty' end, case when length(m) > 4096 then 'too_long' end, case when regexp_matches(m, '\\{{[A-Za-z_]+\\}}') then 'placeholder' end,
        case when regexp_matches(m, 'https?://(\\s|$)') then 'bad_url' end, case when regexp_matches(m, 'https?://') and trim(regexp_replace(m, 'https?://\\S+', '', 'g')) = '' then 'links_only' end) errors from t""")
def str20_errors(s, d):
    message = F.concat(F.when(c("doc_id") % 7 % 4 == 0, "").otherwise(F.coalesce("text", F.lit(""))), F.coalesce(F.expr(_LETTER), F.lit("")))
    return documents(s, d).select("doc_id", F.array_join(T.message_errors(message), ",").alias("errors"))


_LISTS = """case event_id % 8 when 0 then '["a","b",null]' when 1 then '"[\\\\"x\\\\", 2]"' when 2 then concat('[', event_id, ',true]') when 3 then 'no json' when 4 then '{"a":1}' when 5 then '[]' when 6 then '"text"' end"""


@query("""select event_id, case event_id % 8 when 0 then 'a|b|-' when 1 then 'x|2' when 2 then event_id || '|true' else '' end items from events""")
def js2_lists(s, d):
    return events(s, d).select("event_id", F.array_join(T.json_list(F.expr(_LISTS)), "|", "-").alias("items"))


@query("""select doc_id, unnest(list_filter([source, lang, 'seed' || doc_id % 3, 'src1'], lambda x: x is not null)) origin from documents where source <> 'src1' or source is null
    union all select doc_id, unnest(list_filter([source, lang, 'seed' || doc_id % 3], lambda x: x is not null)) from documents where source = 'src1'""")
def ar1_origins(s, d):
    """Where a document came from: a list, appended to unless the origin is in it, one row each."""
    known = F.array("source", "lang", F.concat(F.lit("seed"), c("doc_id") % 3))
    grown = F.when(F.exists(known, lambda x: x == "src1"), known).otherwise(F.array_append(known, F.lit("src1")))
    return documents(s, d).select("doc_id", F.explode(F.array_compact(grown)).alias("origin"))


_SITES = "concat(coalesce(url, ''), ' ', case page_id % 4 when 0 then 'https://linktr.ee/Me, https://linktr.ee/Me' when 1 then 'https://www.instagram.com/x' || page_id || ') https://other.org/a.' when 2 then 'https://t.me/no https://youtube.com/y https://youtube.com/y' else '' end)"


@query(f"""with u as (select page_id, list_transform(regexp_extract_all({_SITES}, 'https?://(?:www\\.)?([a-zA-Z0-9-]+\\.[a-zA-Z]{{2,6}}[^\\s]*)', 1, 'i'), lambda x: 'https://' || rtrim(x, '.,;)!}}"''')) l from pages),
    v as (select page_id, unnest(l) "value", generate_subscripts(l, 1) i from u),
    k as (select *, case when contains(lower("value"), 'linktr.ee') then 'linktree' when regexp_matches(lower("value"), 'instagram\\.com|youtube\\.com|twitter\\.com|x\\.com|tiktok\\.com|facebook\\.com') then 'social' else 'website' end type from v where not starts_with(lower("value"), 'https://t.me')),
    r as (select *, row_number() over (partition by page_id, type, case when type = 'social' then "value" end order by i) r from k)
    select page_id, type, "value", case type when 'linktree' then 95 else 90 end confidence from r where type = 'linktree' or r = 1""")
def tx5_links(s, d):
    return pages(s, d).select("page_id", F.explode(M.contact_links(F.expr(_SITES))).alias("x")).select("page_id", "x.*")


_ASKS = ("concat('\\nSupport', repeat(' x', cast(doc_id % 60 as int)), '\\n@chan', doc_id % 50)", "concat('\\n@chan', doc_id % 50, '\\n', repeat('y ', cast(doc_id % 40 as int)), 'support')", "concat('\\nsupport: CHAN', doc_id % 50, '!')", "concat('\\nsee @chan', doc_id % 50)")
_ASKS_SQL = "coalesce(text, '') || case doc_id % 5 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_ASKS)).replace("'\\n", "E'\\n") + " else '' end"


@query(f"""with t as (select doc_id, {_ASKS_SQL} x, 'chan' || doc_id % 50 n from documents)
    select doc_id, regexp_matches(x, '(?i)support.{{0,73}}@?' || n || '\\b', 's') or regexp_matches(x, '(?i)' || n || '\\b.{{0,33}}support', 's')
        or len(list_filter(split(lower(x), E'\\n'), lambda y: contains(y, 'support') and regexp_matches(y, n || '\\b'))) > 0 asks from t""")
def tx8_mentions(s, d):
    text, handle = F.concat(F.coalesce("text", F.lit("")), _cases("doc_id", 5, *_ASKS)), F.concat(F.lit("@chan"), c("doc_id") % 50)
    return documents(s, d).select("doc_id", M.contact_mention(text, handle, "support").alias("asks"))


_REFERS = ("concat(' JOIN t.me/Chan', doc_id % 9, ' and https://t.me/joinchat/+abcd', doc_id % 4, ' or @Friend', doc_id % 5)", "concat(' t.me/Other', doc_id % 7, ' with @helper_x, mail a@bcde.org')", "concat('\\nsupport @Helper', doc_id % 3, '\\n@Partner')")
_REFERS_SQL = "coalesce(text, '') || case doc_id % 4 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_REFERS)).replace("'\\n", "E'\\n").replace(", '\\n@", ", E'\\n@") + " else '' end"


@query(f"""with t as (select doc_id, {_REFERS_SQL} x, case when doc_id % 3 = 0 then 'Origin' || doc_id % 11 end f from documents),
    m as (select doc_id, x, unnest(regexp_extract_all(x, '(?:^|[^\\w.])@(\\w{{4,32}})', 1)) n from t)
    select doc_id, lower(f) target, 'forward' relation, 95 confidence from t where f is not null
    union select doc_id, lower(unnest(regexp_extract_all(x, '(?:https?://)?(?:t\\.me|telegram\\.me)/(?:joinchat/)?\\+?([a-zA-Z0-9_.-]{{4,32}})', 1, 'i'))), 'link', case when regexp_matches(x, 'join ', 'i') then 85 else 75 end from t
    union select doc_id, lower(n), 'mention', 70 from m where not (regexp_matches(x, '(?i)support.{{0,73}}@?' || n || '\\b', 's') or regexp_matches(x, '(?i)' || n || '\\b.{{0,33}}support', 's'))""")
def tx12_edges(s, d):
    text = F.concat(F.coalesce("text", F.lit("")), _cases("doc_id", 4, *_REFERS))
    rows = documents(s, d).select("doc_id", text.alias("x"), F.when(c("doc_id") % 3 == 0, F.concat(F.lit("Origin"), c("doc_id") % 11)).alias("f"))
    return M.message_edges(rows, "doc_id", "x", c("f"), "join ", "support")


@query("""select distinct 'u' || user_id source, lower('U' || event_id % 40) target, 'recommendation' relation, 90 confidence from events where event_type is not null and event_type not in ('error', 'click') and event_id % 40 <> user_id""")
def tx12_recommended(s, d):
    name = F.when(c("event_type") != "click", F.concat(F.lit("U"), c("event_id") % 40))
    rows = events(s, d).select(F.concat(F.lit("u"), "user_id").alias("source"), name.alias("target"), "event_type")
    return M.recommendation_edges(rows, "source", "target", c("event_type") == "error")


@query(r"""with t as (select doc_id, upper(regexp_replace(coalesce(text, '') || case doc_id % 3 when 0 then ' eur/usd, EURUSD xauusd' when 1 then ' Gbp/jpy EURUSDT GBPJPYXXXXX usd' else '' end, '[^ -~]', ' ', 'g')) x from documents),
    f as (select doc_id, list_filter(regexp_extract_all(replace(x, '/', ''), '\b([A-Z]{3,10})\b', 1), lambda y: y[1:3] in ('EUR', 'GBP', 'XAU', 'USD', 'THE')) l from t)
    select doc_id, array_to_string(list_filter(l, lambda y, i: list_position(l, y) = i), ',') symbols from f""")
def tx17_symbols(s, d):
    text = F.concat(F.coalesce("text", F.lit("")), _cases("doc_id", 3, "' eur/usd, EURUSD xauusd'", "' Gbp/jpy EURUSDT GBPJPYXXXXX usd'"))
    found = T.symbols(F.regexp_replace(text, "[^ -~]", " "), ("EUR", "GBP", "XAU", "USD", "THE"))
    return documents(s, d).select("doc_id", F.array_join(found, ",").alias("symbols"))


@query("""with e as (select user_id % 50 channel, event_id, event_type <> 'view' fwd, case when event_type = 'purchase' then 'Name ' || user_id % 7 when event_type = 'click' then case when event_id % 3 = 0 then 'c' || event_id % 4 end when event_type = 'error' then 'p' || event_id % 5 end o from events),
    n as (select channel, coalesce(o, 'unknown') o, count(*) n, min(event_id) seen from e where fwd group by 1, 2), r as (select *, row_number() over (partition by channel order by n desc, seen) r from n),
    t as (select channel, string_agg(o || ':' || n, ',' order by r) origins from r where r <= 5 group by 1), a as (select channel, count(*) messages, count(*) filter (fwd) forwarded from e group by 1)
    select channel, messages, forwarded, round_even(forwarded / messages::double, 3) ratio, coalesce(origins, '') origins from a left join t using (channel)""")
def ag18_forwards(s, d):
    kind, text = c("event_type"), lambda x: x.cast("string")
    origin = F.when(kind != "view", F.struct(
        F.when(kind == "purchase", F.concat(F.lit("Name "), text(c("user_id") % 7))).otherwise("").alias("name"), F.when((kind == "click") & (c("event_id") % 3 == 0), F.concat(F.lit("c"), text(c("event_id") % 4))).alias("channel_id"),
        F.when(kind == "error", F.concat(F.lit("p"), text(c("event_id") % 5))).alias("peer_id")))
    out = M.forward_summary(events(s, d).withColumn("channel", c("user_id") % 50), "channel", origin, "event_id")
    return out.withColumn("origins", F.array_join(F.transform("origins", lambda x: F.concat_ws(":", x["origin"], x["n"].cast("string"))), ","))


@query("select event_id, least(3600.0::double, 30.0::double * pow(2.0, event_id % 12)) wait, case when event_id % 6 > 0 then least(4.0::double, pow(1.5, event_id % 6)) else 1.0 end factor from events")
def ma3_backoff(s, d):
    return events(s, d).select("event_id", S.backoff(c("event_id") % 12, 30.0, 3600.0).alias("wait"), S.failure_factor(c("event_id") % 6).alias("factor"))


@query("""select event_id, least(100, greatest(0, greatest(trunc(value / 250.0 * 100)::int, case when value / 250.0 >= 0.15 and user_id % 5 >= 2 then 65 + least(30, user_id % 5 * 5) when value / 250.0 >= 0.05 and user_id % 5 >= 1 then 45 when user_id % 5 >= 3 then 50 else 0 end))) script,
    least(100, (event_id % 4 + user_id % 6) * 15) commercial,
    40 * (event_id % 2) + case event_type when 'click' then 30 when 'purchase' then 30 when 'error' then 30 else 0 end + case when event_type in ('purchase', 'error') then 10 else 0 end contact,
    case when greatest(event_id % 6, (event_id % 2 + 1)) >= 4 then 100 else case greatest(event_id % 6, event_id % 2 + 1) when 3 then 80 when 2 then 60 else 35 end end discovery,
    greatest(0, 100 - 35 * (event_id % 4)) legitimacy,
    case when user_id % 3 > 0 then case when a <= 30 then 40 when a <= 90 then 25 else 0 end when b <= 14 then 35 else 0 end young
    from (select *, floor((epoch_us(timestamp '2024-02-10') - epoch_us(ts - interval 1 day * (event_id % 5 * 25))) / 8.64e10) a, floor((epoch_us(timestamp '2024-02-10') - epoch_us(ts)) / 8.64e10) b from events)""")
def sc5_parts(s, d):
    """SC5, SC6, SC9 and both parts of SC12, on both sides of every bound."""
    e, kind = c("event_id"), c("event_type")
    kinds = F.when(kind == "click", F.array(F.lit("owner"))).when(kind.isin("purchase", "error"), F.array(F.lit("admin"), F.lit("linktree"), F.lit("website"))).otherwise(F.array(F.lit("phone")))
    sources = F.when(e % 2 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    created = F.when(c("user_id") % 3 > 0, F.expr("ts - make_dt_interval(cast(event_id % 5 * 25 as int))"))
    return events(s, d).select(
        "event_id", S.script_score(c("value") / 250.0, (c("user_id") % 5).cast("int")).alias("script"), S.commercial_score(e % 4, c("user_id") % 6).alias("commercial"), S.contact_score(e % 2 == 1, kinds).alias("contact"),
        S.discovery_score((e % 6).cast("int"), sources).alias("discovery"), S.legitimacy_score(e % 4).alias("legitimacy"), S.new_channel_score(created, c("ts"), F.expr("timestamp_ntz'2024-02-10 00:00:00'")).alias("young"))


@query("""with e as (select event_id, event_id % 97 topic, user_id % 61 gold, event_id * 7 % 59 signal, event_id * 3 % 41 method, event_id * 11 % 31 script, event_id * 13 % 89 final from events)
    select event_id, case when topic >= 60 and final >= 50 and script >= 15 then 'HIGH_CONFIDENCE' when (topic >= 35 or gold >= 40 or signal >= 40) and final >= 35 then 'LIKELY'
        when (topic >= 15 or gold >= 20 or signal >= 20 or method >= 20) and final >= 20 then 'POSSIBLE' else 'LOW_CONFIDENCE' end class from e""")
def sc14_class(s, d):
    e = c("event_id")
    return events(s, d).select("event_id", S.topic_class(e % 97, c("user_id") % 61, e * 7 % 59, e * 3 % 41, e * 11 % 31, e * 13 % 89).alias("class"))


@query("""with e as (select event_id, event_id % 7 p, case when event_id % 11 < 6 then 0 else user_id % 4 end n, value / 37 k, case event_type when 'error' then 'deprecated' when 'click' then 'candidate' end was from events),
    r as (select *, case when p + n > 0 then n / (p + n)::double else 0 end r from e)
    select event_id, case when n >= 2 and r >= 0.15 then 'deprecated' when p >= 3 and r <= 0.05 and k >= 2 then 'active' when p >= 3 and r <= 0.05 and k >= 1.5 then 'validated'
        when p >= 2 and (k >= 0.5 or coalesce(was, 'observed') = 'deprecated') and r < 0.1 then 'candidate' else 'observed' end state,
        case when p > 0 then round_even(least(1.0::double, p / 5::double) * 0.4::double + p / greatest(p + n, 1)::double * 0.4::double + least(1.0::double, greatest(0.0::double, k / 4::double)) * 0.2::double, 3) else 0 end confidence from r""")
def lm6_lifecycle(s, d):
    p, n, k = c("event_id") % 7, F.when(c("event_id") % 11 < 6, F.lit(0).cast("long")).otherwise(c("user_id") % 4), c("value") / 37
    was = F.when(c("event_type") == "error", "deprecated").when(c("event_type") == "click", "candidate")
    return events(s, d).select("event_id", L.lifecycle(p, n, k, was).alias("state"), L.signal_confidence(p, p, n, k).alias("confidence"))


@query("""with a as (select 'acc' || user_id "name", count(*) filter (event_type = 'purchase') active, count(*) filter (event_type = 'error') errors, floor(max(value))::bigint idle, user_id % 3 = 0 recovering from events where user_id is not null group by user_id)
    select *, 100 * active + 20 * errors - least(50, idle) + case when recovering then 50 else 0 end load from a order by load, "name" limit 1""")
def tk13_least_loaded(s, d):
    kind = c("event_type")
    accounts = events(s, d).filter("user_id is not null").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("active"), F.count_if(kind == "error").alias("errors"), F.floor(F.max("value")).alias("idle"))
    return schedule.least_loaded(accounts.select(F.concat(F.lit("acc"), "user_id").alias("name"), "active", "errors", "idle", (c("user_id") % 3 == 0).alias("recovering")))


@query("""select event_id, case event_id % 4 when 0 then 'high' when 1 then 'normal' else 'low' end by_risk, case when event_type in ('purchase', 'click') then 'high' else 'normal' end by_seed,
    case when value > 80 then 'critical' when value > 60 then 'high' when value > 40 then 'normal' else 'low' end by_score, case when value >= 80 then 'short' when value >= 50 then 'medium' when value >= 30 then 'long' else 'longest' end delay from events""")
def sm10_queues(s, d):
    """All three mappings to queues (SM10) and the band of delays (XT15)."""
    risk = F.when(c("event_id") % 4 == 0, "LOW").when(c("event_id") % 4 == 1, "MEDIUM").when(c("event_id") % 4 == 2, "HIGH")
    return events(s, d).select(
        "event_id", schedule.queue_of_risk(risk).alias("by_risk"), schedule.queue_of_seed(F.upper("event_type"), ("purchase", "click")).alias("by_seed"), schedule.queue_of(c("value")).alias("by_score"), schedule.delay_band(c("value")).alias("delay"))


@query("""select o_orderkey lead_id, o_custkey % 10 campaign_id, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 5 and l_suppkey % 2 = 0) then 'sent' when o_orderkey % 5 < 3 then 'pending' else 'failed' end status
    from orders where o_orderstatus = 'O' and o_orderdate < timestamp '2000-01-01' - interval 30 minute""")
def sm7_reconciled(s, d):
    claims = orders(s, d).select(c("o_orderkey").alias("lead_id"), (c("o_custkey") % 10).alias("campaign_id"), F.when(c("o_orderstatus") == "O", "processing").otherwise("sent").alias("status"), c("o_orderdate").alias("last_attempt_at"), (c("o_orderkey") % 5).alias("attempt_count"))
    items = table(s, d, "lineitem").filter("l_linenumber = 5 and l_suppkey % 2 = 0").select(c("l_orderkey").alias("lead_id"))
    delivered = claims.select("lead_id", "campaign_id").join(items, "lead_id")
    return schedule.reconciled(claims, delivered, "2000-01-01 00:00:00", 30, 3).select("lead_id", "campaign_id", "status")


@query("select c_custkey id, c_name \"name\", case when c_custkey % 3 = 0 then 'known' else 'new' end status from customer")
def snk1_inserted(s, d):
    rows = customer(s, d).select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    known = rows.filter("id % 3 = 0").withColumn("status", F.lit("known"))
    delta = rows.withColumn("status", F.lit("new"))
    return merge.insert_or_ignore(known, delta.unionAll(delta.filter("id % 2 = 0")), ["id"])


@query("select 'csv' kind, c_custkey id, c_name \"name\", c_mktsegment segment from customer union all select 'json', c_custkey, c_name, c_mktsegment from customer")
def snk3_exported(s, d):
    rows = customer(s, d).select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    at, out = scratch(s, "export"), []
    for kind in ("csv", "json"):
        io.export(rows, f"{at}/{kind}", kind)
        read = s.read.schema(rows.schema)
        back = read.option("header", True).csv(f"{at}/{kind}") if kind == "csv" else read.json(f"{at}/{kind}")
        out.append(back.select(F.lit(kind).alias("kind"), "*"))
    return out[0].unionAll(out[1])


@query("select ts::date as \"day\", user_id, count(*) n from events where event_type is not null group by all")
def snk4_snapshots(s, d):
    at, kinds = scratch(s, "snapshots"), events(s, d).select("ts", "user_id", "event_type")
    for part in (c("event_type") == "error", c("event_type") != "error"):
        io.append(kinds.filter(part), at)
    return s.read.schema(kinds.schema).parquet(at).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))


@query("select user_id, max(event_id) mark, count(*) n from events group by 1")
def st1_marks(s, d):
    at = scratch(s, "stream")
    return streams.to_parquet(streams.high_water(streams.events(s, d)), f"{at}/rows", f"{at}/state", "complete")


@query("select date_trunc('hour', ts) bucket, event_type, count(*) n from events group by all")
def st5_hours(s, d):
    at = scratch(s, "stream")
    out = streams.to_parquet(streams.hourly(streams.events(s, d)), f"{at}/rows", f"{at}/state", "complete")
    return out.withColumn("bucket", c("bucket").cast("timestamp_ntz"))
