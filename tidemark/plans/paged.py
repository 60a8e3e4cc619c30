"""Registered queries over pages: preview pages and profiles planted around the table's own HTML.

The preview oracles know what was planted; the table's HTML stands inside of a message, so the
scanner has to find its way through it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.relevance import candidate_relevance
from tidemark.operators import messages as M
from tidemark.plans.catalog import c, pages, query
from tidemark.sources import pages as P

TITLE = "case when page_id % 30 = 7 then null when page_id % 6 = 0 then '' when page_id % 6 = 1 then concat('Telegram: Contact @page', page_id) else concat('Page ', page_id, ' & more') end"


def _previews(s, d):
    text = lambda x: F.col(x).cast("string")
    rows = pages(s, d).withColumn("k", F.col("page_id")).select("page_id", "k", F.coalesce("html", F.lit("")).alias("html"))
    title = F.expr("case when k % 30 = 7 then '<META property=og:title>' when k % 6 = 0 then '' when k % 6 = 1 then concat('<meta content=\"Telegram: Contact @page', k, '\" property=\"og:title\">') else concat('<meta property=\"og:title\" content=\"Page ', k, ' &amp; more\"/>') end")
    about = F.when(c("k") % 4 > 0, F.concat(F.lit("<meta property='og:description' content='about >"), text("k"), F.lit("'>"))).otherwise("")
    span = lambda name, x: F.concat(F.lit(f'<span class="{name}">'), x, F.lit("</span>"))
    count = lambda value, kind: F.concat(F.lit('<div class="x tgme_channel_info_counter">'), span("counter_value", value), F.lit(" "), span("counter_type", F.lit(kind)), F.lit("</div>"))
    counts = F.concat(count(F.concat(text("k"), F.lit(".5K")), "subscribers"), count(F.lit("99"), "photos"), F.when(c("k") % 7 == 0, count(F.lit("1,234"), "Members")).when(c("k") % 7 == 1, count(F.lit("12x"), "subscribers")).otherwise(""))
    info = F.when(c("k") % 3 > 0, F.concat(F.lit("<div class=tgme_channel_info><p>"), counts, F.lit("</div>"))).otherwise("")
    extra = F.when(c("k") % 5 == 0, F.concat(F.lit('<div class="tgme_page_extra">'), (c("k") % 9 + 1).cast("string"), F.lit(" 305 members, 7 online</div>"))).otherwise("")

    def post(number, body, views, at):
        return F.concat(
            F.lit('<div class="tgme_widget_message js" data-post="page/'), number, F.lit('"><div class="in"><div class="tgme_widget_message_text">'), body,
            F.lit("</div></div><!-- </div> -->"), span("tgme_widget_message_views", views), at, F.lit("</div>"),
        )

    time = lambda day: F.concat(F.lit('<a><time datetime="2024-01-0'), day, F.lit('T10:00:00+00:00">'), day, F.lit("</time></a>"))
    each = lambda i: post(i.cast("string"), F.concat(F.lit("post "), i.cast("string"), F.lit(" of <b><i>"), text("k"), F.lit("</b>&lt;b&gt;<br>line")), F.concat(i.cast("string"), F.lit("."), (c("k") % 10).cast("string"), F.lit("K")), time(i.cast("string")))
    some = F.array_join(F.transform(F.when(c("k") % 5 > 0, F.sequence(F.lit(1), (c("k") % 5).cast("int"))).otherwise(F.array().cast("array<int>")), each), "\n")
    raw = post(F.lit("99"), c("html"), F.lit("0"), F.lit(""))
    last = post(F.lit("100"), F.lit(" last "), F.lit("7"), time(F.lit("9")))
    page = F.concat(title, about, info, extra, some, raw, last)
    return rows.select("page_id", P.elements(page, P.PREVIEW).alias("found"))


@query(f"""with t as (select page_id, {TITLE} title, page_id % 5 n, case when page_id % 4 > 0 then 'about >' || page_id else '' end about from pages),
    e as (select *, title is not null and (about <> '' or (title <> '' and not starts_with(title, 'Telegram'))) ok from t),
    x as (select *, ok and (page_id % 3 > 0 or page_id % 5 = 0) chan, list_sum(list_transform(range(1, n + 1), lambda i: trunc((i || '.' || (page_id % 10))::double * 1000))) views from e)
    select page_id, ok as "exists", chan is_channel, chan and page_id % 5 = 0 is_group, case when ok then title else '' end title, case when ok then about else '' end description,
    case when not chan then 0 when page_id % 5 = 0 then (page_id % 9 + 1) * 1000 + 305 when page_id % 7 = 0 then 1234 else page_id * 1000 + 500 end::bigint member_count,
    case when chan then floor((coalesce(views, 0) + 7) / (n + 1)) else 0 end::bigint avg_views from x""")
def src9_previews(s, d):
    name = F.concat(F.lit("page"), c("page_id").cast("string"))
    return _previews(s, d).select("page_id", P.preview(c("found"), name).alias("x")).select("page_id", "x.*")


@query("""with t as (select page_id, unnest(list_concat(range(1, page_id % 5 + 1), [100])) message_id from pages)
    select page_id, message_id, case when message_id = 100 then 'last' else 'post ' || message_id || ' of ' || page_id || '<b>line' end "text",
    make_timestamp(2024, 1, case when message_id = 100 then 9 else message_id end, 10, 0, 0.0) "at", case when message_id = 100 then 7 else trunc((message_id || '.' || (page_id % 10))::double * 1000) end::bigint "views" from t""")
def src9_posts(s, d):
    return P.posts(_previews(s, d), ["page_id"], "found").withColumn("at", c("at").cast("timestamp_ntz"))


@query("""with t as (select page_id, coalesce(html, '') h, regexp_extract(coalesce(url, ''), '^https?://([^/?#]*)', 1) host from pages),
    x as (select *, trim(replace(replace(replace(replace(regexp_extract(h, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) title, regexp_extract_all(h, '<a href="([^"]*)"', 1) links from t)
    select page_id, case when title = '' then host else title end title, '' description, len(links)::int n_links, array_to_string(links, ' ') links from x""")
def src8_sites(s, d):
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^https?://([^/?#]*)", 1)
    rows = pages(s, d).select("page_id", host.alias("host"), P.elements(c("html"), P.PROFILE, ended=True).alias("found"))
    return rows.select("page_id", P.profile(c("found"), c("host"), by_title=True).alias("x")).select("page_id", "x.title", "x.description", F.size("x.links").alias("n_links"), F.array_join("x.links", " ").alias("links"))


@query("""with t as (select page_id, page_id % 4 n, ['tiktok', 'facebook'][1 + page_id % 2] platform from pages)
    select page_id, platform, platform || ':user' || page_id canonical_id, case when n = 3 then 'user' || page_id else 'User ' || page_id || ' <gold>' end title,
    case when page_id % 5 = 0 then '' when page_id % 5 = 1 then 'plain' else 'trades ' || n end description, n + (page_id % 3 > 0)::int bridges,
    case (n < 3)::int + (page_id % 5 > 1)::int when 0 then 0 when 1 then 30 else 40 end relevance from t""")
def src10_profiles(s, d):
    """Profiles of two platforms: title, description, bridges to other platforms, relevance."""
    k, n = c("page_id").cast("string"), c("page_id") % 4
    title = F.when(n < 3, F.concat(F.lit('<meta property="og:title" content=" User '), k, F.lit(' &lt;gold&gt; ">'))).otherwise("")
    rich = F.when(c("page_id") % 5 > 1, F.concat(F.lit('<meta property="og:description" content="trades '), n.cast("string"), F.lit('">'))).otherwise("")
    plain = F.when(c("page_id") % 5 > 0, F.lit('<meta name="description" content="plain">')).otherwise("")
    links = F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.when(i > 0, F.concat(F.lit('<a href="https://t.me/channel'), i.cast("string"), F.lit('">in</a><a href="https://t.me/channel'), i.cast("string"), F.lit('">again</a>'))).otherwise("")), "")
    site = F.when(c("page_id") % 3 > 0, F.lit('<a href="https://signals.example.info/x">site</a>')).otherwise("")
    platform = F.when(c("page_id") % 2 == 0, "tiktok").otherwise("facebook")
    rows = pages(s, d).select(
        "page_id", platform.alias("platform"), F.concat(platform, F.lit(":user"), k).alias("canonical_id"),
        F.concat(title, rich, plain, links, site, F.regexp_replace(F.coalesce("html", F.lit("")), "https?://", "")).alias("page"),
    )
    rows = rows.withColumn("found", P.elements(c("page"), P.PROFILE)).withColumn("x", P.profile(c("found"), F.concat(F.lit("user"), k)))
    bridges = M.cross_links(rows.select("page_id", "canonical_id", F.concat_ws(" ", "x.title", "x.description", "page").alias("body")), "page_id", "body", c("canonical_id"))
    hits = sum((F.lower(F.concat_ws(" ", "x.title", "x.description")).contains(w).cast("int") for w in ("gold", "trades")), F.lit(0))
    known = rows.select("page_id", "platform", "canonical_id", "x.title", "x.description", candidate_relevance(hits).alias("relevance"))
    found = bridges.groupBy("page_id").agg(F.count("*").cast("int").alias("bridges"))
    return known.join(found, "page_id", "left").fillna(0, ["bridges"])
