"""What messages refer to: contacts, links to other platforms, edges, labels and routes.

Everything here is a column expression or a narrow transformation, but for the one grouping of
``label_references``. Null texts read as empty and give no rows, or nulls in every field.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: links of each platform, in order: platform, pattern of the handle, least length, confidence, relation
PLATFORMS = (
    ("telegram", r"(?i)(?:https?://)?(?:t\.me|telegram\.me)/(?:joinchat/)?\+?([a-zA-Z0-9_.-]{4,32})", 4, 95, "link"),
    ("tiktok", r"(?i)(?:https?://)?(?:www\.)?tiktok\.com/@([a-zA-Z0-9_.-]{2,32})", 3, 95, "social_link"),
    ("facebook", r"(?i)(?:https?://)?(?:www\.|m\.)?facebook\.com/(?:pages/|groups/)?([a-zA-Z0-9_.-]{3,64})", 3, 95, "social_link"),
    ("web", r"(?i)https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+/[a-zA-Z0-9_.~!*'();:@&=+$,/?%#-]*|[a-zA-Z0-9-]+\.[a-zA-Z]{2,})", 4, 90, "external_site"),
)
# fixed values: hosts, sites and patterns of contacts
SOCIAL_HOSTS = ("t.me", "telegram.me", "tiktok.com", "facebook.com", "wa.me", "whatsapp.com")
SOCIAL_SITES = ("instagram.com", "youtube.com", "twitter.com", "x.com", "tiktok.com", "facebook.com")
WEBSITE = r"(?i)https?://(?:www\.)?(?!t\.me|telegram\.(?:me|dog|org|space)|wa\.me|api\.whatsapp\.com|whatsapp\.com)([a-zA-Z0-9-]+\.[a-zA-Z]{2,6}[^\s]*)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
DIRECT_PHONE = r"(?i)(?:wa\.me/|api\.whatsapp\.com/send\?phone=|whatsapp:)\+?([0-9]{9,16})"
COUNTRY_PHONE = r"\+?(?:966|971|965|968|973|962|961|963|967|964|20|90|44|1)[0-9\s-]{7,15}"
PHONE_WORDS = ("واتس", "whatsapp", "هاتف", "phone")
HANDLE = r"(?i)(?:@|t\.me/|telegram\.me/|resolve\?domain=)([a-z0-9_]{3,32})"
CLASSES = ("owner", "admin", "analyst", "contact")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first(c: Column, pattern: str, group: int) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(_text(c), pattern, group), F.lit(""))


def websites(c: Column) -> Column:
    """TX5: struct of the first website, the first link hub, and the distinct social links in order."""
    urls = F.transform(F.regexp_extract_all(_text(c), F.lit(WEBSITE), F.lit(1)), lambda u: F.regexp_replace(F.concat(F.lit("https://"), u), r"""[.,;)!}"']+$""", ""))
    has = lambda u, names: F.lower(u).rlike("|".join(n.replace(".", r"\.") for n in names))
    hub = F.filter(urls, lambda u: has(u, ["linktr.ee"]))
    social = F.filter(urls, lambda u: has(u, SOCIAL_SITES) & ~has(u, ["linktr.ee"]))
    site = F.filter(urls, lambda u: ~has(u, [*SOCIAL_SITES, "linktr.ee"]))
    return F.struct(F.get(site, F.lit(0)).alias("website"), F.get(hub, F.lit(0)).alias("link_hub"), F.array_distinct(social).alias("social"))


def contact_links(c: Column) -> Column:
    """TX5: array of (type, value, confidence) in order: every link hub (95), each social link once (90), the first website (90)."""
    urls = F.transform(F.regexp_extract_all(_text(c), F.lit(WEBSITE), F.lit(1)), lambda u: F.regexp_replace(F.concat(F.lit("https://"), u), r"""[.,;)!}"']+$""", ""))
    social = "|".join(n.replace(".", r"\.") for n in SOCIAL_SITES)
    kind = lambda u: F.when(F.lower(u).contains("linktr.ee"), "linktree").when(F.lower(u).rlike(social), "social").otherwise("website")
    found = F.transform(urls, lambda u: F.struct(kind(u).alias("type"), u.alias("value"), F.when(kind(u) == "linktree", 95).otherwise(90).alias("confidence")))
    site = F.array_position(F.transform(found, lambda x: x["type"]), F.lit("website"))
    first = lambda x, i: F.when(x["type"] == "website", site == i + 1).when(x["type"] == "social", F.array_position(urls, x["value"]) == i + 1).otherwise(F.lit(True))
    return F.filter(found, first)


def email(c: Column) -> Column:
    """TX6: the first address, in lower case; null without one."""
    return F.lower(_first(c, EMAIL, 0))


def phone(c: Column) -> Column:
    """TX7: struct of number and confidence: a direct link (100), else a country-prefixed number of
    eight digits and more if a phone word is anywhere in the text (85), else nulls."""
    direct = _first(c, DIRECT_PHONE, 1)
    loose = F.regexp_replace(_first(c, COUNTRY_PHONE, 0), r"[\s+-]", "")
    loose = F.when(F.lower(_text(c)).rlike("|".join(PHONE_WORDS)) & (F.length(loose) >= 8), loose)
    return F.struct(F.coalesce(direct, loose).alias("number"), F.when(direct.isNotNull(), 100).when(loose.isNotNull(), 85).alias("confidence"))


def contacts(pinned: Column, bio: Column, text: Column, channel: Column, triggers: dict[str, str], junk: tuple[str, ...] = ()) -> Column:
    """TX4: struct (owner, admin, analyst, contact, bot, confidence) of the handles in a channel's texts.

    Lines are read in the order pinned, bio, text; a line's class follows from the patterns of
    ``triggers`` (keys as in ``CLASSES``) on it and the non-empty line before it. The first handle
    of a class wins, a later one falls to the next class of its line. Without any, the first
    handle of no class is the contact (confidence 70). An empty contact is filled from owner,
    admin or analyst. The channel's own name and ``junk`` are passed over.
    """
    own = F.regexp_replace(F.lower(F.trim(_text(channel))), "^@", "")

    def handles(c: Column) -> Column:
        lines = F.filter(F.transform(F.split(_text(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
        # each line with the one before it; the line itself is what handles are taken from
        pairs = F.zip_with(lines, F.slice(F.concat(F.array(F.lit("")), lines), 1, F.size(lines)), lambda x, y: F.struct(x.alias("line"), F.concat_ws(" ", y, x).alias("seen")))
        return F.flatten(F.transform(pairs, lambda p: F.transform(F.regexp_extract_all(p["line"], F.lit(HANDLE), F.lit(1)), lambda h: F.struct(h.alias("h"), *[p["seen"].rlike(f"(?i){triggers[k]}").alias(k) for k in CLASSES]))))

    every = F.filter(F.concat(handles(pinned), handles(bio), handles(text)), lambda e: (F.lower(e["h"]) != own) & ~F.lower(e["h"]).isin(*junk, ""))
    none = F.lit(None).cast("string")

    def fold(s: Column, e: Column) -> Column:
        bot = F.lower(e["h"]).endswith("bot")
        taken, out = bot, {}
        for k in CLASSES:
            here = ~taken & e[k] & s[k].isNull()
            out[k], taken = F.when(here, e["h"]).otherwise(s[k]), taken | here
        out["bot"] = F.when(bot & s["bot"].isNull(), e["h"]).otherwise(s["bot"])
        out["loose"] = F.when(~taken & s["loose"].isNull(), e["h"]).otherwise(s["loose"])
        return F.struct(*[v.alias(k) for k, v in out.items()])

    def finish(s: Column) -> Column:
        first = F.coalesce(s["owner"], s["admin"], s["analyst"])
        sure = F.when(s["owner"].isNotNull(), 95).when(F.coalesce(s["admin"], s["analyst"]).isNotNull(), 90).when(s["contact"].isNotNull(), 85).when(s["loose"].isNotNull(), 70)
        return F.struct(s["owner"].alias("owner"), s["admin"].alias("admin"), s["analyst"].alias("analyst"), F.coalesce(s["contact"], first, s["loose"]).alias("contact"), s["bot"].alias("bot"), sure.alias("confidence"))

    return F.aggregate(every, F.struct(*[none.alias(k) for k in (*CLASSES, "bot", "loose")]), fold, finish)


def contact_mention(text: Column, handle: Column, trigger: str) -> Column:
    """TX8: whether a trigger stands on a line with the handle, or 80 characters before to 40 after it."""
    name = F.concat(F.lit(r"\Q"), F.regexp_replace(handle, "^@", ""), F.lit(r"\E\b"))
    at = F.concat(F.lit("(?:@"), name, F.lit("|(?<!@)"), name, F.lit(")"))
    line = F.exists(F.split(_text(text), "\n"), lambda x: F.rlike(x, F.concat(F.lit("(?i)"), name)) & x.rlike(f"(?i){trigger}"))
    before = F.rlike(_text(text), F.concat(F.lit(f"(?is)(?=(?:{trigger}))(?=.{{0,80}}"), at, F.lit(")")))  # the rare trigger first
    after = F.exists(F.regexp_extract_all(_text(text), F.concat(F.lit("(?is)(?=("), at, F.lit(".{0,40}))."))), lambda x: x.rlike(f"(?i){trigger}"))
    return F.coalesce(line | before | after, F.lit(False))


def cross_links(df: DataFrame, key: str, text: str, source: Column, handle_stop: tuple[str, ...] = (), domain_stop: tuple[str, ...] = ()) -> DataFrame:
    """TX9: one row (key, target, platform, relation, confidence) per distinct platform link of a row's text.

    Targets are canonical (``platform:name``); a row's own ``source`` id is dropped, and so are
    names of ``handle_stop``, bots, social hosts among the websites, and ``domain_stop`` with
    subdomains. TX10: ``www.`` is removed as a prefix, not as a set of characters.
    """
    unwanted = "|".join([*map(re.escape, SOCIAL_HOSTS), *(rf"(^|\.){re.escape(d)}$" for d in domain_stop)])
    found = []
    for platform, pattern, least, confidence, relation in PLATFORMS:
        names = F.transform(F.regexp_extract_all(_text(F.col(text)), F.lit(pattern), F.lit(1)), F.lower)
        if platform == "web":
            names = F.transform(names, lambda x: F.regexp_replace(x, r"/.*$|^www\.", ""))
            names = F.filter(names, lambda x: (F.length(x) >= least) & ~x.rlike(unwanted))  # noqa: B023
        else:
            names = F.filter(names, lambda x: (F.length(x) >= least) & ~x.isin(*handle_stop, "") & ~(x.endswith("bot") if platform == "telegram" else F.lit(False)))  # noqa: B023
        found.append(F.transform(F.array_distinct(names), lambda x: F.struct(F.concat(F.lit(f"{platform}:"), x).alias("target"), F.lit(platform).alias("platform"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))))  # noqa: B023
    kept = F.filter(F.concat(*found), lambda x: ~x["target"].eqNullSafe(source))
    return df.select(key, F.explode(kept).alias("_x")).select(key, "_x.*")


def message_edges(df: DataFrame, source: str, text: str, forward: Column, promo: str, trigger: str) -> DataFrame:
    """TX12: (source, target, relation, confidence) per reference of a message: its forward origin 95,
    links 85 in a promoting text and 75 in others, mentions 70 unless they name a contact (TX8)."""
    c = _text(F.col(text))
    edge = lambda target, relation, confidence: F.struct(F.lower(target).alias("target"), F.lit(relation).alias("relation"), confidence.alias("confidence"))
    forwards = F.when(forward.isNotNull(), F.array(edge(forward, "forward", F.lit(95)))).otherwise(F.array().cast("array<struct<target string, relation string, confidence int>>"))
    links = F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(PLATFORMS[0][1]), F.lit(1))), lambda x: edge(x, "link", F.when(c.rlike(f"(?i){promo}"), 85).otherwise(75)))
    mentions = F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\w.])@(\w{4,32})"), F.lit(1))), lambda x: ~contact_mention(c, x, trigger))
    mentions = F.transform(mentions, lambda x: edge(x, "mention", F.lit(70)))
    return df.select(source, F.explode(F.array_distinct(F.concat(forwards, links, mentions))).alias("_x")).select(source, "_x.*")


def recommendation_edges(df: DataFrame, source: str, target: str, unwanted: Column) -> DataFrame:
    """TX12: (source, target, relation, confidence) of a platform's recommendations, at 90; repeats come once.

    A recommendation without a name, of the channel itself, or ``unwanted`` gives no edge; where ``unwanted`` is null it holds not.
    """
    name, own = F.lower(F.trim(_text(F.col(target)))), F.lower(F.trim(_text(F.col(source))))
    kept = df.filter((name != "") & (name != own) & ~F.coalesce(unwanted, F.lit(False)))
    return kept.select(source, name.alias("target"), F.lit("recommendation").alias("relation"), F.lit(90).alias("confidence")).distinct()


def forward_summary(df: DataFrame, key: str, origin: Column, order: str, k: int = 5) -> DataFrame:
    """AG18: (key, messages, forwarded, ratio, origins) of each channel; ``origin`` as of ``forward_origin``, null for own messages.

    An origin goes by its name, else channel id, else peer id, else ``unknown``. ``origins`` holds the ``k`` most frequent
    as (origin, n), ties by the least ``order``. The ratio has three places. Messages are counted by channel and origin
    before the shuffle, and only ``k`` origins a task are ranked, so a hot channel sends counts.
    """
    from tidemark.operators.views import top_per_group

    some = lambda f: F.nullif(origin[f], F.lit(""))
    name = F.when(origin.isNotNull(), F.coalesce(some("name"), some("channel_id"), some("peer_id"), F.lit("unknown")))
    n = df.select(key, name.alias("_o"), F.col(order).alias("_at")).groupBy(key, "_o").agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))
    total = n.groupBy(key).agg(F.sum("_n").alias("messages"), F.coalesce(F.sum(F.when(F.col("_o").isNotNull(), F.col("_n"))), F.lit(0)).alias("forwarded"))
    top = top_per_group(n.filter("_o is not null"), [key], [F.desc("_n"), F.col("_at")], k)
    top = top.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("_m"), "_at", F.col("_o").alias("origin"), F.col("_n").alias("n")))).alias("_t"))
    origins = F.coalesce(F.transform("_t", lambda x: F.struct(x["origin"].alias("origin"), x["n"].alias("n"))), F.array().cast("array<struct<origin:string,n:bigint>>"))
    return total.join(top, total[key].eqNullSafe(top["_k"]), "left").select(total[key], "messages", "forwarded", F.bround(F.col("forwarded") / F.col("messages"), 3).alias("ratio"), origins.alias("origins"))


#: what is known of a forwarded message; ids are strings
FORWARD = """struct<from_id:struct<channel_id:string,user_id:string,chat_id:string>,saved_from_peer:struct<channel_id:string>,
    channel_post:bigint,saved_from_msg_id:bigint,from_name:string,from_username:string,chat_username:string,date:timestamp_ntz>"""


def forward_origin(header: Column, message_id: Column) -> Column:
    """TX11: struct (channel_id, peer_id, post_id, name, username, message_id, observed_at) of a forward header
    in the form of ``FORWARD``; null for messages that are no forwards.

    The channel comes from the sender, else the saved peer; the post from the channel post, else the
    saved message; the user name from the chat, else the header, else ``@name`` or a link in the
    sender's name. Without a date ``observed_at`` is null, as "now" is never read here.
    """
    some = lambda x: F.nullif(x, F.lit(""))
    sender = some(header["from_id"]["channel_id"])
    saved = some(header["saved_from_peer"]["channel_id"])
    person = F.coalesce(some(header["from_id"]["user_id"]), some(header["from_id"]["chat_id"]))
    post = F.coalesce(F.nullif(header["channel_post"], F.lit(0)), F.nullif(header["saved_from_msg_id"], F.lit(0)))
    name = F.trim(header["from_name"])
    named = F.when(name.startswith("@"), some(F.substr(name, F.lit(2)))).otherwise(_first(name, r"t\.me/([a-zA-Z0-9_]{5,32})", 1))
    user = F.coalesce(some(header["chat_username"]), some(F.regexp_replace(header["from_username"], "^@+", "")), named)
    return F.when(header.isNotNull(), F.struct(
        F.coalesce(sender, saved).alias("channel_id"), F.coalesce(sender, saved, person).alias("peer_id"), post.alias("post_id"),
        header["from_name"].alias("name"), user.alias("username"), message_id.alias("message_id"), header["date"].alias("observed_at"),
    ))


def label_references(df: DataFrame, source: str, target: str, kind: Column, order: Column, promo: Column) -> DataFrame:
    """TX13: one label for each (source, target): ``advertisement`` if the deciding reference promotes,
    else its kind. A link beats mentions; the last link and else the first mention decides.

    ``kind`` is link or mention, ``order`` a number; of equal ones a promoting reference decides.
    """
    is_link = kind == "link"
    rank = F.struct(is_link.alias("k"), F.when(is_link, order).otherwise(-order).alias("o"), promo.alias("p"))
    label = F.when(promo, "advertisement").otherwise(kind)
    return df.groupBy(source, target).agg(F.max_by(label, rank).alias("label"))


def route(urgent: Column, exchange_list: Column, exchange: Column, trusted: Column, important: Column, label: Column) -> Column:
    """TX14: struct (queue, method, weight) of a reference; the first rule that holds decides, nulls are false."""
    ways = ((exchange_list, "critical", "ad_exchange_feedback", 30), (urgent, "critical", "ad_copywriting_pattern", 25), (exchange, "critical", "ad_exchange_feedback", 30), (trusted, "critical", "verified_partner", None))
    plain = F.when(label.eqNullSafe("advertisement"), "advertisement").otherwise("channel_mention")
    out = F.struct(F.when(important | label.eqNullSafe("advertisement"), "high").otherwise("normal").alias("queue"), plain.alias("method"), F.lit(None).cast("int").alias("weight"))
    for test, queue, method, weight in reversed(ways):
        out = F.when(test, F.struct(F.lit(queue).alias("queue"), F.lit(method).alias("method"), F.lit(weight).cast("int").alias("weight"))).otherwise(out)
    return out
