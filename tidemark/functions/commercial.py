"""Scorecards fed from texts: language, region, intent, business models and commercial activity.

Lexica are the caller's: lists of terms, or patterns. Null texts have no hits, null counts are 0.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ladders import clamp, ladder
from .scores import _n, _points, recurrence
from .text import has_word, script_ratio

ARABIC_TEXT = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
#: fixed values: points of each business model, tiers of the legacy score
MODEL_POINTS = {"vip_subscription": 12, "copy_trading_portfolio": 10, "broker_affiliate_ib": 10, "prop_firm_challenges": 8, "academy_courses": 8}
LEGACY_TIERS = [(75, "Tier 1"), (50, "Tier 2"), (30, "Tier 3")]


def has_any(c: Column, terms: list[str]) -> Column:
    """Whether any term is a substring of the lower-case text."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    return reduce(or_, [lower.contains(t.lower()) for t in terms], F.lit(False))


def distinct_words(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur as whole words."""
    return sum((F.coalesce(has_word(c, t).cast("int"), F.lit(0)) for t in terms), F.lit(0))


def first_stage(title: Column, about: Column, name: Column, terms: list[str], community: list[str]) -> Column:
    """SC15: struct (pass, reason, score) from metadata alone: only bot names fail. 25 a term of the lexicon
    (100 at most), 40 for a mostly Arabic text with a word of ``community``, else 20."""
    text = F.lower(F.concat_ws(" ", title, about, name))
    hits = sum((F.when(text.contains(t.lower()), 1).otherwise(0) for t in terms), F.lit(0))
    out = lambda ok, reason, score: F.struct(F.lit(ok).alias("pass"), F.lit(reason).alias("reason"), score.cast("int").alias("score"))
    community_like = (script_ratio(text) > 0.4) & has_any(text, community)
    return F.when(name.endswith("bot"), out(False, "bot", F.lit(0))).when(hits >= 1, out(True, "terms", F.least(F.lit(100), hits * 25))).when(community_like, out(True, "community", F.lit(40))).otherwise(out(True, "second stage", F.lit(20)))


def intent_score(core: Column, signals: Column, business: list[Column], phone: Column, contact: Column, website: Column, bonus: Column) -> Column:
    """SC17: 10 a core word (40 at most), 5 a signal word (30), 10 each kind of business, trust of 4, 3
    and 3 for phone, contact and website, and the method's bonus; 0 without a core or a signal word."""
    total = F.least(F.lit(40), _n(core) * 10) + F.least(F.lit(30), _n(signals) * 5) + _points(*[(b, 10) for b in business], (phone, 4), (contact, 3), (website, 3)) + _n(bonus)
    return F.when((_n(core) > 0) & (_n(signals) > 0), clamp(total)).otherwise(0)


def arabic_score(title: Column, about: Column, arabic_posts: Column, posts: Column, gulf_phone: Column, support_words: Column, any_contact: Column) -> Column:
    """SC18: 20 for the title, 20 for the description, up to 40 for the share of posts, and 20 for a contact:
    a phone of the region, support words, or any contact where title or description is Arabic."""
    t, a = (F.coalesce(x.rlike(ARABIC_TEXT), F.lit(False)) for x in (title, about))
    yes = lambda x: F.coalesce(x, F.lit(False))
    reach = yes(gulf_phone) | yes(support_words) | (yes(any_contact) & (t | a))
    return F.least(F.lit(100), _points((t, 20), (a, 20), (reach, 20)) + recurrence(arabic_posts, posts, 40))


def region_score(text: Column, phone: Column, countries: dict[str, tuple[list[str], str]]) -> Column:
    """SC19: 20 a country named in the text or by its phone prefix, and 40 more for the prefix.

    ``countries`` has the words and the prefix (with ``+``) of each country.
    """
    dialled = [F.coalesce(F.startswith(phone, F.lit(prefix)), F.lit(False)) for _, prefix in countries.values()]
    named = [has_any(text, words) | d for (words, _), d in zip(countries.values(), dialled, strict=True)]
    return F.least(F.lit(100), _points(*[(x, 20) for x in named], *[(x, 40) for x in dialled]))


def legacy_score(members: Column, ratio: Column, contact: Column, vip: Column, accounts: Column, copying: Column, signals: Column, recent: Column) -> Column:
    """SC23: struct (score, tier) from language share, size, contact, offers and activity."""
    size = ladder(_n(members), [(10000, 25), (3000, 20), (1000, 15), (300, 10), (50, 5)])
    score = ladder(F.coalesce(ratio, F.lit(0.0)), [(0.60, 25), (0.30, 15), (0.10, 5)]) + size + _points((contact, 20), (vip, 8), (accounts, 6), (copying, 4), (signals, 2), (recent, 10))
    return F.struct(F.least(F.lit(100), score).alias("score"), ladder(score, LEGACY_TIERS, "Unqualified").alias("tier"))


def business_models(flags: dict[str, Column]) -> Column:
    """SC26: struct (models, score): the models that hold, in their fixed order, and their points, 20 at most."""
    models = F.array_compact(F.array(*[F.when(flags[k], F.lit(k)) for k in MODEL_POINTS]))
    return F.struct(models.alias("models"), F.least(F.lit(20), _points(*[(flags[k], p) for k, p in MODEL_POINTS.items()])).alias("score"))


def broker_model(text: Column, explicit: list[str], brokers: list[str], ib_context: list[str], name_context: list[str]) -> Column:
    """SC26: whether a text shows a broker affiliation: explicit words, the abbreviation or a known name in context."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    ib = lower.rlike(r"\b(ib|introducing\s*broker)\b") & has_any(text, ib_context)
    named = lower.rlike(r"\b(" + "|".join(re.escape(b.lower()) for b in brokers) + r")\b") & has_any(text, name_context)
    return has_any(text, explicit) | ib | named


def commercial_activity(promos: Column, ctas: Column, payments: Column, models: Column, bio_cta: Column, private_link: Column) -> Column:
    """SC27: promoting posts 15 or 10, calls to action 10 or 6, payment methods 8, a private link 4; 35 at most."""
    p = F.when((_n(promos) >= 3) | ((_n(models) >= 1) & (_n(promos) >= 1)), 15).when(_n(promos) >= 1, 10).otherwise(0)
    a = F.when((_n(ctas) >= 2) | (F.coalesce(bio_cta, F.lit(False)) & (_n(models) >= 1)), 10).when(_n(ctas) >= 1, 6).otherwise(0)
    return F.least(F.lit(35), p + a + _points((_n(payments) > 0, 8), (private_link, 4)))


def complexity(day: Column, week: Column, sampled: Column, setups: Column, analysis: Column, links: Column) -> Column:
    """SC28: posting volume 5, 3 or 2, structured posts 4 or 2, mixed content 3 or 2, two links and more 3; 15 at most."""
    volume = F.when((_n(day) >= 6) | (_n(week) >= 30), 5).when((_n(day) >= 2) | (_n(week) >= 10), 3).when(_n(sampled) >= 15, 2).otherwise(0)
    mixed = F.when(analysis & (_n(setups) >= 1), 3).when(analysis, 2).otherwise(0)
    return F.least(F.lit(15), volume + ladder(_n(setups), [(3, 4), (1, 2)]) + mixed + _points((_n(links) >= 2, 3)))


def services(models: Column, commercial: Column, complex_: Column, promos: Column, day: Column, week: Column, analysis: Column) -> Column:
    """SC29: the services that fit, in fixed order; ``none`` alone without any."""
    n, has = F.size(models), lambda m: F.array_contains(models, m)
    rules = {
        "channel_management": (complex_ >= 6) | ((_n(day) >= 4) & (_n(promos) >= 1)) | ((n >= 1) & (_n(week) >= 15)),
        "advertising_management": (commercial >= 18) | has("vip_subscription"),
        "growth_marketing": (n >= 1) & ((commercial >= 12) | (_n(promos) >= 2)),
        "verification": (n >= 2) & (commercial >= 20),
        "account_management": has("copy_trading_portfolio"),
        "partnerships": has("broker_affiliate_ib") | has("prop_firm_challenges"),
        "content_media": analysis & (_n(week) >= 15),
    }
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found)


def commercial_freshness(days: Column, live_bio: Column) -> Column:
    """SC29: 5 to 0 by days since the last commercial post; without one, 5 for a commercial description."""
    aged = ladder(F.greatest(days, F.lit(0.0)), [(3, 5), (7, 4), (14, 3), (30, 2), (60, 1)], descending=False)
    return F.when(days.isNotNull(), aged).when(live_bio, 5).otherwise(0)


def inference_confidence(models: Column, promos: Column, payments: Column, setups: Column) -> Column:
    """SC29: 0.45 and 0.12 a signal, within 0.40 and 0.98."""
    signals = _n(models) + _points((_n(promos) > 0, 1), (_n(payments) > 0, 1), (_n(setups) > 0, 1))
    return F.round(clamp(F.lit(0.45) + signals * 0.12, 0.40, 0.98), 2)
