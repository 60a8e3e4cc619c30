"""Scorecards over counts, as column expressions. Null counts score as 0; scores are whole numbers from 0 to 100.

Word lists are the caller's: count hits with ``functions.text`` and pass the counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ladders import DISCOVERY, RISK_LEVELS, clamp, ladder, whole

# fixed values: weights of the composite, crawl tiers and their base intervals in minutes
WEIGHTS = {
    "topic": 0.28, "gold": 0.14, "signal": 0.14, "method": 0.10, "script": 0.10, "activity": 0.05, "freshness": 0.05,
    "growth": 0.05, "discovery": 0.04, "commercial": 0.03, "contact": 0.02, "new_channel": 0.08,
}
CRAWL_MINUTES = {"HOT": 240, "WARM": 1080, "NORMAL": 4320, "COLD": 14400, "DORMANT": 43200}


def _n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _points(*hits: tuple[Column, int]) -> Column:
    """Sum of the points whose condition holds; an unknown condition does not."""
    out = F.lit(0)
    for hit, points in hits:
        out = out + F.when(hit, points).otherwise(0)
    return out


def recurrence(hits: Column, posts: Column, most: int) -> Column:
    """``most`` times the share of posts with a hit, truncated."""
    return whole(_n(hits) / F.greatest(F.lit(1), _n(posts)) * most)


def topic_score(terms: Column, pairs: Column, topic_posts: Column, posts: Column, in_bio: Column) -> Column:
    """SC1: breadth of vocabulary and recurrence; a lone mention among five posts and more scores 15."""
    lone = (_n(terms) + _n(pairs) == 1) & (_n(topic_posts) <= 1) & ~F.coalesce(in_bio, F.lit(False)) & (_n(posts) >= 5)
    breadth = F.least(F.lit(60), _n(terms) * 12 + _n(pairs) * 10)
    breadth = F.when(in_bio, F.least(F.lit(60), breadth + 15)).otherwise(breadth)
    return F.when(lone, 15).otherwise(F.least(F.lit(100), breadth + F.least(F.lit(40), recurrence(topic_posts, posts, 60))))


def gold_score(terms: Column, gold_posts: Column, posts: Column, core_term: Column) -> Column:
    """SC2: 18 a term, 30 at least with the core term, and recurrence."""
    breadth = _n(terms) * 18
    return F.least(F.lit(100), F.when(core_term, F.greatest(F.lit(30), breadth)).otherwise(breadth) + recurrence(gold_posts, posts, 50))


def method_score(styles: Column, methods: Column) -> Column:
    """SC3."""
    return F.least(F.lit(100), _n(styles) * 15 + _n(methods) * 18)


def signal_score(terms: Column, signal_posts: Column, posts: Column, has_targets: Column) -> Column:
    """SC4: 15 a term, 25 for a stop or target, and recurrence."""
    return F.least(F.lit(100), _n(terms) * 15 + _points((has_targets, 25)) + recurrence(signal_posts, posts, 50))


def script_score(ratio: Column, terms: Column) -> Column:
    """SC5: share of the script's letters in percent, lifted by vocabulary in mixed texts."""
    base, v = whole(F.coalesce(ratio, F.lit(0.0)) * 100), _n(terms)
    lifted = F.when((ratio >= 0.15) & (v >= 2), 65 + F.least(F.lit(30), v * 5)).when((ratio >= 0.05) & (v >= 1), 45).when(v >= 3, 50).otherwise(0)
    return clamp(F.greatest(base, lifted))


def commercial_score(services: Column, firms: Column) -> Column:
    """SC6, first part."""
    return F.least(F.lit(100), (_n(services) + _n(firms)) * 15)


def contact_score(has_contact: Column, kinds: Column) -> Column:
    """SC6, second part: a contact, a named person, a phone, a site."""
    has = lambda *ks: F.arrays_overlap(kinds, F.array(*map(F.lit, ks)))
    return _points((has_contact, 40), (has("owner", "admin"), 30), (has("whatsapp"), 20), (has("website", "linktree"), 10))


def discovery_score(count: Column, sources: Column) -> Column:
    """SC9: by the number of independent sources."""
    return ladder(F.greatest(_n(count), F.size(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))), DISCOVERY, 35)


def confidence_score(posts: Column, topic_posts: Column, in_bio: Column, sources: Column) -> Column:
    """SC11: how deep the evidence goes."""
    return F.least(F.lit(100), 20 + ladder(_n(posts), [(10, 25), (3, 15)]) + ladder(_n(topic_posts), [(3, 25), (1, 15)]) + _points((in_bio, 15), (sources >= 2, 15)))


def legitimacy_score(spam_hits: Column) -> Column:
    """SC12, first part: 35 off for each kind of spam."""
    return F.greatest(F.lit(0), 100 - 35 * _n(spam_hits))


def new_channel_score(created: Column, first_seen: Column, as_of: Column) -> Column:
    """SC12, second part: by whole days of age; the first sighting counts only without a creation date."""
    days = lambda t: F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / 8.64e10)
    young = F.when(days(created) <= 30, 40).when(days(created) <= 90, 25).otherwise(0)
    return F.when(created.isNotNull(), young).when(days(first_seen) <= 14, 35).otherwise(0)


def composite(parts: dict[str, Column], legitimacy: Column, any_intent: Column) -> Column:
    """SC13: the weighted sum scaled by legitimacy, truncated; at most 15 without any intent."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + _n(parts[name]) * weight
    score = clamp(whole(total * (legitimacy / 100.0)))
    return F.when(any_intent, score).otherwise(F.least(F.lit(15), score))


def topic_class(topic: Column, gold: Column, signal: Column, method: Column, script: Column, final: Column) -> Column:
    """SC14: four classes by the leading scores."""
    return (
        F.when((topic >= 60) & (final >= 50) & (script >= 15), "HIGH_CONFIDENCE")
        .when(((topic >= 35) | (gold >= 40) | (signal >= 40)) & (final >= 35), "LIKELY")
        .when(((topic >= 15) | (gold >= 20) | (signal >= 20) | (method >= 20)) & (final >= 20), "POSSIBLE")
        .otherwise("LOW_CONFIDENCE")
    )


def marketplace_score(mentions: Column, links: Column, ads: Column, promoters: Column, messages: Column, members: Column) -> Column:
    """SC24: promotion and distinct promoters a message, and a bonus for size."""
    n = F.when(messages > 0, messages)
    mix = (_n(mentions) + _n(links) * 1.5 + _n(ads) * 2.0) / n * 70 + _n(promoters) / n * 20
    size = F.when(members > 50000, 10).when(members > 20000, 7).when(members > 5000, 4).otherwise(0)
    return clamp(_n(whole(mix)) + size)


def quick_scores(hits: Column, members: Column) -> Column:
    """SC25: struct of a topic score, a lead score and a tier that needs both size and topic."""
    topic = F.when(_n(hits) > 0, F.least(F.lit(100), 40 + hits * 10)).otherwise(20)
    lead = clamp(whole(topic * 0.7 + F.least(F.lit(30), whole(_n(members) / 1000))), 10)
    tier = F.when((members >= 15000) & (topic >= 80), "A").when((members >= 2500) & (topic >= 60), "B").when((members >= 500) & (topic >= 40), "C").otherwise("D")
    return F.struct(topic.alias("topic"), lead.alias("lead"), tier.alias("tier"))


def priority(fit: Column, model: Column, complexity: Column, fresh: Column, relevance: Column, members: Column, contact: Column, models: Column) -> Column:
    """SC30: struct of the summed score and a tier P0 to P4.

    ``fit`` 0-35, ``model`` 0-20, ``complexity`` 0-15, ``fresh`` and ``contact`` 0-5, ``relevance`` 0-100,
    ``models`` the number of business models seen.
    """
    topic = clamp(whole(_n(relevance) * 0.15), 0, 15)
    audience = ladder(_n(members), [(10000, 3), (1000, 2), (100, 1)])
    total = clamp(_n(fit) + _n(model) + _n(complexity) + topic + audience + _n(fresh) + _n(contact))
    clear = models >= 1
    tier = (
        F.when((total >= 70) & clear & (contact >= 3) & (topic >= 3), "P0").when((total >= 55) & (clear | (fit >= 18)) & (topic >= 3), "P1")
        .when((total >= 38) & (clear | (fit >= 10) | (topic >= 8)), "P2").when((total >= 18) | (topic >= 8), "P3").otherwise("P4")
    )
    return F.struct(total.alias("score"), tier.alias("tier"))


def risk(health: Column, floods: Column, failures: Column, sends: Column, lead: Column, lead_failures: Column) -> Column:
    """SC31: struct of a risk score and its level; an unknown health, lead or send count adds nothing."""
    share = F.when(sends > 0, _n(failures) / sends)
    score = clamp(
        F.when(health < 50, 30).when(health < 70, 15).otherwise(0) + ladder(_n(floods), [(3, 30), (1, 15)])
        + F.when(share >= 0.3, 25).when(share >= 0.1, 10).otherwise(0)
        + F.when(lead < 25, 20).when(lead < 50, 10).when(lead < 75, 5).otherwise(0) + ladder(_n(lead_failures), [(3, 20), (1, 10)])
    )
    return F.struct(score.alias("risk"), ladder(score, RISK_LEVELS, "low").alias("level"))


def crawl_plan(final: Column, topic: Column, activity: Column, freshness: Column, growth: Column, new_channel: Column, central: Column, failures: Column, day: Column, week: Column, month: Column, hours_since: Column, marked: Column) -> Column:
    """SM2: struct of tier, interval in minutes (120 to 43200), scan depth and post budget.

    ``hours_since`` the last post is null where none is known and then counts as 0 days.
    """
    days = F.coalesce(hours_since / 24.0, F.lit(0.0))
    busy = (day >= 6) | (week >= 30) | (activity >= 80)
    fresh = (freshness >= 80) | F.coalesce(hours_since <= 24, F.lit(False))
    valued = ((final >= 65) & (topic >= 40)) | (central >= 60)
    tier = (
        F.when((days > 30) & (week == 0) & (day == 0), "DORMANT").when(valued & (busy | fresh | (new_channel >= 30)), "HOT")
        .when(((final >= 45) & (topic >= 25)) | busy | (central >= 35), "WARM").when((final >= 30) | (week >= 3) | (activity >= 40), "NORMAL")
        .when((month >= 1) | (days <= 30), "COLD").otherwise("DORMANT")
    )
    base = F.lit(None).cast("int")
    for name, minutes in CRAWL_MINUTES.items():
        base = F.when(tier == name, minutes).otherwise(base)
    factor = F.when((final >= 75) | (central >= 60), 0.75).when((final <= 25) & (central <= 15), 1.35).otherwise(1.0)
    factor = factor * F.when(growth >= 70, 0.8).otherwise(1.0) * F.when(new_channel >= 30, 0.7).otherwise(1.0)
    minutes = clamp(whole(base * factor * failure_factor(failures)), 120, 43200)
    depth = F.when(marked, "incremental").when((new_channel >= 30) | ((tier == "HOT") & (final >= 70)), "deep").when(tier.isin("WARM", "NORMAL"), "standard").otherwise("light")
    budget = F.when(depth == "incremental", 100).when(depth == "deep", 150).when(depth == "standard", 40).otherwise(15)
    return F.struct(tier.alias("tier"), minutes.alias("minutes"), depth.alias("depth"), budget.alias("budget"))


def failure_factor(failures: Column) -> Column:
    """MA3: 1.5 to the number of failures in a row, at most 4."""
    return F.when(failures > 0, F.least(F.lit(4.0), F.pow(F.lit(1.5), failures))).otherwise(F.lit(1.0))


def backoff(attempt: Column, base: float, most: float) -> Column:
    """MA3: exponential, without jitter."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt))


def throttle_step(delay: Column, ok: Column, bad: Column, floods: Column, low: float, high: float) -> Column:
    """MA4: one step of the adaptive delay, within its bounds."""
    share = _n(ok) / F.greatest(_n(ok) + _n(bad), F.lit(1))
    step = F.when(floods > 0, F.greatest(delay * 2.0, F.lit(300.0))).when(share >= 0.95, delay * 0.9).when(share >= 0.8, delay * 0.95).when(share >= 0.5, delay * 1.1).otherwise(delay * 1.5)
    return F.greatest(F.lit(float(low)), F.least(step, F.lit(float(high))))


def learned_boost(symbols: Column, phrases: Column, keywords: Column) -> Column:
    """LM9."""
    return F.least(F.lit(20), _n(symbols) * 4 + _n(phrases) * 5 + _n(keywords) * 2)


def learned_penalty(phrases: Column, keywords: Column) -> Column:
    """LM10: phrases stop at 45; keywords go on until 45 is reached, at one each time after the first; at most 50."""
    p = 15 * F.least(_n(phrases), F.lit(3))
    room = F.greatest(F.lit(1), F.ceil((45 - p) / 8).cast("int"))
    return F.when(_n(keywords) == 0, p).otherwise(F.least(F.lit(50), p + 8 * F.least(_n(keywords), room)))
