"""Relevance of a channel by its texts and its place in the graph, link parsing, categories and gates.

Lexica and rules are the caller's. Null texts count as empty, null counts as 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .commercial import ARABIC_TEXT, has_any
from .ladders import clamp, ladder
from .scores import _n, _points
from .text import ALEFS, MARKS, YAAS, normalize_arabic

#: fixed values: trade set-ups in a text
SIGNAL_SYNTAX = (
    r"(?iU)\b(sl\s*[:=-]?\s*\d+|tp\s*[:=-]?\s*\d+|tp[1-4]\s*[:=-]?\s*\d+|entry\s*[:=-]?\s*\d+|stop\s*loss|take\s*profit|"
    r"هدف\s*[1-4]?|وقف\s*خسارة|دخول\s*صفقة|شراء\s*من|بيع\s*من|"
    r"long|short|لونج|شورت|leverage|رافعة\s*\d*x?|cross|isolated|target\s*[1-4]?|dca)\b"
)
#: fixed values: named syntax patterns of the miner
SYNTAX_NAMES = {
    "buy_entry": r"(?iU)\b(BUY|شراء)\s+([A-Z]{3,6}|ذهب|gold|oil|نفط)\b",
    "sell_entry": r"(?iU)\b(SELL|بيع)\s+([A-Z]{3,6}|ذهب|gold|oil|نفط)\b",
    "take_profit": r"(?iU)\b(TP\s*\d?|هدف\s*\d?|Target\s*\d?)\s*[:=\-]?\s*(\d+(?:\.\d+)?)",
    "stop_loss": r"(?iU)\b(SL|Stop\s*Loss|وقف\s*خسار[ةه])\s*[:=\-]?\s*(\d+(?:\.\d+)?)",
    "pips_gain": r"(?iU)\b(\+?\d+)\s*(pip|pips|نقط[ةه])\b",
    "leverage": r"(?iU)\b(\d+x|\d+:\d+|رافعة\s*مالية)\b",
    "risk_reward": r"(?iU)\b(1\s*:\s*[2-9]|rr|r:r)\b",
}
#: fixed values: words of the core subject and of analysis, in the lower-case and in the normalised text
CORE_WORDS, CORE_NORMAL = ("gold", "xau", "forex"), ("ذهب", "فوركس")
ANALYSIS_WORDS, ANALYSIS_NORMAL = ("chart",), ("تحليل", "شارت")
#: fixed values: least score, class, tier and queue
RELEVANCE = [(65, "HIGH_CONFIDENCE_FOREX", "Tier_A", "queue:high"), (45, "LIKELY_FOREX", "Tier_B", "queue:high"), (25, "POSSIBLE_FOREX", "Tier_C", "queue:normal")]
#: fixed values: names that are no channel, and the pages' own hosts
NO_CHANNELS = (
    "joinchat", "share", "addstickers", "addlist", "gmail", "hotmail", "yahoo", "outlook", "icloud", "mail", "yandex", "protonmail", "proton",
    "telegram", "spambot", "sticker", "gif", "bot", "username", "ads", "advertise", "channel", "group", "chat", "support", "help", "admin", "contact",
    "info", "service", "feedback", "terms", "privacy",
)
HOSTS = r"(?:t\.me|telegram\.me)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def signal_syntax(c: Column) -> Column:
    """TX16: how many trade set-ups a text shows."""
    return F.regexp_count(_text(c), F.lit(SIGNAL_SYNTAX))


def shows_syntax(c: Column) -> Column:
    """TX16: whether a text shows any trade set-up."""
    return _text(c).rlike(SIGNAL_SYNTAX)


def syntax_names(c: Column) -> Column:
    """TX19: the named syntax patterns that a text shows, in their fixed order."""
    return F.array_compact(F.array(*[F.when(_text(c).rlike(p), F.lit(k)) for k, p in SYNTAX_NAMES.items()]))


def _folded_letters(lower: Column) -> Column:
    """The normalised text, to look for terms without white space; a text without letters that the normaliser changes is its own."""
    return F.when(lower.rlike(f"{MARKS[:-1]}{ALEFS}{YAAS}]"), normalize_arabic(lower)).otherwise(lower)


def first_term(c: Column, terms: list[str]) -> Column:
    """TX21: the first term, in the lexicon's order, that occurs in the lower-case or in the normalised text; null without one."""
    lower = F.lower(_text(c))
    norm = normalize_arabic(lower) if any(re.search(r"\s", t) for t in terms) else _folded_letters(lower)
    return F.coalesce(*[F.when(lower.contains(t) | norm.contains(t), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def candidate_relevance(hits: Column) -> Column:
    """TX22: 0 without a hit, else 20 and 10 a hit, 100 at most."""
    return F.when(_n(hits) > 0, F.least(F.lit(100), 20 + 10 * _n(hits))).otherwise(0)


def text_signs(text: Column) -> Column:
    """What SC16 asks of the text itself: struct (core, analysis, vip) of booleans."""
    lower = F.lower(_text(text))
    norm = _folded_letters(lower)
    core, analysis = _any(lower, CORE_WORDS) | _any(norm, CORE_NORMAL), _any(lower, ANALYSIS_WORDS) | _any(norm, ANALYSIS_NORMAL)
    return F.struct(core.alias("core"), analysis.alias("analysis"), lower.contains("vip").alias("vip"))


def relevance(text: Column, counts: dict[str, Column], strong: Column, recommended: Column, in_degree: Column, boost: Column, penalty: Column, learned: Column, disqualified: Column) -> Column:
    """SC16: struct (score, class, tier, queue, qualified) from all signals of a candidate; see ``judged``."""
    return judged(text_signs(text), counts, strong, recommended, in_degree, boost, penalty, learned, disqualified)


def judged(signs: Column, counts: dict[str, Column], strong: Column, recommended: Column, in_degree: Column, boost: Column, penalty: Column, learned: Column, disqualified: Column) -> Column:
    """SC16 from the ``text_signs``. The score stands in each rule, so over long texts give signs and counts as columns of an earlier select.

    ``counts`` has the hits of pairs, syntax, forex, gold, signals, methods, styles, commercial,
    props and brokers. ``strong`` says that a channel of the first tier refers to it, ``recommended``
    that the platform recommends it; either gives the same points.
    ``boost`` and ``penalty`` are the learned model's points, ``learned`` its hits. The candidate
    is rejected where ``disqualified`` is a term. A score of 65, 45 or 25 counts only with some
    trading evidence (for 25 a strong referral will do, a recommendation not) and a penalty below 30.
    """
    k = {name: _n(n) for name, n in counts.items()}
    yes = lambda x: F.coalesce(x, F.lit(False))
    score = (
        F.when(k["pairs"] >= 3, 35).when((k["pairs"] >= 1) | signs["core"], 25).otherwise(0)
        + ladder(k["signals"], [(2, 15), (1, 10)])
        + _points(
            (k["syntax"] > 0, 25), (k["methods"] >= 1, 15), (k["styles"] >= 1, 10), (signs["analysis"], 10),
            ((k["commercial"] >= 1) | signs["vip"], 15), ((k["props"] >= 1) | (k["brokers"] >= 1), 10), (yes(strong) | yes(recommended), 20), (_n(in_degree) >= 2, 10),
        )
        + F.bround(_n(boost)).cast("int")
    )
    score = clamp(F.greatest(F.lit(0), score - F.bround(_n(penalty)).cast("int")))
    evidence = (k["pairs"] > 0) | (k["syntax"] > 0) | (k["forex"] > 0) | (k["gold"] > 0) | (k["methods"] > 0) | ((k["signals"] > 0) & (k["commercial"] > 0)) | (_n(learned) > 0)
    out = lambda s, name, tier, queue, ok: F.struct(s.cast("int").alias("score"), F.lit(name).alias("class"), F.lit(tier).alias("tier"), F.lit(queue).alias("queue"), F.lit(ok).alias("qualified"))
    verdict = F.when(disqualified.isNotNull(), out(F.lit(0), "REJECTED", "Tier_D", "queue:normal", False))
    for least, name, tier, queue in RELEVANCE:
        shown = evidence | yes(strong) if least == 25 else evidence
        verdict = verdict.when((score >= least) & shown & (_n(penalty) < 30), out(score, name, tier, queue, True))
    return verdict.otherwise(out(score, "LOW_CONFIDENCE", "Tier_D", "queue:normal", False))


def parse_link(c: Column) -> Column:
    """STR10: struct (kind, name) of a link or handle: ``private`` invitations, ``public`` names; nulls for anything else.

    Names of the platform itself, of bots, and all-digit ones are none. A link's name has 5
    characters and more, a bare one 4; longer than 32, a link's is cut and a bare one none.
    """
    link = F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")
    invitation = F.split(F.element_at(F.split(link, r"/\+", 3), 2), "/")[0]
    joined = F.regexp_extract(link, rf"(?i){HOSTS}/joinchat/([a-zA-Z0-9_-]+)", 1)
    linked = F.regexp_extract(link, rf"(?i){HOSTS}/([a-zA-Z0-9_]{{5,32}})", 1)
    bare = F.when(~link.contains("t.me") & ~link.contains("/"), F.regexp_extract(link, "^@?([a-zA-Z0-9_]{4,32})$", 1)).otherwise("")
    good = lambda n: (n != "") & ~F.lower(n).isin(*NO_CHANNELS) & ~F.lower(n).endswith("bot") & ~n.rlike("^[0-9]+$")
    out = lambda kind, name: F.struct(F.lit(kind).cast("string").alias("kind"), name.alias("name"))
    return (
        F.when(link.contains("/+"), out("private", invitation)).when(joined != "", out("private", joined)).when(good(linked), out("public", linked))
        .when(good(bare), out("public", bare)).otherwise(out(None, F.lit(None).cast("string")))
    )


def normal_link(c: Column) -> Column:
    """STR11: a link or name as ``https://`` and the platform's short host."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?i)^https?://", ""), r"(?i)^telegram\.me/", "t.me/")
    return F.concat(F.when(bare.rlike(r"(?i)^t\.me/"), F.lit("https://")).otherwise(F.lit("https://t.me/")), bare)


def script_triple(text: Column, posts: Column) -> Column:
    """STR4: struct (chars, words, posts, mean): whole percents of Arabic letters, of words and of posts with one, and of their mean."""
    text, posts = _text(text), F.coalesce(posts, F.array().cast("array<string>"))
    words = F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", " "), " "), lambda w: w != "")
    share = lambda n, of: F.when(of > 0, n / of * 100).otherwise(F.lit(0.0))
    shares = [
        share(F.regexp_count(text, F.lit(ARABIC_TEXT)), F.regexp_count(text, F.lit("[a-zA-Z0-9" + ARABIC_TEXT[1:]))),
        share(F.size(F.filter(words, lambda w: w.rlike(ARABIC_TEXT))), F.size(words)),
        share(F.size(F.filter(posts, lambda p: _text(p).rlike(ARABIC_TEXT))), F.size(posts)),
    ]
    mean = (shares[0] + shares[1] + shares[2]) / 3.0
    return F.struct(*[s.cast("int").alias(n) for s, n in zip([*shares, mean], ("chars", "words", "posts", "mean"), strict=True)])


def category(text: Column, rules: list[tuple[str, list[str]]], otherwise: str = "unknown") -> Column:
    """SC20: the first rule of which a term occurs in the lower-case text."""
    return F.coalesce(*[F.when(has_any(text, terms), F.lit(name)) for name, terms in rules], F.lit(otherwise))


def whole_words(c: Column, word: str) -> Column:
    """SC21: occurrences of a word, its border being anything but Latin letters, digits, underscore and Arabic."""
    edge = "a-zA-Z0-9_" + ARABIC_TEXT[1:-1]
    return F.regexp_count(F.lower(_text(c)), F.lit(rf"(?<![{edge}])\Q{word}\E(?![{edge}])"))


def niche_gate(text: Column, is_group: Column, blocked: list[str], core: list[str], signals: list[str]) -> Column:
    """SC21: no blocked word, a core word, and three signal words, five in a group; repeats count."""
    hit = lambda words: F.greatest(*[whole_words(text, w) for w in words], F.lit(0)) > 0
    total = sum((whole_words(text, w) for w in signals), F.lit(0))
    return ~hit(blocked) & hit(core) & (total >= F.when(is_group, 5).otherwise(3))


def weighted_score(words: Column, members: Column, in_degree: Column, flags: dict[str, Column]) -> Column:
    """SC22: struct (score, tier): keyword hits, size, exposure and the points of each flag; a flag that is not given is false."""
    # fixed values: points of the flags
    points = {
        "active": 5, "recent": 5, "website": 15, "messenger": 15, "contact": 15, "vip": 15, "plans": 15, "account_management": 30, "private": 25,
        "copy_trading": 20, "funded": 20, "arabic": 15, "arabic_title": 5, "arabic_about": 5, "high_ratio": 10, "gulf_phone": 5,
    }
    size = F.when(_n(members) > 50000, 10).when(_n(members) > 20000, 7).when(_n(members) > 5000, 4).otherwise(0)
    total = F.least(F.lit(15), _n(words)) + size + F.least(F.lit(10), _n(in_degree) * 2) + _points(*[(flags[k], p) for k, p in points.items() if k in flags])
    score = clamp(total)
    return F.struct(score.cast("int").alias("score"), ladder(score, [(75, "Tier_A"), (50, "Tier_B"), (25, "Tier_C")], "Tier_D").alias("tier"))


def flags(text: Column, patterns: dict[str, str]) -> Column:
    """TX20: struct of booleans: whether each pattern occurs, without regard to case."""
    return F.struct(*[_text(text).rlike("(?iu)" + p).alias(k) for k, p in patterns.items()])


def suspicious(posts: Column, signal_words: list[str], risk_words: list[str], hype: Column, on_topic: Column) -> Column:
    """AG23: more than five posts with signals of which none speaks of risk, or hype; only on topic."""
    signals = F.filter(posts, lambda p: has_any(p, signal_words))
    careful = F.size(F.filter(signals, lambda p: has_any(p, risk_words)))
    yes = lambda x: F.coalesce(x, F.lit(False))
    return yes(on_topic) & (yes((F.size(signals) > 5) & (careful == 0)) | yes(hype))


def signal_category(kind: Column, value: Column) -> Column:
    """LM5: a mined signal's category, by its prefix if it is a symbol, else by the first rule that has a word of it."""
    # fixed values: prefixes and words
    crypto = ("btc", "eth", "sol", "xrp", "bnb", "ada", "doge", "avax", "dot")
    rules = {
        "gold": ("ذهب", "gold", "xau"),
        "crypto": ("كريبتو", "crypto", "بيتكوين", "bitcoin", "binance", "bybit", "usdt"),
        "signals": ("توصيات", "signals", "tp", "sl", "صفقات"),
        "commercial": ("vip", "اداره محافظ", "إدارة محافظ", "نسخ", "حساب ممول", "وسيط", "broker"),
        "forex": ("فوركس", "forex", "تداول", "عملات", "تحليل", "شارت"),
    }
    v = F.lower(_text(value))
    symbol = F.when(v.rlike("^(" + "|".join(crypto) + ")") | v.contains("usdt"), "crypto").when(_any(v, ("xau", "gold")), "gold").otherwise("forex")
    return F.when(kind == "symbol", symbol).otherwise(F.coalesce(*[F.when(_any(v, words), F.lit(k)) for k, words in rules.items()], F.lit("general_trading")))


def pressure(total: Column, high: int, critical: int) -> Column:
    """ST11: a queue group's level by its depth."""
    return F.when(_n(total) >= critical, "CRITICAL").when(_n(total) >= high, "HIGH").otherwise("NORMAL")


def worst_pressure(*levels: Column) -> Column:
    """ST11: struct (level, factor): the worst of the levels and the share of workers to run."""
    rank = F.greatest(*[F.when(x == "CRITICAL", 2).when(x == "HIGH", 1).otherwise(0) for x in levels], F.lit(0))
    out = lambda level, factor: F.struct(F.lit(level).alias("level"), F.lit(factor).alias("factor"))
    return F.when(rank == 2, out("CRITICAL", 0.2)).when(rank == 1, out("HIGH", 0.5)).otherwise(out("NORMAL", 1.0))
