"""Scorecards as column expressions: ladders, clamps and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(c: Column, steps: list[tuple[float, float]], otherwise: float = 0, descending: bool = True) -> Column:
    """The first step reached: value >= bound (or <= bound when ascending)."""
    out = None
    for bound, value in steps:
        hit = (c >= bound) if descending else (c <= bound)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def whole(c: Column) -> Column:
    """Truncation towards zero."""
    return c.cast("int")


# fixed values: bounds and points of the scorecards
FRESHNESS_HOURS = [(24.5, 100), (72.5, 80), (168.5, 60), (336.5, 45), (720.5, 30)]
DISCOVERY = [(4, 100), (3, 80), (2, 60), (1, 35)]
IN_DEGREE = [(20, 40), (10, 30), (5, 20), (2, 12), (1, 6)]
TIERS = [(75, "A"), (55, "B"), (35, "C")]
RISK_LEVELS = [(75, "critical"), (50, "high"), (25, "medium")]
RESCAN_DAYS = [(80, 1), (60, 3), (40, 7)]
RELATIONS = [(4, 15), (2, 10), (1, 5)]
RECOMMENDED, FORWARDED = [(5, 20), (2, 15), (1, 10)], [(10, 15), (3, 10), (1, 5)]
SOURCES = [(3, 10), (2, 6), (1, 2)]
CONFIDENCE_POSTS, CONFIDENCE_HITS = [(10, 25), (3, 15)], [(3, 25), (1, 15)]
ACTIVITY_7D, ACTIVITY_30D = [(20, 30), (5, 15), (1, 10)], [(50, 20), (10, 10), (1, 5)]


def growth_score(first: Column, last: Column, days: Column) -> Column:
    """SC10: change in percent over a span, by ladders; a start below 1 counts as 1."""
    d = F.greatest(days, F.lit(0.01))
    p = (last - first) * 100.0 / F.greatest(F.lit(1.0), first)
    return (
        F.when((p >= 50) & (d <= 30), 95).when((p >= 25) & (d <= 14), 90).when(p >= 10, 75)
        .when(p >= 0, F.least(F.lit(70), 50 + whole(2 * p))).when(p >= -5, 45).otherwise(F.greatest(F.lit(10), 50 - whole(F.abs(p))))
    )


def freshness(hours: Column, day: Column, week: Column, month: Column) -> Column:
    """SC8: points by hours since the last post; where that is unknown, by the counts of posts."""
    counted = F.when(day > 0, 90).when(week > 0, 60).when(month > 0, 35).otherwise(10)
    return F.when(hours.isNotNull(), ladder(hours, FRESHNESS_HOURS, 15, descending=False)).otherwise(counted)


def activity_score(day: Column, week: Column, month: Column, posts: Column | None = None) -> Column:
    """SC7: three additive ladders, at least 5 and at most 100; 15 for posts seen that no ladder counts."""
    first = F.when(day >= 5, 50).when(day >= 1, 30).when(week >= 7, 20).otherwise(0)
    total = first + ladder(week, ACTIVITY_7D) + ladder(month, ACTIVITY_30D)
    return clamp(total if posts is None else F.when((posts > 0) & (total == 0), 15).otherwise(total), 5)


def smoothed_log_odds(df_pos: Column, n_pos: Column, df_neg: Column, n_neg: Column) -> Column:
    """MA2: log2 odds ratio with half a document added everywhere, 3 places; 0 without positives."""
    n_neg = F.greatest(F.lit(1), n_neg)
    odds = lambda d, n: F.log2((d + 0.5) / (n - d + 0.5))
    return F.when(n_pos <= 0, F.lit(0.0)).otherwise(F.bround(odds(df_pos, n_pos) - odds(df_neg, n_neg), 3))


def signal_confidence(support: Column, df_pos: Column, df_neg: Column, contrast: Column) -> Column:
    """LM7: support, purity and contrast, weighted .4, .4 and .2, half-even to 3 places; 0 without support."""
    purity = df_pos / F.greatest(df_pos + df_neg, F.lit(1))
    total = F.least(F.lit(1.0), support / 5) * 0.4 + purity * 0.4 + clamp(contrast / 4, 0.0, 1.0) * 0.2
    return F.when(support > 0, F.bround(total, 3)).otherwise(F.lit(0.0))


def lifecycle(support: Column, negatives: Column, contrast: Column, current: Column | None = None) -> Column:
    """LM6: a mined signal's state by support, contamination and contrast; a deprecated one that is clean again is a candidate."""
    was = F.lit("observed") if current is None else F.coalesce(current, F.lit("observed"))
    ratio = F.when(support + negatives > 0, negatives / (support + negatives)).otherwise(F.lit(0.0))
    clean = (support >= 3) & (ratio <= 0.05)
    return (
        F.when((negatives >= 2) & (ratio >= 0.15), "deprecated").when(clean & (contrast >= 2.0), "active").when(clean & (contrast >= 1.5), "validated")
        .when((support >= 2) & ((contrast >= 0.5) | (was == "deprecated")) & (ratio < 0.10), "candidate").otherwise("observed")
    )


def activity_class(day: Column, week: Column, month: Column, days_since: Column) -> Column:
    """SM1: crawl class by recent posts and days since the last one (null: unknown)."""
    return (
        F.when((days_since > 30) & (week == 0) & (day == 0), "DORMANT").when((day >= 5) | (week >= 35), "HOT")
        .when((day >= 1) | (week >= 7) | (month >= 20), "WARM").when((week >= 1) | (month >= 1) | (days_since <= 30), "COLD").otherwise("DORMANT")
    )
