"""Dashboard aggregates, leaderboards and filters. Every one takes its notion of now as ``as_of``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunction(predicates: list[Column]) -> Column:
    """FLT1: all optional clauses that are given."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def since(ts: str, as_of: str, interval: str) -> Column:
    """FLT8: within an interval before ``as_of``."""
    return F.col(ts) >= F.expr(f"timestamp_ntz'{as_of}' - interval {interval}")


def lead_window(as_of: str, status: str | None = None, tier: str | None = None, search: str | None = None, window: str = "24 hours") -> Column:
    """FLT2, FLT3, FLT6: the window view's condition over the leads' columns.

    Four clauses always hold: discovered within ``window``, no user account by reason or type, a
    plain name. ``status`` adds one more (none, ``verified`` and ``scanned``: something is known of
    the lead; an unknown one adds nothing), ``tier`` (but ``all``) and ``search`` theirs; the search is
    for a part of name, description or contact, without regard to case, ``%`` and ``_`` being
    wildcards. The two halves of ``with_contact`` are joined by an OR without brackets: what comes
    before belongs to the contact, what follows to the phone.
    """
    filled = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    other = lambda name, value: F.col(name).isNull() | (F.col(name) != value)
    score, new = F.col("lead_score"), F.col("status") == "new"
    base = [since("discovered_at", as_of, window), other("outreach_priority_reason", "user_account"), other("entity_type", "user"), F.col("channel_username").rlike(r"^[a-zA-Z0-9_]{4,32}\z")]
    mode = (status or "verified").lower()
    if mode in ("verified", "scanned"):
        base.append((F.col("member_count") > 0) | (score >= 10) | filled("description"))
    elif mode in ("new", "qualified"):
        base.append(new & ((score >= 10) | F.col("tier").isNotNull()))
    elif mode == "rejected":
        base.append(F.col("status") == "rejected")
    elif mode == "pending_scan":
        base.append(new & score.isNull() & F.col("tier").isNull())
    after = []
    if tier and tier.lower() != "all":
        after.append(F.col("tier") == tier)
    if search and search.strip():
        term = F.lit(f"%{search.strip()}%")
        after.append(F.ilike("channel_username", term) | F.ilike("description", term) | F.ilike("contact_username", term))
    if mode == "with_contact":
        return conjunction([*base, filled("contact_username")]) | conjunction([filled("whatsapp"), *after])
    return conjunction([*base, *after])


def kpis(df: DataFrame, counts: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """AG1: filtered counts and means in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in counts.items()], *[F.round(F.avg(c), 1).alias(k) for k, c in means.items()])


def rate(part: Column, whole: Column, places: int = 1) -> Column:
    """AG2: a percentage, half-even; 0 without a denominator."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, places)).otherwise(F.lit(0.0))


def time_buckets(df: DataFrame, ts: str, unit: str, counts: dict[str, Column]) -> DataFrame:
    """AG3, AG4, ST5: tumbling buckets with filtered counts."""
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def labelled_counts(df: DataFrame, key: str, label: str) -> DataFrame:
    """AG6: grouped by the raw column, labelled afterwards, so a literal label stays apart from null."""
    return df.groupBy(key).agg(F.count("*").alias("n")).select(F.coalesce(F.col(key), F.lit(label)).alias("label"), "n")


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """AG10: counts of fixed bins, from the top bound down."""
    c, top, out = F.col(value), None, []
    for b in bounds:
        out.append(F.count_if((c >= b) if top is None else (c >= b) & (c < top)).alias(f"from_{b}"))
        top = b
    return df.agg(*out)


def top_k(df: DataFrame, order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """TK*: a deterministic leaderboard; the caller's last key is unique."""
    return df.orderBy(*order).offset(offset).limit(k)


def top_per_group(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """WN1, WN3: the first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def not_in(df: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """JN5: SQL's ``key NOT IN (others)``: nothing where ``others`` holds a null, all of ``df`` where it is empty, no null key otherwise.

    One aggregation tells which, then a plain anti-join does the rest; neither side is broadcast for it.
    """
    total, nulls = others.agg(F.count("*"), F.count_if(F.col(other).isNull())).first()
    if not total:
        return df
    if nulls:
        return df.limit(0)
    keys = others.select(F.col(other).alias("_other")).distinct()
    return df.filter(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_other"), "left_anti")


def streaks(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """WN5: consecutive failures so far, back to 0 at each success."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_island", F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("failures", F.sum(F.when(failed, 1).otherwise(0)).over(inside)).drop("_island")


def stale(ts: str, score: Column, is_group: Column, as_of: str) -> Column:
    """FLT9: not seen for 3, 7 or 14 days by score above 80, above 50 or less; groups 1, 3 or 7."""
    days = F.when(is_group, F.when(score > 80, 1).when(score > 50, 3).otherwise(7)).otherwise(F.when(score > 80, 3).when(score > 50, 7).otherwise(14))
    return F.col(ts) < F.expr(f"timestamp_ntz'{as_of}'") - F.make_dt_interval(days)


def long_form(df: DataFrame, keys: list[str], metrics: list[str], name: Column) -> DataFrame:
    """SNK5: a row a metric: the keys, ``metric``, its value as double, and ``name`` made of these."""
    return df.withColumns({m: F.col(m).cast("double") for m in metrics}).unpivot(keys, metrics, "metric", "value").withColumn("name", name)
