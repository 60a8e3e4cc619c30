"""Stored leads judged again from their stored posts, and handles mined from leads and posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ladders import ladder
from tidemark.functions.text import clip
from tidemark.operators.views import top_per_group

# fixed values: tiers, and the bounds of the stricter gates
TIERS = [(75, "Tier_A"), (50, "Tier_B"), (25, "Tier_C")]
CHANNEL_SCORE, CHANNEL_INTENT, GROUP_INTENT, GROUP_SCRIPT, GROUP_DEFAULT = 50, 40, 35, 50, 50


def newest_texts(posts: DataFrame, channel: str, text: str, order: list[Column], most: int = 50) -> DataFrame:
    """(channel, posts): the texts of a channel's newest posts, newest first.

    The ``most`` newest count before null and empty texts go. The limit is taken by each task
    before the shuffle, so a hot channel sends no more than ``most`` rows from each.
    """
    newest = top_per_group(posts.filter(F.col(channel).isNotNull()).select(F.col(channel).alias("channel"), F.col(text).alias("text"), *[o.alias(f"o{i}") for i, o in enumerate(order)]), ["channel"], [F.desc(f"o{i}") for i in range(len(order))], most)
    # at most ``most`` rows a channel
    found = newest.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("posts"))
    return found.select("channel", F.filter(F.transform("posts", lambda x: x["text"]), lambda x: F.coalesce(x != "", F.lit(False))).alias("posts"))


def rescore(leads: DataFrame, texts: DataFrame, keywords: DataFrame, edges: DataFrame, metrics: DataFrame, qualifies: Callable[[Column, Column], Column], intent: Callable[[Column], Column], weigh: Callable[[Column, Column], Column]) -> DataFrame:
    """XT13: (id, status, score, tier, intent) of every scanned lead that is not rejected, judged by what is stored.

    ``leads`` has id, username, description, is_group, status, last_scan and script_score;
    ``texts`` comes from ``newest_texts`` by username; ``keywords`` has channel and frequency,
    ``edges`` target, ``metrics`` group_id and marketplace_score (one row a group), all by id. ``qualifies`` takes
    the lower-case text of name, description and posts and whether it is a group; ``intent`` the same text; ``weigh``
    the keywords' frequency and the in-degree, and it may name columns of ``leads``.

    A group passes that qualifies with an intent of 35 and a script score of 50: it gets its
    marketplace score, 50 without one. A channel passes that qualifies with an intent of 40 and a weighted score of
    50. Others are rejected with score 0 and the last tier. Nulls count as empty, 0 and false.
    """
    own = leads.filter((F.col("status") != "rejected") & F.col("last_scan").isNotNull())
    frequency = keywords.groupBy(F.col("channel").alias("_kid")).agg(F.sum("frequency").alias("_words"))
    degree = edges.groupBy(F.col("target").alias("_eid")).agg(F.count("*").alias("_degree"))
    market = metrics.select(F.col("group_id").alias("_gid"), F.col("marketplace_score").alias("_market"))
    j = own.join(texts.select(F.col("channel").alias("_name"), F.col("posts").alias("_posts")), F.col("username") == F.col("_name"), "left")
    for side, key in ((frequency, "_kid"), (degree, "_eid"), (market, "_gid")):
        j = j.join(side, F.col("id") == F.col(key), "left")
    group = F.coalesce("is_group", F.lit(False))
    none = F.array().cast("array<string>")
    body = F.concat(F.coalesce("username", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), F.array_join(F.coalesce("_posts", none), " \n "))
    j = j.withColumn("_text", F.lower(body))
    j = j.withColumns({"_fit": F.coalesce(qualifies(F.col("_text"), group), F.lit(False)), "_intent": F.coalesce(intent(F.col("_text")), F.lit(0)).cast("int"), "_weight": weigh(F.coalesce("_words", F.lit(0)), F.coalesce("_degree", F.lit(0)))})
    as_group = F.col("_fit") & (F.col("_intent") >= GROUP_INTENT) & (F.coalesce("script_score", F.lit(0)) >= GROUP_SCRIPT)
    as_channel = F.col("_fit") & (F.col("_intent") >= CHANNEL_INTENT) & (F.col("_weight") >= CHANNEL_SCORE)
    passes = F.when(group, as_group).otherwise(as_channel)
    score = F.when(passes, F.when(group, F.coalesce("_market", F.lit(GROUP_DEFAULT))).otherwise(F.col("_weight"))).otherwise(0).cast("int")
    return j.select("id", F.when(passes, F.col("status")).otherwise("rejected").alias("status"), score.alias("score"), F.when(passes, ladder(score, TIERS, "Tier_D")).otherwise("Tier_D").alias("tier"), F.col("_intent").alias("intent"))


def handle_mentions(rows: DataFrame, channel: str, text: str, order: list[str], introduced: list[str], mention: str, strict: str, reasons: dict[str, tuple[str, int]], stop: tuple[str, ...] = (), contact: str | None = None) -> DataFrame:
    """TX23: one row (handle, reason, confidence, channel, snippet, order) for each time a text or contact field names an advertiser.

    ``introduced`` are patterns whose first group is a handle: each match counts with
    ``reasons['introduced']``. ``mention`` finds all handles of a text; those that fit ``strict`` count with
    ``reasons['mention']``; a ``contact`` that fits counts with ``reasons['contact']``. Handles
    are in lower case and without ``@``; those of ``stop`` are none, and of bots only those that
    fit ``strict``. Patterns take no regard of case. A snippet is the text's first 160 characters with white space
    joined. Rows of null texts and contacts yield nothing. The rows feed ``mined_contacts``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    fits = lambda h: h.rlike(f"(?i){strict}")
    of = lambda kind, handles: F.transform(handles, lambda h: F.struct(F.regexp_replace(F.lower(h), "^@+", "").alias("handle"), F.lit(reasons[kind][0]).alias("reason"), F.lit(reasons[kind][1]).alias("confidence")))
    every = [of("introduced", F.regexp_extract_all(body, F.lit(f"(?i){p}"), F.lit(1))) for p in introduced]
    every.append(of("mention", F.filter(F.regexp_extract_all(body, F.lit(f"(?i){mention}"), F.lit(1)), fits)))
    if contact:
        name = F.regexp_replace(F.coalesce(F.col(contact), F.lit("")), "^@+", "")
        every.append(of("contact", F.filter(F.array(name), fits)))
    kept = F.filter(F.concat(*every), lambda x: ~x["handle"].isin("", *stop) & (~x["handle"].endswith("bot") | fits(x["handle"])))
    return rows.select(F.explode(kept).alias("_x"), F.col(channel).alias("channel"), clip(F.col(text), 160).alias("snippet"), *order).select("_x.*", "channel", "snippet", *order)
