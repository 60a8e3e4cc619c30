"""LM14: the learning cycle: mine, judge, merge, reject and reload, round after round, over a versioned model table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ladders import lifecycle, signal_confidence
from tidemark.operators import mining
from tidemark.sources.versions import VersionedTable

MODEL = "value string, kind string, category string, status string, confidence double, contrast double, support long, negatives long, rounds int"


def mined(corpus: DataFrame, tokens: Column, category: str = "learned") -> DataFrame:
    """The model rows of one corpus: each keyword's support, state and confidence."""
    found = mining.contrast(corpus, tokens, 1)
    pos, neg = F.col("df_pos"), F.col("df_neg")
    return found.select(
        F.col("feature").alias("value"), F.lit("keyword").alias("kind"), F.lit(category).alias("category"), lifecycle(pos, neg, F.col("contrast")).alias("status"),
        signal_confidence(pos, pos, neg, F.col("contrast")).alias("confidence"), "contrast", pos.alias("support"), neg.alias("negatives"), F.lit(1).alias("rounds"),
    )


def upserted(base: DataFrame, delta: DataFrame) -> DataFrame:
    """A signal mined again takes the new category, state, contrast and counts; its rounds add up."""
    b, d = base.alias("b"), delta.alias("d")
    new = F.col("d.value").isNotNull()
    pick = lambda x: F.when(new, F.col(f"d.{x}")).otherwise(F.col(f"b.{x}")).alias(x)
    return b.join(d, F.col("b.value") == F.col("d.value"), "full_outer").select(
        F.coalesce("b.value", "d.value").alias("value"), F.coalesce("b.kind", "d.kind").alias("kind"), pick("category"), pick("status"), pick("confidence"), pick("contrast"), pick("support"), pick("negatives"),
        (F.coalesce("b.rounds", F.lit(0)) + F.coalesce("d.rounds", F.lit(0))).alias("rounds"),
    )


def penalised(base: DataFrame, delta: DataFrame) -> DataFrame:
    """LM11 over the model table: ``delta`` (channel, value) are the features of rejected channels."""
    known = base.select("value", "category", "status", "confidence", "contrast", "negatives")
    rows = mining.rejected(known, delta, "keyword", "channel").alias("r").join(base.select("value", "kind", "support", "rounds").alias("b"), "value", "left")
    return rows.select("value", F.coalesce("kind", F.lit("keyword")).alias("kind"), "category", "status", "confidence", "contrast", F.coalesce("support", F.lit(0)).alias("support"), "negatives", F.coalesce("rounds", F.lit(0)).alias("rounds"))


def features(rejected: DataFrame, channel: str, tokens: Column, most: int = 15) -> DataFrame:
    """(channel, value): a rejected channel's first keywords in their order."""
    words = F.slice(F.array_sort(mining.ngrams(tokens, 1)), 1, most)
    return rejected.select(F.col(channel).alias("channel"), F.explode(words).alias("value"))


def cycle(model: VersionedTable, number: int, corpus: DataFrame, rejected: DataFrame, tokens: Column, channel: str) -> DataFrame:
    """Run round ``number`` (from 1) and read the model in use, by part.

    ``corpus`` has a boolean ``positive``; ``rejected`` has the channel and the text that
    ``tokens`` reads. A round publishes two versions, 2 * number - 1 (mined) and 2 * number
    (penalised); a round that was broken off goes on after the last one that it published, and
    one that is complete is not run again. Without a positive document a round mines nothing,
    but still publishes.
    """
    done = model.folders()[0]
    if done < 2 * number - 1:
        _publish(model, mined(corpus, tokens), upserted)
    if done < 2 * number:
        _publish(model, features(rejected, channel, tokens), penalised)
    return in_use(model, 2 * number)


def _publish(model: VersionedTable, delta: DataFrame, combine) -> None:
    before = model.folders()[0]
    if model.merge(delta, combine) == before:
        model.publish(before + 1, model.folders()[1])


def in_use(model: VersionedTable, version: int | None = None) -> DataFrame:
    """LM8 over a version of the model."""
    return mining.model_part(model.read(version), "category", "status", "contrast", "kind")
