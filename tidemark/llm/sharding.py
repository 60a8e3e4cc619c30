"""Shards that all match the mixture: proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled within their source by a seeded hash and ranked; (rank + u) / rows of the
source is a row's fractional rank, with a seeded u in [0, 1) a source, so that small sources do
not all fall in the middle. Sorted by it, every stretch holds each source in proportion, and the
sorted rows are cut into shards of equal counts.

Ranks come without a task for each source: rows are dealt by range of (source, hash, row) and
sorted, a row's place in its task is its rank there, and the counts of the tasks before it, one
row a task and source, give the rest. A source with a third of all rows is spread over as many
tasks as its rows fill, and so are repeated ids, as the row number is part of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import free_name, materialize

SHARDS, SEED = 16, 42
#: rows of a range, and rows of the counts by task and source that may be broadcast
RANGE_ROWS = 500_000
BROADCAST_RUNS = 200_000
_IN_TASK = (1 << 33) - 1


def hashed(*parts: Column, digits: int) -> Column:
    """The first hex digits of the sha256 of the parts, joined by colons, as a number; nulls count as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, digits), 16, 10).cast("long")


def placed(rows: DataFrame, groups: list[str], order: list[str], place: str, total: str, parts: int) -> DataFrame:
    """``rows`` with their place in ``order`` within their group (from 0) and the group's row count.

    ``order`` must tell all rows of a group apart. Null groups count as one. No group is gathered:
    rows are dealt by ranges of group and order, which split wherever the rows are many.
    """
    at, task, before, first = (free_name(rows, f"place_{x}") for x in ("at", "task", "before", "first"))
    dealt = rows.repartitionByRange(parts, *groups, *order).sortWithinPartitions(*groups, *order).withColumn(at, F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges").withColumns({task: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit(_IN_TASK))})
    runs = dealt.groupBy(*groups, task).agg(F.min(at).alias(first), F.count("*").alias(total))
    earlier = Window.partitionBy(*groups).orderBy(task)
    runs = runs.withColumns({before: F.sum(total).over(earlier) - F.col(total) - F.col(first), total: F.sum(total).over(Window.partitionBy(*groups))}).drop(first)
    runs = materialize(runs, "runs")
    side = runs.select(*[F.col(g).alias(f"{task}_{i}") for i, g in enumerate([*groups, task])], before, total)
    if runs.count() <= BROADCAST_RUNS:
        side = broadcast(side)
    same = F.lit(True)
    for i, g in enumerate([*groups, task]):
        same = same & F.col(g).eqNullSafe(F.col(f"{task}_{i}"))
    return dealt.join(side, same).select(*[f"`{c}`" for c in rows.columns], (F.col(at) + F.col(before)).alias(place), total)


def interleave(rows: DataFrame, by: str = "source", keys: tuple[str, ...] = ("doc_id",), shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0): counts of shards differ by one at most.

    Each shard holds of each source its share of rows, but for one or two; many sources of a row
    or two each are spread by chance, and move the borders of the others by as much. ``keys`` are hashed
    with the seed to shuffle a source's rows; rows with equal keys come in any order. All columns
    ride along, but for those named shard and slot: where texts are large, pass ids and join.
    Null sources are one source, null keys count as empty. With fewer rows than shards, some
    shards are empty; an empty table stays empty.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    row, mixed, rank, size, share, pos, n = (free_name(rows, x) for x in ("row", "mixed", "rank", "of_source", "share", "pos", "n_rows"))
    # the row number only tells equal rows apart; it must not change between the passes, so the table is written
    rows = materialize(rows.withColumns({mixed: hashed(F.lit(seed), *[F.col(f"`{k}`") for k in keys], digits=15), row: F.monotonically_increasing_id()}), "rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ranked = placed(rows, [by], [mixed, row], rank, size, parts)
    u = hashed(F.lit(seed), F.col(f"`{by}`"), digits=13) / F.lit(float(1 << 52))
    ranked = ranked.withColumn(share, (F.col(rank) + u) / F.col(size)).drop(mixed, rank, size)
    # a share twice in one source is beyond doubles only where the source has 2^50 rows
    done = placed(ranked, [], [share, by, row], pos, n, parts)
    shard = F.expr(f"({shards} * `{pos}` + {shards - 1}) div `{n}`")
    return done.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"`{pos}` - (shard * `{n}`) div {shards}")).drop(row, share, pos, n)


def write_shards(placed_rows: DataFrame, path: str, parts: int) -> None:
    """Write a folder for each shard, its rows in order of their slots; several files a shard where ``parts`` is larger.

    Files sort by name as their slots do. Empty tables write no shard.
    """
    placed_rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame) -> DataFrame:
    """One row a document: its size in UTF-8 bytes plus 1, crc32, shard and slot; the law is equal counts of rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    done = interleave(rows, "source", ("doc_id", "size", "text_crc32"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
