"""Work along an order without a task for each key: running values and pointers over ranges of (key, order).

Rows are dealt by ranges of key and order and sorted, so a key with a third of all rows is spread
over as many tasks as its rows fill. What a row needs from the tasks before or after its own
comes from one small row for each task and key. Rows without a key take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.io import settle

#: columns that dealing adds: the place in the order, and the task's number
AT, TASK = "at_", "task_"
_SHIFT = 33


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rows = df.dropna(subset=keys)
    return rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(AT, F.monotonically_increasing_id())


def deal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of keys and order, with AT and TASK; written, so that a row keeps them."""
    return settle(_sorted(df, keys, order), "dealt").withColumn(TASK, F.shiftright(AT, _SHIFT))


def running_sums(dealt: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """``dealt`` with the sums of columns up to and with each row, within its keys; ``sums`` maps new names to columns."""
    own = Window.partitionBy(*keys, TASK).orderBy(AT)
    before = Window.partitionBy(*keys).orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy(*keys, TASK).agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    runs = runs.select(*keys, TASK, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    rows = dealt.withColumns({n: F.coalesce(F.sum(x).over(own), F.lit(0)) for n, x in sums.items()}).join(runs, [*keys, TASK])
    return rows.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop(*[f"{n}_before" for n in sums])


def clamped_products(df: DataFrame, key: str, order: list[str], factor: str, low: str, high: str, start: float, into: str) -> DataFrame:
    """``df`` with the running value of x -> min(high, max(low, factor * x)) over each key's rows, from ``start``.

    Such steps compose to one of the same kind (for factors of 0 and more and low <= high), so
    each task composes its own rows, and a key's tasks are chained by one row each. ``order``
    must tell a key's rows apart. Results may differ from a row by row fold in the last digits.
    """
    rows = _sorted(df, [key], order)
    columns = rows.columns

    def local(batches):
        import pyarrow as pa

        current, a, lo, hi = None, 1.0, 0.0, 0.0
        for batch in batches:
            out = []
            for k, f, below, above in zip(*(batch.column(c).to_pylist() for c in (key, factor, low, high)), strict=True):
                if k != current:
                    current, a, lo, hi = k, f, below, above
                else:
                    a, lo, hi = a * f, min(above, max(below, f * lo)), min(above, max(below, f * hi))
                out.append((a, lo, hi))
            yield pa.record_batch([*batch.columns, *(pa.array([o[i] for o in out], pa.float64()) for i in range(3))], names=[*batch.schema.names, "a_", "lo_", "hi_"])

    def chained(batches):
        import pyarrow as pa

        current, x = None, start
        for batch in batches:
            entering = []
            for k, a, lo, hi in zip(*(batch.column(c).to_pylist() for c in (key, "a_", "lo_", "hi_")), strict=True):
                current, x = k, (x if k == current else start)
                entering.append(x)
                x = min(hi, max(lo, a * x))
            yield pa.record_batch([batch.column(key), batch.column(TASK), pa.array(entering, pa.float64())], names=[key, TASK, "x_"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    done = rows.mapInArrow(local, ", ".join([*(f"`{n}` {t}" for n, t in kinds.items()), "a_ double", "lo_ double", "hi_ double"]))
    done = settle(done, "composed").withColumn(TASK, F.shiftright(AT, _SHIFT))
    runs = done.groupBy(key, TASK).agg(F.max_by(F.struct("a_", "lo_", "hi_"), AT).alias("r")).select(key, TASK, "r.*")
    runs = runs.repartition(key).sortWithinPartitions(key, TASK).mapInArrow(chained, f"`{key}` {kinds[key]}, {TASK} long, x_ double")
    value = F.least("hi_", F.greatest("lo_", F.col("a_") * F.col("x_")))
    return done.join(runs, [key, TASK]).select(*[c for c in columns if c != AT], value.alias(into))


def throttle_delays(df: DataFrame, key: str, order: list[str], ok: Column, bad: Column, floods: Column, low: float = 60.0, high: float = 600.0, start: float = 120.0) -> DataFrame:
    """MA4: ``df`` with ``delay``: the adaptive delay after each row's telemetry (counts of successes, failures and floods).

    The delay grows and shrinks by factors within its bounds; a flood lifts it to 300 at least.
    """
    share = F.coalesce(ok, F.lit(0)) / F.greatest(F.coalesce(ok, F.lit(0)) + F.coalesce(bad, F.lit(0)), F.lit(1))
    flood = F.coalesce(floods, F.lit(0)) > 0
    # fixed values: factors by the share of successes, and what a flood does
    factor = F.when(flood, 2.0).when(share >= 0.95, 0.9).when(share >= 0.8, 0.95).when(share >= 0.5, 1.1).otherwise(1.5)
    least = F.when(flood, min(high, max(low, 300.0))).otherwise(low)
    steps = df.withColumns({"factor_": factor, "low_": least, "high_": F.lit(float(high))})
    return clamped_products(steps, key, order, "factor_", "low_", "high_", start, "delay").drop("factor_", "low_", "high_")


def next_event(events: DataFrame, key: str, t: str, gap: int) -> DataFrame:
    """(key, t, next): the first time of the key that lies ``gap`` or more after t; null where none does. Times are distinct within a key."""
    both = events.select(key, F.col(t).alias("s_"), F.lit(1).alias("event_"), F.lit(None).cast("long").alias("from_"))
    both = both.unionAll(events.select(key, (F.col(t) + gap).alias("s_"), F.lit(0).alias("event_"), F.col(t).alias("from_")))
    rows = deal(both, [key], ["s_", "event_"])
    seen = F.when(F.col("event_") == 1, F.col("s_"))
    # read backwards, the next event is the last one seen
    own = F.last(seen, ignorenulls=True).over(Window.partitionBy(key, TASK).orderBy(F.desc(AT)).rowsBetween(Window.unboundedPreceding, 0))
    later = F.last("first_", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc(TASK)).rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy(key, TASK).agg(F.min(seen).alias("first_")).withColumn("later_", later).select(key, TASK, "later_")
    found = rows.withColumn("own_", own).filter("event_ = 0").join(runs, [key, TASK])
    return found.select(key, F.col("from_").alias(t), F.coalesce("own_", "later_").alias("next"))


def ttl_dedup(df: DataFrame, key: str, ts: str, order: str, ttl_s: int) -> DataFrame:
    """SET5: the rows at which a key passes: its first, and then the first that comes ``ttl_s`` or more after the last that passed.

    Of rows of a key at one time, the one with the least ``order`` (which tells rows of a key
    and time apart) may pass. Rows without a key or time take no part. From every time a pointer
    leads to the next that could pass; the chain from the first is marked by doubling the
    pointers, so a chain of n rows takes log2 n joins, and no task walks a key's history.
    """
    timed = df.withColumn("t_", F.unix_micros(F.col(ts).cast("timestamp"))).dropna(subset=[key, "t_"])
    times = settle(timed.select(key, "t_").distinct(), "times")
    jumps = settle(next_event(times, key, "t_", ttl_s * 1_000_000), "jumps")
    passed = settle(times.groupBy(key).agg(F.min("t_").alias("t_")), "passed")
    count = passed.count()
    while True:
        # those that passed so far lead to as many more
        reached = passed.join(jumps, [key, "t_"]).select(key, F.col("next").alias("t_")).dropna()
        passed = settle(passed.unionAll(reached).distinct(), "passed")
        before, count = count, passed.count()
        if count == before:
            break
        onward = jumps.select(F.col(key).alias("k_"), F.col("t_").alias("mid_"), F.col("next").alias("far_"))
        # a pointer that has ended leads nowhere further
        jumps = settle(jumps.dropna().join(onward, (F.col(key) == F.col("k_")) & (F.col("next") == F.col("mid_"))).select(key, "t_", F.col("far_").alias("next")).dropna(), "jumps")
    first = timed.join(passed, [key, "t_"], "left_semi").withColumn("n_", F.row_number().over(Window.partitionBy(key, "t_").orderBy(order)))
    return first.filter("n_ = 1").select(*df.columns)
