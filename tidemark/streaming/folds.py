"""Folds over streams: keyed state with event-time timers and expiry, for the folds of ``tidemark.operators.state``.

Events may come in any order within the watermark's delay. A key's events wait in a list until
the watermark has passed them; a timer then folds them, in order, into its small state. What is
emitted at each batch is the fold over all that has come, those that wait included, so the last
row of a key is the row of the batch fold over the same events, wherever the batches were cut
and however often the stream was started again. A key without events for its time to live loses
its state and starts anew, by the gap between its events, whenever its timer came.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.operators.state import Fold, moment
from tidemark.streaming import streams

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Job(NamedTuple):
    """A fold, the event columns after the time that it takes (the first settles ties), and the columns that it shows."""

    fold: Fold
    fields: tuple[str, ...]
    shown: tuple[Column | str, ...]


def rate_limiter(order: str, window_s: int, most: int) -> Job:
    """ST6 over a stream."""
    return Job(state.rate_limit(window_s, most), (order,), ("admitted", "rejected"))


def fixed_window_trips(order: str, window_s: int, most: int, open_s: int) -> Job:
    """ST7 over a stream."""
    return Job(state.breaker(window_s, most, open_s), (order,), ("trips", moment("until", "open_until")))


def health_machine(order: str, kind: str, wait: str) -> Job:
    """SM6 over a stream."""
    return Job(state.health(), (order, kind, wait), ("health", "state"))


def connector_health(order: str, kind: str, least: int = 3, cool_down_s: int = 300) -> Job:
    """SM9 over a stream."""
    return Job(state.connector(least, cool_down_s), (order, kind), ("status", "failures", moment("cool", "cool_until")))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB, which timers and lists need; ``spark`` stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def _processor(fold: Fold, key: str, ttl_s: int | None):
    """Made here, the class travels by value, so that the executors need no copy of this module."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    start, step, result, columns = fold

    class Folded(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            # one value a key: every call for state is a round trip to the JVM, and a list costs one an event
            self.folded = handle.getValueState("folded", "state string, last long, waiting string")

        def _fold(self, known, name, new, watermark_ms):
            import json

            at, last = (json.loads(known[0]), known[1]) if known else (start(), None)
            events = (json.loads(known[2]) if known and known[2] else []) + new
            try:
                events.sort()
            except TypeError:  # in the order of the batch fold: nulls come first
                events.sort(key=lambda e: [(x is not None, x) for x in e])
            settled = sum(e[0] <= watermark_ms * 1000 for e in events)
            later = events[settled:]

            def forward(at, last, events):
                for e in events:
                    if ttl_s is not None and last is not None and e[0] - last >= ttl_s * 1_000_000:
                        at = start()  # whether or not a timer came first
                    at, last = step(at, *e), e[0]
                return at, last

            at, last = forward(at, last, events[:settled])
            if ttl_s is not None and last is not None and not later and last + ttl_s * 1_000_000 <= watermark_ms * 1000:
                self.folded.clear()
                return Row(**{key: name}, **dict(zip(columns, result(at), strict=True)), expired=True)
            if settled or new or known is None:
                self.folded.update((json.dumps(at), last, json.dumps(later) if later else None))
            if later:
                self.handle.registerTimer(-(-later[-1][0] // 1000))
            elif ttl_s is not None and last is not None:
                self.handle.registerTimer(-(-last // 1000) + ttl_s * 1000)
            at, _ = forward(at, last, later)
            return Row(**{key: name}, **dict(zip(columns, result(at), strict=True)), expired=False)

        def handleInputRows(self, key, rows, timerValues):
            new = [list(r[1:-1]) for r in rows]
            yield self._fold(self.folded.get(), key[0], new, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            known = self.folded.get()
            if known:
                yield self._fold(known, key[0], [], timerValues.getCurrentWatermarkInMs())

        def close(self) -> None:
            pass

    return Folded()


def fold_stream(events: DataFrame, job: Job, key: str, ts: str, late: str = "0 seconds", ttl_s: int | None = None) -> DataFrame:
    """(key, shown columns, expired): a row for each key that a batch or a timer touched; its last row holds.

    ``events`` is a stream of a session of ``stateful_session``. Events later than ``late`` and
    those without a time are left out. With ``ttl_s``, a key whose last event lies as far behind
    the watermark ends with a row marked as expired. Null keys are one key. A batch's events of
    one key are sorted in memory: bound the batches by the source's options.
    """
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), *job.fields, F.col(ts).cast("timestamp").alias("at"))
    rows = rows.filter("at is not null").withWatermark("at", late)
    columns = ", ".join([f"`{key}` {rows.schema[0].dataType.simpleString()}", *(f"{n} {t}" for n, t in job.fold.columns.items()), "expired boolean"])
    done = rows.groupBy(key).transformWithState(_processor(job.fold, key, ttl_s), columns, "update", "eventtime")
    return done.select(key, *job.shown, "expired")


def last_rows(updates: DataFrame, key: str) -> DataFrame:
    """The last row of each key in a table that ``streams.to_parquet`` made in ``update`` mode."""
    shown = [x for x in updates.columns if x not in (key, "batch")]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*shown), F.struct("batch", "expired")).alias("last"))
    return last.select(key, *[f"last.{x}" for x in shown])


def run_folds(spark: SparkSession, events: Callable[[SparkSession], DataFrame], job: Job, key: str, ts: str, folder: str, late: str = "0 seconds", ttl_s: int | None = None) -> DataFrame:
    """Drain a stream into a Parquet table under ``folder`` and read each key's last row; may be called again as input comes in.

    ``events`` makes the stream from a session. The state and the marks of what was read lie
    under ``folder`` too, so a later call goes on where the last one, even a failed one, ended.
    """
    done = fold_stream(events(stateful_session(spark)), job, key, ts, late, ttl_s)
    table = streams.to_parquet(done, f"{folder}/rows", f"{folder}/checkpoint", "update")
    return last_rows(spark.read.schema(table.schema).parquet(f"{folder}/rows"), key)
