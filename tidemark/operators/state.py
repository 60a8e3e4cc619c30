"""Ordered folds and state machines: the folds themselves, and their batch form.

In batch, events are dealt by key and sorted within their partition; a task then reads them in
order, batch by batch, and keeps one key's small state only. So no key's history is ever held as
one value, and a heavy key costs the time of one task and the sort's spill, not its memory.
``tidemark.streaming.folds`` runs the same folds over streams.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Fold(NamedTuple):
    """A fold over a key's events in order of time: ``result`` of the state after ``step(state, t, *fields)`` of each.

    ``t`` is in microseconds. A state is made of numbers, strings, nulls and lists of them, small
    whatever the history. The functions must be nested ones that use no module global: they
    travel by value.
    """

    start: Callable
    step: Callable
    result: Callable
    columns: dict[str, str]


def _folded(df: DataFrame, key: str, fields: list[str], fold: Fold) -> DataFrame:
    """(key, *columns) of each key, over its rows in order of the fields."""
    start, step, result, columns = fold
    types = list(columns.values())

    def run(batches):
        import pyarrow as pa

        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        open_, current, state, kind = False, None, None, None

        def batch_of(done):
            values = [pa.array([d[0] for d in done], kind)] + [pa.array([d[1][i] for d in done], arrow[t]) for i, t in enumerate(types)]
            return pa.record_batch(values, names=[key, *columns])

        for batch in batches:
            kind, done = batch.column(0).type, []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or k != current:
                    if open_:
                        done.append((current, result(state)))
                    open_, current, state = True, k, start()
                state = step(state, *row)
            if done:
                yield batch_of(done)
        if open_:
            yield batch_of([(current, result(state))])

    rows = df.select(key, *fields)
    schema = ", ".join([f"`{key}` {rows.schema[0].dataType.simpleString()}", *(f"{n} {t}" for n, t in columns.items())])
    return rows.repartition(key).sortWithinPartitions(key, *fields).mapInArrow(run, schema)


def timed(df: DataFrame, key: str, ts: str, *others: str) -> DataFrame:
    """(key, t, *others) with the time in microseconds."""
    return df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), *others)


def rate_limit(window_s: int, most: int) -> Fold:
    """ST6: an event is admitted if fewer than ``most`` admitted ones lie in the window before it."""

    def step(s, t, *_):
        log, yes, no = s
        log = [x for x in log if x is not None and t is not None and x > t - window_s * 1_000_000]
        return ([*log, t], yes + 1, no) if len(log) < most else (log, yes, no + 1)

    return Fold(lambda: ([], 0, 0), step, lambda s: s[1:], {"admitted": "bigint", "rejected": "bigint"})


def breaker(window_s: int, most: int, open_s: int) -> Fold:
    """ST7: a window opens at its first hit and lasts ``window_s``; each hit from the ``most``-th on
    opens the circuit for ``open_s`` from then. ``trips`` counts openings of a closed circuit.
    """

    def step(s, t, *_):
        since, n, trips, until = s
        if t is None:
            return s
        since, n = (t, 1) if since is None or t >= since + window_s * 1_000_000 else (since, n + 1)
        if n < most:
            return since, n, trips, until
        return since, n, trips + (until is None or t >= until), t + open_s * 1_000_000

    return Fold(lambda: (None, 0, 0, None), step, lambda s: s[2:], {"trips": "int", "until": "bigint"})


def health() -> Fold:
    """SM6: points and state over an account's events (success, flood, error, auth), with a flood's seconds.

    A flood of more than a minute costs more and degrades a healthy account, as the third one
    within half an hour does.
    """

    # fixed values: points and transitions of each kind of event
    def step(s, t, _, event, seconds):
        h, st, floods = s
        seconds = seconds or 0
        if event == "flood":
            floods = [x for x in floods if t is not None and x > t - 1_800_000_000] + ([] if t is None else [t])
            floods = floods[-3:]
        h = {"success": min(100, h + 1), "flood": max(0, h - (5 if seconds <= 60 else 15)), "error": max(0, h - 10), "auth": 0}.get(event, h)
        if st == "QUARANTINED" or event == "auth":
            return h, "QUARANTINED", floods
        if event == "flood" and st == "HEALTHY":
            return h, "DEGRADED" if seconds > 60 or len(floods) >= 3 else st, floods
        if event == "flood" and st == "COOLDOWN":
            return h, "RESTRICTED", floods
        if event in ("flood", "error") and st == "DEGRADED":
            return h, "COOLDOWN", floods
        return h, "HEALTHY" if event == "success" and st == "DEGRADED" and h >= 90 else st, floods

    return Fold(lambda: (100, "HEALTHY", []), step, lambda s: s[:2], {"health": "int", "state": "string"})


def connector(least: int = 3, cool_down_s: int = 300) -> Fold:
    """SM9: a success heals; a rate limit cools down for ``cool_down_s``; ``least`` failures in a row degrade."""

    def step(s, t, _, event):
        st, n, cool = s
        if event == "success":
            return "HEALTHY", 0, cool
        if event == "rate_limit":
            return "RATE_LIMITED", n + 1, None if t is None else t + cool_down_s * 1_000_000
        return "DEGRADED" if n + 1 >= least else st, n + 1, cool

    return Fold(lambda: ("HEALTHY", 0, None), step, lambda s: s, {"status": "string", "failures": "int", "cool": "bigint"})


def moment(column: str, name: str) -> Column:
    """Microseconds as a time without a zone."""
    return F.timestamp_micros(column).cast("timestamp_ntz").alias(name)


def rate_limiter(df: DataFrame, key: str, ts: str, order: str, window_s: int, most: int) -> DataFrame:
    """ST6: (key, admitted, rejected) of a sliding-window log."""
    return _folded(timed(df, key, ts, order), key, ["t", order], rate_limit(window_s, most))


def fixed_window_trips(df: DataFrame, key: str, ts: str, order: str, window_s: int, most: int, open_s: int) -> DataFrame:
    """ST7: (key, trips, open_until) of fixed windows with a threshold. Events without a time are left out."""
    return _folded(timed(df, key, ts, order), key, ["t", order], breaker(window_s, most, open_s)).select(key, "trips", moment("until", "open_until"))


def health_machine(df: DataFrame, key: str, ts: str, order: str, kind: str, wait: str) -> DataFrame:
    """SM6: (key, health, state). ``wait`` is the column with a flood's seconds (null: 0)."""
    return _folded(timed(df, key, ts, order, kind, wait), key, ["t", order, kind, wait], health())


def count_windows(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """ST3: tumbling windows of ``size`` events of a key, as a bucket number."""
    from pyspark.sql import Window

    return df.withColumn("bucket", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))


def connector_health(df: DataFrame, key: str, ts: str, order: str, kind: str, least: int = 3, cool_down_s: int = 300) -> DataFrame:
    """SM9: (key, status, failures, cool_until) after a connector's events (success, rate_limit, else a failure)."""
    return _folded(timed(df, key, ts, order, kind), key, ["t", order, kind], connector(least, cool_down_s)).select(key, "status", "failures", moment("cool", "cool_until"))


def safety_gate(stopped: Column, enabled: Column, session_ok: Column, status: Column, dry_run: Column, target: Column, aliases: tuple[str, ...] = ()) -> Column:
    """SM11: the first of six layers that blocks a row, as a reason; ``ALLOWED`` where none does.

    A null never lets a row through: every layer must be known to hold.
    """
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(target, F.lit("")))), "^@+", "")
    layers = (
        (~F.coalesce(stopped, F.lit(True)), "BLOCKED_BY_KILL_SWITCH"), (enabled, "OUTREACH_DISABLED"), (session_ok, "SECURITY_VIOLATION"),
        (F.lower(status) == "approved", "APPROVAL_REQUIRED"), (~F.coalesce(dry_run, F.lit(True)), "DRY_RUN"),
        ((name != "") & ~name.endswith("bot") & ~name.isin(*aliases, ""), "INVALID_TARGET"),
    )
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), reason) for ok, reason in layers], F.lit("ALLOWED"))
