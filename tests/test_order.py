"""Streams, running values and pointers, one-pass lexicons and pruned n-grams against plain Python."""

import json
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import lexicon, mining, ordered, state
from tidemark.streaming import folds

BASE = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long, kind string, wait int"


@pytest.fixture
def spread(spark):
    """Small ranges stay apart, so that values must cross tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def events(n, seed, users=7, step=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all events are of one user, and some share a time
        rows.append((1 if rng.random() < 0.33 else rng.randrange(users), BASE + timedelta(seconds=10 * (i * step // 10 // 10)), n - i, rng.choice(["success", "success", "flood", "error", "rate_limit", "auth" if rng.random() < 0.05 else "success"]), rng.choice([None, 5, 90])))
    return rows


JOBS = {
    "rate": (lambda: folds.rate_limiter("event_id", 1000, 3), lambda df: state.rate_limiter(df, "user_id", "ts", "event_id", 1000, 3)),
    "breaker": (lambda: folds.fixed_window_trips("event_id", 2000, 4, 900), lambda df: state.fixed_window_trips(df, "user_id", "ts", "event_id", 2000, 4, 900)),
    "health": (lambda: folds.health_machine("event_id", "kind", "wait"), lambda df: state.health_machine(df, "user_id", "ts", "event_id", "kind", "wait")),
    "connector": (lambda: folds.connector_health("event_id", "kind"), lambda df: state.connector_health(df, "user_id", "ts", "event_id", "kind")),
}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", JOBS)
def test_stream_equals_batch(spark, tmp_path, name):
    """Out of order within the delay, in four files, with a restart after two: the rows of the batch fold over what came."""
    job, batch = JOBS[name][0](), JOBS[name][1]
    rows = events(400, 3)
    rng = random.Random(9)
    order = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.randrange(3000)), r[2]))
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    source = lambda own: own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    for until in (2, 4):
        for k in range(until - 2, until):
            part = order[100 * k : 100 * (k + 1)]
            seen += part
            df(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = folds.run_folds(spark, source, job, "user_id", "ts", str(tmp_path / "state"), late="2 hours")
        assert rows_of(got.drop("expired")) == rows_of(batch(df(seen)))
    # nothing new: the same rows again
    again = folds.run_folds(spark, source, job, "user_id", "ts", str(tmp_path / "state"), late="2 hours")
    assert rows_of(again.drop("expired")) == rows_of(batch(df(seen)))


def test_stream_state_is_one_value(spark):
    """a visit reads and writes a key's state once, however many of its events wait."""
    calls, held = [], []

    class Value:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

        def exists(self):
            calls.append("exists")
            return bool(held)

    class Items(Value):
        def put(self, values):
            calls.extend(["put"] * len(values))

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def getListState(self, name, schema):
            return Items()

        def registerTimer(self, at):
            calls.append("timer")

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    done = folds._processor(state.connector(), "user_id", None)
    done.init(Handle())
    rows = [(7, 1000 * i, i, "failure", None) for i in range(500)]
    (first,) = done.handleInputRows((7,), iter(rows), Times(0))
    assert calls == ["get", "update", "timer"] and (first.status, first.failures) == ("DEGRADED", 500)
    (last,) = done.handleExpiredTimer((7,), Times(1000), None)
    assert calls == ["get", "update", "timer", "get", "update"] and last == first


def test_stream_expiry(spark, tmp_path):
    """An idle key's state ends with a row of its own; after it the key starts anew, whenever the timer came."""
    at = lambda s: BASE + timedelta(seconds=s)
    files = [[(1, at(0), 1, "error", None), (1, at(10), 2, "error", None), (2, at(20), 3, "error", None)], [(2, at(500), 4, "error", None)], [(2, at(900), 5, "error", None), (1, at(2000), 6, "error", None), (2, None, 7, "auth", None)]]
    source = lambda own: own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = folds.health_machine("event_id", "kind", "wait")
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = {r.user_id: (r.health, r.expired) for r in folds.run_folds(spark, source, job, "user_id", "ts", str(tmp_path / "state"), ttl_s=450).collect()}
        # user 1 idles from 10 on; user 2's gaps are 480 (anew) and 400; at 2000 it is idle again
        assert got == ({1: (80, False), 2: (90, False)}, {1: (80, True), 2: (90, False)}, {1: (90, False), 2: (80, True)})[k], k


def brute_ttl(rows, ttl):
    last, out = {}, []
    for key, t, i in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        if key not in last or (t - last[key]).total_seconds() >= ttl:
            last[key] = t
            out.append((key, t, i))
    return out


@pytest.mark.parametrize("ttl", [1, 600, 86400])
def test_ttl_dedup(spark, spread, ttl):
    rng = random.Random(ttl)
    rows = [(rng.choice(["hot", "hot", "a", "b", "c"]), BASE + timedelta(seconds=rng.randrange(0, 40_000, 100)), i) for i in range(600)]
    rows += [("lone", BASE, 1000), (None, BASE, 1001), ("a", None, 1002), ("edge", BASE, 1003), ("edge", BASE + timedelta(seconds=ttl), 1004), ("edge", BASE + timedelta(seconds=ttl * 2, microseconds=-1), 1005)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long").repartition(5)
    got = ordered.ttl_dedup(df, "k", "ts", "i", ttl)
    assert sorted(tuple(r) for r in got.collect()) == brute_ttl(rows, ttl)
    assert ordered.ttl_dedup(df.limit(0), "k", "ts", "i", ttl).count() == 0


def test_a_hot_key_is_spread(spark, spread):
    """One key with all rows: its ranges lie in several tasks, and values go on across them."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    dealt = ordered.deal(df, ["k"], ["id"])
    assert dealt.groupBy(ordered.TASK).count().agg(F.max("count")).first()[0] < 10_000
    got = ordered.running_sums(dealt, ["k"], {"s": "v"}).select("id", "s").collect()
    assert len(got) == 20_000 and all(r.s == (r.id + 1) // 7 * 21 + sum(range((r.id + 1) % 7)) for r in got)


def test_throttle_delays(spark, spread):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, 0, 5, 20]), rng.choice([None, 0, 1, 6]), rng.choice([None, 0, 0, 0, 1])) for i in range(3000)]
    want, delay = {}, {}
    for k, i, ok, bad, floods in rows:
        if k is None:
            continue
        share, d = (ok or 0) / max((ok or 0) + (bad or 0), 1), delay.get(k, 120.0)
        new = max(d * 2, 300.0) if floods else d * 0.9 if share >= 0.95 else d * 0.95 if share >= 0.8 else d * 1.1 if share >= 0.5 else d * 1.5
        want[i] = delay[k] = max(60.0, min(new, 600.0))
    df = spark.createDataFrame(rows, "k string, i int, ok int, bad int, floods int").repartition(4)
    got = {r.i: r.delay for r in ordered.throttle_delays(df, "k", ["i"], F.col("ok"), F.col("bad"), F.col("floods")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


@pytest.mark.parametrize("most", [200_000, 900])
def test_lexicon_of_ten_thousand(spark, monkeypatch, most):
    """Ten thousand terms, overlapping, repeated and empty ones, found as by a search for each."""
    monkeypatch.setattr(lexicon, "TERMS", most)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abAB آأé ") for _ in range(n))
    terms = [(i, f"c{i % 9}", word(rng.randint(1, 7)), i % 9) for i in range(2500 if most < 1000 else 10_000)] + [(20_000, "c1", "", 1), (20_001, "c1", None, 1), (20_002, "x", "aa", None)]
    texts = [(i, word(rng.randint(0, 120))) for i in range(25)] + [(100, None), (101, ""), (102, "a" * 5000)]
    lex = spark.createDataFrame(terms, "position int, category string, term string, weight int")
    df = spark.createDataFrame([(i, t, "hits") for i, t in texts], "id int, body string, category string")
    norm = {r.t: r.n for r in spark.createDataFrame([(t,) for t in {x[2] for x in terms} | {x[1] for x in texts}], "t string").select("t", T.normalize_arabic(F.lower("t")).alias("n")).collect()}
    got = lexicon.term_hits(df, "body", lex, T.normalize_arabic, ("id", "category")).withColumns({"found": lexicon.categories(F.col("hits")), "points": lexicon.weighted(F.col("hits"))})
    text = dict(texts)
    for r in got.collect():
        own = norm[text[r.id]] or ""
        want = [(p, c, t, w, own.count(norm[t])) for p, c, t, w in terms if norm[t] and norm[t] in own]
        assert [tuple(h) for h in r.hits] == want
        by = {}
        for _, c, t, _, _ in want:
            by.setdefault(c, []).append(t)
        assert r.found == by and r.points == sum(max((w or 0) for _, c, _, w in terms if c == k) if k != "x" else 0 for k in by)
    few = lexicon.term_hits(df, "body", lex.filter("position < 60"), T.normalize_arabic, ("id",))
    totals = Counter()
    for r in lexicon.shares(few, "id").collect():
        totals[r.id] += r.share
    assert all(abs(x - 1) < 1e-9 for x in totals.values())


def test_shares_count_every_term_of_the_lexicon(spark, tmp_path):
    from tidemark.plans.registry import QUERIES

    words = [f"word{a}{b}" for a in "abcdefghijkl" for b in "abcdefghijklmnop"]
    docs = [(0, " ".join(words), "a"), (1, f"{words[-1].upper()} {words[-1]}{words[-1]} {words[61]}", "a"), (2, words[100], "b"), (3, None, "b"), (4, "none", "c"), (5, words[150], None)]
    spark.createDataFrame([(i, " ".join(words[i::3])) for i in range(3)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter({(source, w): 0 for _, _, source in docs for w in words})
    for _, t, source in docs:
        for w in words:
            want[source, w] += (t or "").lower().count(w)
    totals = Counter()
    for (source, _), n in want.items():
        totals[source] += n
    got = {(r.source, r.term): (r.n, r.share) for r in QUERIES["tx3_shares"](spark, str(tmp_path)).collect()}
    assert got == {k: (n, n / totals[k[0]]) for k, n in want.items() if n} and len(got) == len(words) + 2


@pytest.mark.parametrize("n", [1, 2, 3])
def test_levels_prune(spark, n):
    """The rows of the plain count, from far fewer n-grams than there are."""
    rng = random.Random(n)
    words = [f"w{rng.randrange(6000) if rng.random() < 0.8 else rng.randrange(4)}" for _ in range(9000)]
    docs = [(i, " ".join(words[30 * i : 30 * i + 30]) + " the same few words", i % 3 > 0) for i in range(300)] + [(900, None, True), (901, "", False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, positive boolean")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != "")
    if n > 1:
        want = rows_of(mining.contrast(df, tokens, n, blocked=("w7",)))
        assert rows_of(mining.contrast_levels(df, "doc_id", tokens, n, blocked=("w7",))) == want and want
    at = mining.frequent_positions(df, "doc_id", tokens, n).count()
    split = [(t or "").split() for _, t, _ in docs]
    every = sum(max(0, len(w) - n + 1) for w in split)
    df_pos = Counter(g for (_, _, p), w in zip(docs, split, strict=True) if p for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    assert at == sum(df_pos[tuple(w[i : i + n])] >= 2 for w in split for i in range(len(w) - n + 1)) and (n < 2 or at < every / 2)


def test_json_merge_keeps_types(spark):
    cases = [('{"a":1}', '{"c":true}', {"a": 1, "c": True}), ('{"a":{"x":1},"b":null}', '{"a":{"y":[1.5,"2"]}}', {"a": {"y": [1.5, "2"]}, "b": None}), (None, '{"a":"1"}', {"a": "1"}), ("[1]", "nonsense", {})]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", T.json_merge(F.col("a"), F.col("b")).alias("j")).collect()
    assert all(json.loads(r.j) == cases[r.i][2] and not re.search(r'"1"', r.j) or r.i == 2 for r in got)


def test_a_batch_holds_few_texts_hits_as_objects():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from tidemark.operators import lexicon

    terms = [(i, None if i == 3 else f"c{i % 3}", f"t{i:02}", i, f"t{i:02}") for i in range(100)]
    text = " ".join(x[2] for x in terms) + " t07"
    batch = pa.record_batch([pa.array(range(3000)), pa.array([text] * 2999 + [None])], names=["id", "hits_copy"])
    rows, last, most = 0, None, 0
    tracemalloc.start()
    for out in lexicon._finder(SimpleNamespace(value=terms))([batch]):
        rows, last = rows + out.num_rows, out
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and most < 20_000_000
    hits = last.column("hits").to_pylist()
    assert hits[-1] == [] and [h["position"] for h in hits[0]] == list(range(100))
    assert hits[0][7] == {"position": 7, "category": "c1", "term": "t07", "weight": 7, "n": 2} and hits[0][3]["category"] is None
