"""Every registered core query against its oracle, and what SQL cannot say against plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import commercial, ladders, names, relevance, scores, text
from tidemark.operators import eligibility, graph, intake, merge, messages, mining, queues, schedule, state, views
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.sources import io
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels benchmark".split()


def norm(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([norm(r[c]) for c in names]) for r in rows) == sorted(repr([norm(x) for x in r]) for r in found.fetchall())


def fold_events(spark):
    rng = random.Random(9)
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(4000)), i, rng.choice(["success", "flood", "error", "error", "auth" if k == 2 else "success"])) for i in range(300) for k in range(3)]
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by[r[0]].append(r)
    return spark.createDataFrame(rows, "key int, ts timestamp, seq int, kind string"), by


def test_rate_limiter(spark):
    df, by = fold_events(spark)
    want = {}
    for k, rows in by.items():
        log, yes = [], 0
        for _, ts, _, _ in rows:
            log = [x for x in log if x > ts - timedelta(seconds=60)]
            if len(log) < 3:
                log.append(ts)
                yes += 1
        want[k] = (yes, len(rows) - yes)
    assert {r.key: (r.admitted, r.rejected) for r in state.rate_limiter(df, "key", "ts", "seq", 60, 3).collect()} == want


def test_breaker(spark):
    df, by = fold_events(spark)
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    want = {}
    for k, rows in by.items():
        start, n, trips, until = None, 0, 0, None
        for _, ts, _, _ in rows:
            if start is None or ts >= start + timedelta(seconds=100):
                start, n = ts, 0
            n += 1
            if n >= 5:
                trips, until = trips + (until is None or ts >= until), ts + timedelta(seconds=40)
        want[k] = (trips, until)
    got = state.fixed_window_trips(df.unionAll(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))), "key", "ts", "seq", 100, 5, 40)
    assert {r.key: (r.trips, r.open_until) for r in got.collect()} == want


def test_health_machine(spark):
    """A short flood costs 5 and degrades nobody alone; a long one, or the third in half an hour, does."""
    t = datetime(2024, 1, 1)
    cases = {
        "a": [("flood", 61, 0)] + [("success", None, i) for i in range(1, 6)], "b": [("flood", 61, 0), ("error", None, 1)], "c": [("flood", 90, 0), ("flood", 30, 1), ("flood", 30, 2)],
        "d": [("auth", None, 0), ("success", None, 1)], "e": [("flood", 60, 0), ("flood", None, 10)], "f": [("flood", 5, 0), ("flood", 5, 10), ("flood", 5, 29)], "g": [("flood", 5, 0), ("flood", 5, 10), ("flood", 5, 31)], "h": [("other", None, 0), (None, None, 1)],
    }
    rows = [(k, t + timedelta(minutes=m), i, e, w) for k, es in cases.items() for i, (e, w, m) in enumerate(es)]
    got = state.health_machine(spark.createDataFrame(rows, "key string, ts timestamp, seq int, kind string, wait int"), "key", "ts", "seq", "kind", "wait")
    want = {"a": (90, "HEALTHY"), "b": (75, "COOLDOWN"), "c": (75, "RESTRICTED"), "d": (1, "QUARANTINED"), "e": (90, "HEALTHY"), "f": (85, "DEGRADED"), "g": (85, "HEALTHY"), "h": (100, "HEALTHY")}
    assert {r.key: (r.health, r.state) for r in got.collect()} == want


def test_folds_hold_no_history(spark):
    df, by = fold_events(spark)
    df = df.unionAll(df.filter("key = 0").withColumn("key", F.lit(None).cast("int")))
    folds = [
        state.rate_limiter(df, "key", "ts", "seq", 60, 3), state.fixed_window_trips(df, "key", "ts", "seq", 100, 5, 60),
        state.health_machine(df.withColumn("wait", F.col("seq") % 90), "key", "ts", "seq", "kind", "wait"), state.connector_health(df, "key", "ts", "seq", "kind"),
    ]
    rows = [sorted(map(repr, f.collect())) for f in folds]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a key spans many batches
    try:
        for f, want in zip(folds, rows, strict=True):
            assert "collect_list" not in f._jdf.queryExecution().toString() and len(want) == 4
            assert sorted(map(repr, f.select("*").collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_languages_and_null_texts(spark, tmp_path):
    rows = [(1, "le secret", "fr", "a", 9), (2, "das token", "de", "a", 9), (3, None, "en", "a", 0), (4, "the haus haus", "de", "a", 9), (5, "haus", None, "a", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (2, 4, 5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.terms for r in run("tx1_lexicon_all")} == {1: "secret", 2: "token", 3: "", 4: "the", 5: ""}
    assert {r.feature: r.df_pos for r in run("lm4_contrast_all")} == {"haus": 2}
    scores = {r.doc_id: r.score for r in run("sc17_intent_all")}
    assert len(scores) == 5 and scores[3] == 0


def test_bfs_traverses_all_edges(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    pairs = {(r[0], -r[1]) for r in spark.read.parquet(f"{SF}/orders.parquet").join(lines, F.expr("o_orderkey = l_orderkey")).select("o_custkey", "l_suppkey").collect()}
    steps = defaultdict(set)
    for a, b in pairs:
        steps[a].add(b)
        steps[b].add(a)
    want = frontier = {7: 0}
    for hop in (1, 2, 3):
        frontier = {t: hop for v in frontier for t in steps[v] if t not in want}
        want = want | frontier
    got = {r.vertex: r.hop for r in QUERIES["gr5_bfs_all"](spark, SF).collect()}
    assert got == want


def test_streams_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    hours = streams.run_to_end(streams.hourly(streams.events(spark, SF)), "hourly", str(tmp_path / "a"))
    want = batch.groupBy(F.date_trunc("HOUR", "ts").cast("timestamp").alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    assert hours.exceptAll(want).count() == 0 and hours.count() == want.count()
    marks = streams.run_to_end(streams.high_water(streams.events(spark, SF)), "marks", str(tmp_path / "b"))
    assert marks.exceptAll(batch.groupBy("user_id").agg(F.max("event_id"), F.count("*"))).count() == 0
    table = streams.to_parquet(streams.high_water(streams.events(spark, SF)), str(tmp_path / "t"), str(tmp_path / "d"), "complete")
    assert sorted(table.collect()) == sorted(marks.collect())
    rows = streams.to_parquet(streams.first_seen(streams.events(spark, SF), "user_id", "60 days"), str(tmp_path / "u"), str(tmp_path / "e"))
    assert rows.select("user_id").distinct().count() == rows.count()
    once = streams.run_to_end(streams.first_seen(streams.events(spark, SF), "user_id", "60 days"), "once", str(tmp_path / "c"), "append")
    assert once.count() == batch.select("user_id").distinct().count()


def test_text_functions(spark):
    df = spark.createDataFrame([(None,), ("",), ("1.2K",), ("3M",), ("1,234",), ("x",)], "t string")
    assert [r.n for r in df.select(text.human_number(F.col("t")).alias("n")).collect()] == [0, 0, 1200, 3000000, 1234, 0]
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    assert one(text.normalize_arabic(F.lit("أَحْمَـد  ى"))) == "احمد ي"
    assert one(text.script_ratio(F.lit("ab سل"))) == 0.5 and one(text.script_ratio(F.lit("12"))) == 0.0
    assert one(text.word_count_of(F.lit("Gold golden gold_ GOLD"), "gold")) == 2
    assert one(text.canonical_handle(F.lit("https://www.example.com/s/SomeName?x=1"))) == "somename"
    assert one(text.symbols(F.lit("buy eur/usd and EURUSD, abc"), ("EUR",))) == ["EURUSD"]
    assert one(text.message_errors(F.lit("hi {name} http:// "))) == ["placeholder", "bad_url"]
    assert one(ladders.lifecycle(F.lit(3), F.lit(0), F.lit(2.0))) == "active" and one(ladders.lifecycle(F.lit(5), F.lit(2), F.lit(3.0))) == "deprecated"
    assert one(ladders.lifecycle(F.lit(20), F.lit(1), F.lit(0.1), F.lit("deprecated"))) == "candidate" and one(ladders.lifecycle(F.lit(20), F.lit(1), F.lit(0.1))) == "observed"
    assert one(ladders.signal_confidence(F.lit(0), F.lit(0), F.lit(3), F.lit(4.0))) == 0.0 and one(ladders.signal_confidence(F.lit(5), F.lit(5), F.lit(0), F.lit(4.0))) == 1.0
    assert one(ladders.growth_score(F.lit(0.0), F.lit(5.0), F.lit(1.0))) == 95 and one(ladders.growth_score(F.lit(0.0), F.lit(0.0), F.lit(1.0))) == 50
    zero = F.lit(0)
    assert one(ladders.activity_score(zero, zero, zero, F.lit(3))) == 15 and one(ladders.activity_score(zero, zero, zero)) == 5
    assert [one(ladders.freshness(F.lit(None).cast("double"), F.lit(a), F.lit(b), F.lit(m))) for a, b, m in ((1, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0))] == [90, 60, 35, 10]
    assert one(text.normalize_for_mining(F.lit("أَآٱ ى ئ"))) == "ااٱ ي ئ" and one(text.clean_for_mining(F.lit("see https://a.b/c @name +12 345-678-90! ok: a/b"))) == "see ok: a/b"
    assert one(ladders.smoothed_log_odds(F.lit(8), F.lit(10), F.lit(0), F.lit(20))) > 2


def test_merge_and_graph(spark):
    b = spark.createDataFrame([(1, 5, "x"), (2, None, None)], "k int, v int, s string")
    d = spark.createDataFrame([(2, 7, "y"), (1, 3, None), (3, 1, "z")], "k int, v int, s string")
    got = {r.k: (r.v, r.s) for r in merge.merge(b, d, "k", {"v": "max", "s": "coalesce"}).collect()}
    assert got == {1: (5, "x"), 2: (7, "y"), 3: (1, "z")}
    assert {r.k for r in merge.insert_or_ignore(b, d, ["k"]).collect()} == {1, 2, 3}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4)], "source int, target int")
    hops = graph.bounded_bfs(e, spark.createDataFrame([(1,)], "vertex int"), 2)
    assert {r.vertex: r.hop for r in hops.collect()} == {1: 0, 2: 1, 3: 2}


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, '{"k": 2}'), (2, "{bad"), (3, None)], "id int, body string")
    good, bad = io.dead_letters(df, "body", "k int")
    assert [(r.id, r.k) for r in good.collect()] == [(1, 2)] and {r.id for r in bad.collect()} == {2, 3}


def test_scores_without_a_query(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    n, kinds, none = F.lit, lambda *k: F.array(*map(F.lit, k)), F.lit(None)
    assert [one(scores.script_score(n(r), n(v))) for r, v in ((0.15, 2), (0.05, 1), (0.0, 3), (0.9, 0), (0.149, 2))] == [75, 45, 50, 90, 45]
    assert one(scores.script_score(none.cast("double"), none.cast("int"))) == 0
    assert one(scores.contact_score(n(True), kinds("owner", "whatsapp"))) == 90 and one(scores.contact_score(none.cast("boolean"), none.cast("array<string>"))) == 0
    assert one(scores.commercial_score(n(3), n(2))) == 75 and one(scores.commercial_score(n(9), n(9))) == 100
    assert [one(scores.discovery_score(n(k), kinds("a", "b", "b"))) for k in (0, 3, 4)] == [60, 80, 100]
    at = lambda day: F.lit(day).cast("timestamp")
    young = lambda created, seen: one(scores.new_channel_score(created, seen, at("2024-06-30")))
    unknown = none.cast("timestamp")
    assert (young(at("2024-05-31"), unknown), young(at("2024-04-01"), unknown), young(at("2024-01-01"), at("2024-06-29")), young(unknown, at("2024-06-16")), young(unknown, unknown)) == (40, 25, 0, 35, 0)
    klass = lambda *v: one(scores.topic_class(*map(n, v)))
    assert [klass(60, 0, 0, 0, 15, 50), klass(60, 0, 0, 0, 14, 50), klass(0, 20, 0, 0, 0, 20), klass(0, 0, 0, 0, 0, 99)] == ["HIGH_CONFIDENCE", "LIKELY", "POSSIBLE", "LOW_CONFIDENCE"]
    assert [one(scores.backoff(n(k), 2, 60)) for k in (0, 3, 9)] == [2.0, 16.0, 60.0]
    step = lambda *v: one(scores.throttle_step(*map(n, v), 60, 600))
    assert [step(100.0, 0, 0, 1), step(100.0, 95, 5, 0), step(100.0, 8, 2, 0), step(100.0, 1, 1, 0), step(500.0, 0, 4, 0)] == pytest.approx([300, 90, 95, 110, 600])


def test_schedule_without_a_query(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, 1, 0, "processing", t), (2, 1, 2, 0, "processing", t), (3, 1, 3, 3, "processing", t), (4, 1, 4, 0, "sent", t), (5, 1, 5, 0, "processing", t + timedelta(minutes=50))]
    claims = spark.createDataFrame(rows, "id int, campaign_id int, lead_id int, attempt_count int, status string, last_attempt_at timestamp_ntz")
    sent = spark.createDataFrame([(1, 1), (1, 1)], "campaign_id int, lead_id int")
    got = schedule.reconciled(claims, sent, "2024-01-01 01:00:00", 30, 3).collect()
    assert sorted((r.id, r.status) for r in got) == [(1, "sent"), (2, "pending"), (3, "failed")]
    accounts = spark.createDataFrame([("b", 1, 0, 10, False), ("a", 1, 0, 10, False), ("c", 0, 2, 0, True)], "name string, active int, errors int, idle int, recovering boolean")
    assert schedule.least_loaded(accounts).first().name == "a"
    jobs = spark.createDataFrame([(1, "running", t), (2, "running", t + timedelta(minutes=45)), (3, "failed", t)], "id int, status string, executed_at timestamp_ntz")
    assert [r.id for r in schedule.stale_running(jobs, "2024-01-01 01:00:00").collect()] == [1]
    assert [r.v for r in spark.createDataFrame([(80,), (50,), (30,), (29,)], "h int").select(schedule.delay_band(F.col("h")).alias("v")).collect()] == ["short", "medium", "long", "longest"]


TRIGGERS = {"owner": "owner|founder", "admin": "support|admin", "analyst": "analyst", "contact": "contact|dm"}


def test_contacts(spark):
    rows = [
        (1, None, "Owner: @Boss_1 and @Boss_2\n\nSupport and owner\n@Desk_9", "write @other1", "@chan"),  # the second owner falls through
        (2, "Contact me\n  \n@Pinned_1", "contact @Second_1", None, "x"),  # the pinned text comes first; the line before counts
        (3, None, None, "see @chan, @junk and @free_1 @free_2 @helper_bot", "Chan"),  # own name, junk, the first of no class
        (4, None, None, None, None), (5, "", "", "", ""), (6, None, "the analyst: t.me/Ana_1", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, pinned string, bio string, text string, channel string")
    got = {r.id: tuple(r.c) for r in df.select("id", messages.contacts(F.col("pinned"), F.col("bio"), F.col("text"), F.col("channel"), TRIGGERS, ("junk",)).alias("c")).collect()}
    assert got == {
        1: ("Boss_1", "Desk_9", None, "Boss_1", None, 95), 2: (None, None, None, "Pinned_1", None, 85), 3: (None, None, None, "free_1", "helper_bot", 70),
        4: (None,) * 6, 5: (None,) * 6, 6: (None, None, "Ana_1", "Ana_1", None, 90),
    }


def test_contact_fields(spark):
    rows = [(1, "Call wa.me/+971501234567 or A.B@Mail.org!"), (2, "phone: +44 7700-900123"), (3, "+44 7700-900123"), (4, "https://x.com/me, https://linktr.ee/me https://site.io/a). http://t.me/abc https://x.com/me,"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: (r.e, tuple(r.p), tuple(r.w)) for r in df.select("id", messages.email(F.col("t")).alias("e"), messages.phone(F.col("t")).alias("p"), messages.websites(F.col("t")).alias("w")).collect()}
    none = (None, None, [])
    assert got[1][:2] == ("a.b@mail.org", ("971501234567", 100)) and got[2] == (None, ("447700900123", 85), none)
    assert got[3] == got[5] == got[6] == (None, (None, None), none)
    assert got[4][2] == ("https://site.io/a", "https://linktr.ee/me", ["https://x.com/me"])


def test_contact_mention(spark):
    rows = [("support: @abcd", True), ("support\n" + "x" * 60 + " @abcd", True), ("support\n" + "x" * 80 + " @abcd", False), ("@abcd " + "x" * 20 + "\nsupport", True), ("@abcd " + "x" * 50 + "\nsupport", False), ("support @abcde", False), ("", False), (None, False), ("hello @abcd", False), ("x" * 90 + "\n@abcd\n" + "y" * 100 + "@abcd\nSupport", True)]
    df = spark.createDataFrame([(i, t, "@abcd") for i, (t, _) in enumerate(rows)], "i int, t string, h string")
    got = {r.i: r.m for r in df.select("i", messages.contact_mention(F.col("t"), F.col("h"), "support").alias("m")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_message_edges(spark):
    rows = [("a", "join t.me/Best_One with @friend1, support @desk1" + "." * 3, "orig"), ("b", "t.me/Best_One t.me/best_one @pal_1 a@mail1.org", None), ("c", None, None), ("d", "", None)]
    df = spark.createDataFrame(rows, "s string, t string, f string")
    got = sorted(tuple(r) for r in messages.message_edges(df, "s", "t", F.col("f"), "join", "support ").collect())
    assert got == [("a", "best_one", "link", 85), ("a", "orig", "forward", 95), ("b", "best_one", "link", 75), ("b", "pal_1", "mention", 70)]


def test_gate_lets_no_null_through(spark):
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    ok, name = F.lit("Approved"), F.lit("@Person")
    cases = [((no, yes, yes, ok, no, name), "ALLOWED"), ((none, yes, yes, ok, no, name), "BLOCKED_BY_KILL_SWITCH"), ((no, none, yes, ok, no, name), "OUTREACH_DISABLED"), ((no, yes, none, ok, no, name), "SECURITY_VIOLATION"), ((no, yes, yes, F.lit(None).cast("string"), no, name), "APPROVAL_REQUIRED"), ((no, yes, yes, ok, none, name), "DRY_RUN"), ((no, yes, yes, ok, no, F.lit(" @ ")), "INVALID_TARGET"), ((no, yes, yes, ok, no, F.lit("My_Bot")), "INVALID_TARGET")]
    got = spark.range(1).select(*[state.safety_gate(*a).alias(f"c{i}") for i, (a, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_text_fed_scores(spark):
    texts = ["Become an IB of this broker", "ib.", "Alpha Markets, register here", "AlphaMarkets register", "affiliate programme", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    flag = commercial.broker_model(F.col("t"), ["affiliate programme"], ["Alpha"], ["broker"], ["register"])
    got = {r.i: (r.f, r.w, r.a) for r in df.select("i", flag.alias("f"), commercial.distinct_words(F.col("t"), ["ib", "alpha"]).alias("w"), commercial.region_score(F.col("t"), F.col("t"), {"x": (["here"], "+1")}).alias("a")).collect()}
    assert [got[i][0] for i in range(7)] == [True, False, True, False, True, False, False]
    assert [got[i][1] for i in range(7)] == [1, 1, 1, 0, 0, 0, 0] and got[2][2] == 20 and got[6][2] == 0
    null = F.lit(None).cast("int")
    none = F.lit(None).cast("boolean")
    row = spark.range(1).select(
        commercial.intent_score(null, null, [none], none, none, none, null).alias("a"), commercial.arabic_score(null.cast("string"), F.lit("قناة"), null, null, none, none, F.lit(True)).alias("b"),
        commercial.complexity(null, null, null, null, none, null).alias("c"), commercial.commercial_activity(null, null, null, null, none, none).alias("d"),
        commercial.commercial_freshness(null.cast("double"), none).alias("e"), commercial.commercial_freshness(F.lit(-2.0), none).alias("f"),
    ).first()
    assert tuple(row) == (0, 40, 0, 0, 0, 5)


def test_eligibility_edges(spark):
    at = lambda day: datetime(2024, 1, day)
    leads = [
        (1, "@Ann", None, None, None, None), (2, "ann", None, None, None, None), (3, None, None, None, None, None), (4, "@", None, None, None, None), (5, "x_bot", None, None, None, None), (6, "Admin", None, None, None, None),
        (7, "bad", None, None, None, None), (8, "cid", "rejected", None, None, None), (9, "dan", None, None, None, " Inactive channel since"), (10, "eve", None, at(20), None, None), (11, "fay", None, at(10), 76, None), (12, "gus", None, None, 75, None), (13, "hal", None, None, 90, None),
    ]
    logs = [(1, "c1", "sent"), (13, "c2", "failed"), (13, "c2", "failed"), (13, "c2", "failed"), (None, "c1", "sent"), (99, "c1", "sent"), (12, None, None)]
    got = eligibility.eligibility(
        spark.createDataFrame(leads, "id long, contact string, status string, next_eligible_at timestamp_ntz, risk int, about string").withColumn("_name2", F.lit(1)),
        spark.createDataFrame(logs, "lead_id long, campaign_id string, status string"), spark.createDataFrame([("@BAD",), ("bad",), (None,)], "name string"), "c1", "2024-01-15", ("admin",),
    ).collect()
    assert len(got) == 13
    assert {r.id: (r.eligibility, r.reason) for r in got} == {
        1: ("CONTACTED", "in this campaign"), 2: ("CONTACTED", "by another lead"), 3: ("BLOCKED", "empty contact"), 4: ("BLOCKED", "empty contact"), 5: ("BLOCKED", "bot"), 6: ("BLOCKED", "system name"), 7: ("BLOCKED", "blacklisted"),
        8: ("BLOCKED", "rejected"), 9: ("BLOCKED", "inactive"), 10: ("COOLDOWN", "cooling down"), 11: ("RISKY", "risk"), 12: ("ELIGIBLE", "eligible"), 13: ("FAILED", "failure history"),
    }


def test_forward_origin(spark):
    rows = [
        (1, (("c1", "u1", None), ("c9",), 5, 6, "@Name_1", "@direct", "chat_1", datetime(2024, 1, 1))), (2, ((None, "u2", "g2"), None, 0, 6, " @Name_2 ", "", None, None)),
        (3, (None, ("c3",), None, None, "at t.me/name_3/7", None, None, None)), (4, (None, None, None, None, "@", None, None, None)), (5, None),
    ]
    df = spark.createDataFrame(rows, f"i int, h {messages.FORWARD}")
    got = {r.i: r.o and tuple(r.o) for r in df.select("i", messages.forward_origin(F.col("h"), F.col("i")).alias("o")).collect()}
    assert got == {
        1: ("c1", "c1", 5, "@Name_1", "chat_1", 1, datetime(2024, 1, 1)), 2: (None, "u2", 6, " @Name_2 ", "Name_2", 2, None), 3: ("c3", "c3", None, "at t.me/name_3/7", "name_3", 3, None),
        4: (None, None, None, "@", None, 4, None), 5: None,
    }


def test_first_stage(spark):
    df = spark.createDataFrame([(1, "Gold", "gold and silver", "x"), (2, "قناة VIP", None, "a"), (3, None, None, None), (4, "gold", "", "my_bot"), (5, "قناة", "", "a")], "i int, t string, a string, n string")
    got = {r.i: tuple(r.x) for r in df.select("i", commercial.first_stage(F.col("t"), F.col("a"), F.col("n"), ["gold", "silver"], ["vip"]).alias("x")).collect()}
    assert got == {1: (True, "terms", 50), 2: (True, "community", 40), 3: (True, "second stage", 20), 4: (False, "bot", 0), 5: (True, "second stage", 20)}


def test_links(spark):
    cases = {
        "https://t.me/forex_signals_vip": ("public", "forex_signals_vip"), "fvgtrading": ("public", "fvgtrading"), "@some_name11": ("public", "some_name11"), "https://t.me/+AbCdEfGhIjKlMnOp": ("private", "AbCdEfGhIjKlMnOp"),
        "https://t.me/joinchat/AAAAAFM_q12345": ("private", "AAAAAFM_q12345"), "https://t.me/CryptoAlert_bot": (None, None), "https://t.me/contact": (None, None), "https://t.me/support": (None, None),
        "": (None, None), " abcd ": ("public", "abcd"), "abc": (None, None), "123456": (None, None), "t.me/abcd": (None, None), "@" + "x" * 33: (None, None), "T.ME/" + "y" * 40: ("public", "y" * 32),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "l string").select("l", relevance.parse_link(F.col("l")).alias("p"), relevance.normal_link(F.col("l")).alias("n")).collect()
    assert {r.l: (r.p.kind, r.p.name) for r in df} == cases | {None: (None, None)}
    links = ["t.me/my_channel", "telegram.me/my_channel", "http://t.me/my_channel", " https://t.me/my_channel", "my_channel"]
    assert {r.n for r in spark.createDataFrame([(x,) for x in links], "l string").select(relevance.normal_link(F.col("l")).alias("n")).collect()} == {"https://t.me/my_channel"}


def test_relevance_in_arabic(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    assert one(relevance.signal_syntax(F.lit("شراء من 2300 هدف 1 وقف خسارة"))) == 3
    assert one(relevance.syntax_names(F.lit("شراء ذهب، وقف خسارة: 2300، هدف 2: 2310 ربح 50 نقطة رافعة مالية"))) == ["buy_entry", "take_profit", "stop_loss", "pips_gain", "leverage"]
    assert one(relevance.first_term(F.lit("أفلام ومسلسلات"), ["كازينو", "افلام"])) == "افلام" and one(relevance.first_term(F.lit(None).cast("string"), ["a"])) is None
    names = ("pairs", "syntax", "forex", "gold", "signals", "methods", "styles", "commercial", "props", "brokers")
    def card(text, bad=None, penalty=0, referred=False, recommended=False, degree=0, **k):
        counts = {n: F.lit(k.get(n, 0)) for n in names}
        return one(relevance.relevance(F.lit(text), counts, F.lit(referred), F.lit(recommended), F.lit(degree), F.lit(0), F.lit(penalty), F.lit(0), F.lit(bad).cast("string")))[:5]
    assert card("توصيات الذهب مع تحليل", gold=1, signals=1) == (45, "LIKELY_FOREX", "Tier_B", "queue:high", True)
    assert card("x", pairs=3, syntax=2, commercial=1) == (75, "HIGH_CONFIDENCE_FOREX", "Tier_A", "queue:high", True)
    assert card("x", pairs=3, syntax=2, commercial=1, penalty=30) == (45, "LOW_CONFIDENCE", "Tier_D", "queue:normal", False)
    assert card("hello", recommended=True, degree=2) == (30, "LOW_CONFIDENCE", "Tier_D", "queue:normal", False)
    assert card("hello", referred=True, recommended=True) == (20, "LOW_CONFIDENCE", "Tier_D", "queue:normal", False) and card("hello", referred=True, degree=2)[1] == "POSSIBLE_FOREX"
    assert card("chart", referred=True) == (30, "POSSIBLE_FOREX", "Tier_C", "queue:normal", True) and card("gold", bad="casino")[:2] == (0, "REJECTED")
    assert one(relevance.script_triple(F.lit("سلام abc 12"), F.array(F.lit("سلام"), F.lit("x"), F.lit(None)))) == (44, 33, 33, 37)
    assert one(relevance.niche_gate(F.lit("gold: صفقة, صفقة! صفقات"), F.lit(False), ["casino"], ["gold"], ["صفقة", "صفقات"])) is True
    assert one(relevance.niche_gate(F.lit("gold: صفقة, صفقة! صفقات"), F.lit(True), ["casino"], ["gold"], ["صفقة", "صفقات"])) is False


def test_importance_of_a_hub(spark):
    rows = [(1, 25, 4, 3, 6, 12), (2, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "target int, in_degree int, relations int, sources int, recommendations int, forwards int")
    assert {r.target: r.importance for r in graph.importance(df).collect()} == {1: 100, 2: 0}
    edges = spark.createDataFrame([(1, 9, "forward"), (1, 9, "forward"), (2, 9, "similar"), (3, 9, None), (None, 9, "forward")], "source int, target int, relation string")
    assert graph.in_profile(edges, {"recommendation": ["similar"], "forward": ["forward"]}).collect()[0][:] == (9, 5, 3, 2, 1, 3)


def test_not_in_and_sinks(spark, tmp_path):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (2,)], "o int")
    null = right.unionAll(spark.createDataFrame([(None,)], "o int"))
    assert [views.not_in(left, "k", x, "o").count() for x in (right, null, right.limit(0))] == [1, 0, 3]
    io.append(left, str(tmp_path / "s"))
    io.append(left, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i int, t string")
    io.export(df, str(tmp_path / "c"))
    io.export(df, str(tmp_path / "j"), "json")
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "c")).collect())) == [("1", "a,b"), ("2", None)]
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_queues(spark):
    rows = spark.createDataFrame([(1, "A "), (2, "a"), (3, "b"), (4, None)], "n int, k string")
    assert [r.n for r in queues.unseen(rows, spark.createDataFrame([("B",)], "k string"), "k", [F.col("n")]).collect()] == [1]
    acc = spark.createDataFrame([(1, "HEALTHY", 70, None), (2, "HEALTHY", 90, "2024-02-01"), (3, "DEGRADED", 95, None), (4, "HEALTHY", 80, "2024-01-01")], "id int, st string, h int, cool string").withColumn("cool", F.col("cool").cast("timestamp_ntz"))
    assert queues.healthiest(acc, ["HEALTHY"], "h", "st", "cool", [], "id", "2024-01-15").first().id == 4
    assert queues.healthiest(acc, ["HEALTHY"], "h", "st", "cool", [4], "id", "2024-01-15").first().id == 1
    limited = F.col("id") == 3
    assert queues.preferred_session(acc, "id", "h", limited, F.col("id") == 1).first().id == 1 and queues.preferred_session(acc, "id", "h", limited, limited).first().id == 3
    got = spark.range(1).select(queues.appended(F.array(F.lit("a"), F.lit("a")), F.lit("a")).alias("x"), queues.appended(F.lit(None), F.lit("b")).alias("y")).first()
    assert got.x == ["a", "a"] and got.y == ["b"]


def test_mining_model(spark):
    known = spark.createDataFrame([("xxxxx", "gold", "candidate", 0.5, 1.0, 2), ("zzzzz", "gold", "active", 0.1, 0.0, 0)], "value string, category string, status string, confidence double, contrast double, negatives long")
    found = spark.createDataFrame([(1, "xxxxx"), (1, "xxxxx"), (1, "yyyyy"), (2, "yyyyy"), (3, "yyyyy"), (3, None), (3, "abcd")], "channel int, value string")
    got = {r.value: (r.category, r.status, round(r.confidence, 6), round(r.contrast, 6), r.negatives) for r in mining.rejected(known, found, "phrase", "channel").collect()}
    assert got == {"xxxxx": ("gold", "candidate", 0.3, -0.5, 3), "zzzzz": ("gold", "active", 0.1, 0.0, 0), "yyyyy": ("negative_spam", "active", 0.0, -6.0, 3)}
    many = spark.createDataFrame([(1, f"w{i:02}") for i in range(40)] + [(1, "ab")], "channel int, value string")
    assert sorted(r.value for r in mining.rejected(known.limit(0), many, "keyword", "channel").collect()) == [f"w{i:02}" for i in range(14)]  # "ab" is among the first 15, but too short
    signals = [("a", "negative_spam", "deprecated", -2.0, "keyword"), ("b", "gold", "observed", -2.0, "keyword"), ("c", "negative_spam", "active", 1.0, "phrase"), ("d", "gold", "validated", -1.5, "symbol"), ("e", None, "candidate", None, "keyword"),
        ("f", "gold", "candidate", 1.0, "domain"), ("g", "gold", "validated", -1.0, "domain"), ("h", "gold", None, 2.0, "keyword")]
    df = spark.createDataFrame(signals, "value string, category string, status string, contrast double, kind string")
    assert {r.value: r.part for r in mining.model_part(df, "category", "status", "contrast", "kind").collect()} == {"c": "negative", "e": "candidate", "g": "active"}
    e = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, t int, v string")
    assert {r.k: r["first"] for r in mining.first_rows(e, "k", ["t"], "v", 2).collect()} == {1: ["a", "b"], 2: [None]}


def test_query_variants_and_mix(spark):
    words = ["توصيات الذهب", "فوركس", "gold", "smc", "", None]
    got = {r.w: r.v for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", names.query_variants(F.col("w"), 6).alias("v")).collect()}
    assert got["توصيات الذهب"] == ["توصيات الذهب", "توصيات ذهب", "التوصيات الذهب", "توصيات الذهب XAUUSD"] and got["فوركس"] == ["فوركس", "الفوركس", "فوركس Forex"]
    assert got["gold"] == ["gold", "gold XAUUSD"] and got["smc"] == ["smc", "smc تحليل"] and got[""] == [] and got[None] == []
    df = lambda *q: spark.createDataFrame([(x,) for x in q], "query string")
    active, candidates, fallback = df(*[f"a{i}" for i in range(20)], "one two three four five", " "), df("a1", "b1", "b2", None), df("f1", "f2", "a1")
    mix = [tuple(r) for r in intake.query_mix(active, candidates, fallback, 10, 7).collect()]
    assert len(mix) == len({q for q, _ in mix}) == 10 and sum(s == "exploit" for _, s in mix) == 8 and "one two three four five" not in {q for q, _ in mix}
    mix = [tuple(r) for r in intake.query_mix(df("a1"), candidates, fallback, 10, 7).collect()]
    assert sorted(mix) == [("a1", "exploit"), ("b1", "explore"), ("b2", "explore"), ("f1", "fallback"), ("f2", "fallback")]


def test_names(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    for raw, want in {"@@name.": "name", "__ab": "_ab", "ab__": "ab_", "____": "___", " /x_y_z!? ": "x_y_z", "ab": None, "x" * 36: None, None: None}.items():
        assert one(names.clean_handle(F.lit(raw).cast("string"))) == want, raw
    assert one(names.redirect_target(F.lit("https://r.io/?u=a1aHR0cHM6Ly9hLmIv&x=1"), "r.io")) == "https://a.b/" and one(names.redirect_target(F.lit("https://r.io/?u=a1%%"), "r.io")) == "https://r.io/?u=a1%%"
    assert one(names.listed_once(F.array(F.lit("A"), F.lit("a"), F.lit("XBot"), F.lit("b")))) == ["A", "b"]
