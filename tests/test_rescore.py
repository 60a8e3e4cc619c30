"""Window view, rescoring, mined handles, search templates and checkpoints on small rows with nulls, ties and repeats."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.text import clip
from tidemark.operators import graph, intake, rescore, views

LEAD = "id int, channel_username string, discovered_at timestamp_ntz, outreach_priority_reason string, entity_type string, member_count int, lead_score int, description string, status string, tier string, contact_username string, whatsapp string"
NOW = "2024-01-10 00:00:00"


def test_window_view(spark):
    at, old = datetime(2024, 1, 9, 12), datetime(2024, 1, 8)
    rows = [
        (1, "good_1", at, None, None, 5, None, None, "new", None, None, None), (2, "good_2", at, "user_account", None, 5, 50, "d", "new", "A", "c", None), (3, "good_3", at, "other", "user", 5, 50, "d", "new", "A", "c", None),
        (4, "a-b-c", at, None, None, 5, 50, "d", "new", "A", "c", None), (5, "good_5", old, None, None, 5, 50, "d", "new", "A", "c", None), (6, "good_6", old, None, None, 0, None, "", "rejected", "B", "", "+1"),
        (7, "good_7", at, None, "channel", 0, None, "", "new", None, None, ""), (8, "good_8", at, None, None, None, 10, None, "rejected", "A", "Some%one", None), (9, None, at, None, None, 5, 50, "d", "new", "A", "c", None), (10, "good\n", at, None, None, 5, 50, "d", "new", "A", "c", None),
    ]
    df = spark.createDataFrame(rows, LEAD)
    ids = lambda *a, **k: sorted(r.id for r in df.filter(views.lead_window(NOW, *a, **k)).collect())
    assert ids() == ids("Scanned") == [1, 8] and ids("all") == ids("nonsense") == [1, 7, 8]
    assert ids("pending_scan") == [1, 7] and ids("rejected") == [8] and ids("qualified") == []
    assert ids("with_contact") == [6, 8] and ids("with_contact", "A") == [8] and ids("with_contact", "B") == [6, 8]
    assert ids("all", "ALL", " OD_7 ") == [7] and ids("all", None, "SOME") == [8] and ids("all", None, "  ") == [1, 7, 8] and ids("all", "B") == []
    assert ids("all", window="48 hours") == [1, 5, 6, 7, 8]


def test_rescore(spark):
    lead = "id int, username string, description string, is_group boolean, status string, last_scan int, script_score int, mark string"
    leads = spark.createDataFrame([(1, "a", "good", None, "new", 1, None, "x"), (2, "b", None, True, "new", 1, 60, "x"), (3, "c", "good", True, "old", 1, 50, "x"), (4, None, "good", False, "new", 1, 0, "x"), (5, "a", "good", False, "rejected", 1, 0, "x"), (6, "f", "good", False, "new", None, 0, "x")], lead)
    posts = spark.createDataFrame([("a", f"P{i}", i) for i in range(5)] + [("b", "good", 1), ("b", None, 3), ("b", "", 2), (None, "good", 1)], "ch string, body string, at int")
    texts = rescore.newest_texts(posts, "ch", "body", [F.col("at")], 3)
    assert {r.channel: r.posts for r in texts.collect()} == {"a": ["P4", "P3", "P2"], "b": ["good"]}
    keywords = spark.createDataFrame([(1, 40), (1, 20), (3, None)], "channel int, frequency int")
    edges = spark.createDataFrame([(1,), (None,)], "target int")
    metrics = spark.createDataFrame([(3, 80), (2, None)], "group_id int, marketplace_score int")

    def judge(l, t, k, e, m):
        out = rescore.rescore(l, t, k, e, m, lambda x, g: x.contains("good"), lambda x: F.when(x.contains("p4 \n p3 \n p2"), 40).otherwise(35), lambda w, d: w + d)
        return {r.id: tuple(r)[1:] for r in out.collect()}

    got = judge(leads, texts, keywords, edges, metrics)
    assert got == {1: ("new", 61, "Tier_B", 40), 2: ("new", 50, "Tier_B", 35), 3: ("old", 80, "Tier_A", 35), 4: ("rejected", 0, "Tier_D", 35)}
    none = judge(leads, texts.limit(0), keywords.limit(0), edges.limit(0), metrics.limit(0))
    assert none == {1: ("rejected", 0, "Tier_D", 35), 2: ("rejected", 0, "Tier_D", 35), 3: ("old", 50, "Tier_B", 35), 4: ("rejected", 0, "Tier_D", 35)}
    assert judge(leads.limit(0), texts, keywords, edges, metrics) == {}


def test_handles(spark):
    rows = spark.createDataFrame([(1, "s", "Call @Ads_One and @x, for ads: @Ads_One  \n ads manager » joe_bot", None), (2, "s", None, "@@Media_X"), (3, None, "@media_bot @plain_bot @stop_ads", "none"), (4, "t", "", "")], "n int, handle string, reason string, confidence string")
    found = rescore.handle_mentions(rows, "handle", "reason", ["n"], [r"(?:for ads|ads manager)[\s:»]+@?([a-z0-9_]{4,32})"], r"@([a-zA-Z0-9_]{4,32})", r"^\w*(?:ads|media)\w*$", {"introduced": ("i", 25), "mention": ("m", 15), "contact": ("c", 30)}, ("stop_ads",), "confidence")
    got = sorted((r.n, r.handle, r.reason, r.confidence, r.channel) for r in found.collect())
    assert got == [(1, "ads_one", "i", 25, "s"), (1, "ads_one", "m", 15, "s"), (1, "ads_one", "m", 15, "s"), (2, "media_x", "c", 30, "s"), (3, "media_bot", "m", 15, None)]
    assert found.filter("n = 1").first().snippet == "Call @Ads_One and @x, for ads: @Ads_One ads manager » joe_bot"
    assert rescore.handle_mentions(rows.limit(0), "handle", "reason", ["n"], [], "@(x)", "x", {"mention": ("m", 1)}).count() == 0
    assert [r[0] for r in spark.createDataFrame([("  a \n b ",), (None,), ("x" * 9,)], "t string").select(clip(F.col("t"), 4)).collect()] == ["a b", "", "xxxx"]


def test_search_templates(spark):
    seeds = spark.createDataFrame([("Gold Now", 2), ("gold now ", 3), ("a", 1), (None, 0)], "seed string, n int")
    made = lambda platform, limit: [r.query for r in intake.search_queries(seeds, "seed", ["n"], {"x": ["{seed}!", "#{joined}"]}, ["{seed}?"], platform, limit).collect()]
    assert made(" X ", 3) == ["a!", "#a", "Gold Now!"] and sorted(made("x", None)) == ["#GoldNow", "#a", "Gold Now!", "a!"] and made("y", 9) == ["a?", "Gold Now?"]


def test_checkpoints(spark):
    log = [("a", "save", 5, "in_progress", 1), ("a", "reset", None, None, 2), ("a", "save", 7, "in_progress", 3), ("b", "save", 9, "in_progress", 1), ("b", "reset", None, None, 4), ("c", "reset", None, None, 1), ("d", "save", 3, "completed", 1), (None, "save", None, "in_progress", 1)]
    df = spark.createDataFrame(log, "k string, kind string, off int, status string, n int")
    saved = intake.checkpoints(df, ["k"], "kind", ["off"], ["n"])
    assert {r.k: (r.off, r.status, r.changed.n) for r in saved.collect()} == {"a": (7, "in_progress", 3), "b": (9, "reset", 4), "d": (3, "completed", 1), None: (None, "in_progress", 1)}
    assert {r.k: r.off for r in intake.resume_point(saved, {"off": F.lit(0)}).collect()} == {"a": 7, "b": 0, "d": 0, None: None}
    assert intake.checkpoints(df.limit(0), ["k"], "kind", ["off"], ["n"]).count() == 0


def test_spider_of_many_hops(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1), (2, 5), (5, 6), (6, 7), (4, 8), (3, 3), (1, 2)], "source int, target int")
    got = {r.vertex: r.hop for r in graph.bounded_bfs(edges, spark.createDataFrame([(1,), (1,)], "vertex int"), 3, per_vertex=2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 5: 2, 6: 3}
