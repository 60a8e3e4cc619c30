"""JSON lists, identities, contact links, recommendations, summaries of forwards and queues against written-out rows."""

import time

from pyspark.sql import functions as F

from tidemark.functions import names, text
from tidemark.operators import messages, schedule


def values(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_json_list(spark):
    cases = ['["a",1,null,{"k":[2]},true]', '"[\\"a\\",[1]]"', "[]", '""', '"a"', '{"a":[1]}', "[1", "7", "", None]
    got = dict(zip(cases, values(spark, cases, text.json_list), strict=True))
    assert got[cases[0]] == ["a", "1", None, '{"k":[2]}', "true"] and got[cases[1]] == ["a", "[1]"]
    assert all(got[x] == [] for x in cases[2:])


def test_canonical_identity(spark):
    cases = [
        ("telegram", "https://t.me/@Some_Room/?a=1", "telegram:some_room"), (" Telegram", "@@name ", "telegram:name"), ("telegram", "https://www.telegram.me/joinchat/AbC", "telegram:joinchat/abc"), ("telegram", "https://t.me/", ""),
        ("tiktok", "HTTPS://TikTok.com/@User/video/1?x", "tiktok:user"), ("facebook", "https://m.facebook.com/groups/G1/posts", "facebook:g1"), ("facebook", "pages/Name/77/", "facebook:77"), ("facebook", "Page/about", "facebook:page"),
        ("facebook", "groups/", "facebook:groups"), ("web", "https://www.Site.org:80/A/b//?q", "web:site.org:80/A/b"), ("web", "site.org", "web:site.org"), ("forum", " Nick ", "forum:nick"), ("web", "", ""), ("web", None, ""), (None, "x", ":x"),
    ]
    df = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(cases)], "i int, p string, x string")
    got = [r.y for r in df.select("i", names.canonical_identity(F.col("p"), F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [want for _, _, want in cases]


def test_contact_links(spark):
    got = values(spark, ["https://x.com/a https://one.org, https://linktr.ee/b https://two.org https://x.com/a https://linktr.ee/b https://t.me/c", "", None, "plain"], messages.contact_links)
    assert [tuple(x) for x in got[0]] == [("social", "https://x.com/a", 90), ("website", "https://one.org", 90), ("linktree", "https://linktr.ee/b", 95), ("linktree", "https://linktr.ee/b", 95)]
    assert got[1:] == [[], [], []]


def test_recommendations(spark):
    rows = [("Own", "Best", False), ("Own", "best", None), ("Own", "OWN", False), ("Own", None, False), ("Own", " ", False), ("Own", "bad", True), (None, "best", False)]
    df = spark.createDataFrame(rows, "s string, t string, bad boolean")
    got = sorted((tuple(r) for r in messages.recommendation_edges(df, "s", "t", F.col("bad")).collect()), key=str)
    assert got == [("Own", "best", "recommendation", 90), (None, "best", "recommendation", 90)]
    assert messages.recommendation_edges(df.limit(0), "s", "t", F.col("bad")).count() == 0


def test_forward_summary(spark):
    origin = "struct<name:string,channel_id:string,peer_id:string>"
    rows = [("a", i, x) for i, x in enumerate([("N", "1", "1"), ("", "7", "8"), (None, None, "9"), (None, None, None), ("N", "2", "2"), ("f", None, None), ("g", None, None), None])]
    rows += [("b", 100, None), (None, 101, ("N", None, None))] + [("hot", 200 + i, ("even" if i % 2 == 0 else f"o{i}", None, None)) for i in range(2000)]
    df = spark.createDataFrame(rows, f"k string, i int, o {origin}")
    got = {r.k: (r.messages, r.forwarded, r.ratio, [tuple(x) for x in r.origins]) for r in messages.forward_summary(df, "k", F.col("o"), "i").collect()}
    assert got["a"] == (8, 7, 0.875, [("N", 2), ("7", 1), ("9", 1), ("unknown", 1), ("f", 1)])
    assert got["b"] == (1, 0, 0.0, []) and got[None] == (1, 1, 1.0, [("N", 1)])
    assert got["hot"] == (2000, 2000, 1.0, [("even", 1000), ("o1", 1), ("o3", 1), ("o5", 1), ("o7", 1)])
    assert messages.forward_summary(df.limit(0), "k", F.col("o"), "i").count() == 0


def test_queues(spark):
    assert values(spark, ["LOW", "MEDIUM", "HIGH", "low", "", None], schedule.queue_of_risk) == ["high", "normal", "low", "low", "low", "low"]
    assert values(spark, ["Ads", "ads", "other", "", None], lambda x: schedule.queue_of_seed(x, ("ads",))) == ["high", "high", "normal", "normal", "normal"]


def test_mentions_in_a_long_text(spark):
    """A megabyte without a trigger, and one whose trigger stands at the end."""
    began = time.perf_counter()
    long = "word @abcd " * 90_000
    assert values(spark, [long, long + "\n" + "x" * 200 + "\nsupport\n@abcd"], lambda x: messages.contact_mention(x, F.lit("@abcd"), "support")) == [False, True]
    assert time.perf_counter() - began < 60
