"""Merged tables, the learning cycle, identities and dead letters against plain Python."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import identity, learning
from tidemark.sources import io, versions
from tidemark.streaming import streams

YIELDS = "source string, total long, hq long, quality int, last_seen int"


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_merge_copies_touched_buckets_only(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "t"), "source", YIELDS, buckets=8)
    assert t.read().count() == 0 and t.folders() == (0, {})
    rng, want = random.Random(1), {}
    for number in range(1, 5):
        finds = [(rng.choice([f"s{i}" for i in range(40)] if number < 3 else ["s1", "s2", "new"]), rng.randrange(5), number) for _ in range(100)]
        finds = {s: (sum(1 for x in finds if x[0] == s), sum(x[1] == 0 for x in finds if x[0] == s), number) for s, _, _ in finds}
        for s, (n, hq, last) in finds.items():
            old = want.get(s, (0, 0, 0))
            want[s] = (old[0] + n, old[1] + hq, last)
        before = files(tmp_path)
        delta = spark.createDataFrame([(s, *v) for s, v in finds.items()] + [(None, 1, 1, 1)], "source string, total long, hq long, last_seen int")
        assert t.merge(delta, versions.yields) == number
        got = {r.source: (r.total, r.hq, r.last_seen) for r in t.read().collect()}
        assert got == want and all(r.quality == r.hq * 100 // r.total for r in t.read().collect())
        after = files(tmp_path)
        assert all(after.get(p) == at for p, at in before.items())
        if number > 2:
            touched = {r[0] for r in delta.dropna().select(F.pmod(F.xxhash64("source"), F.lit(8))).distinct().collect()}
            kept, now = t.folders(number - 1)[1], t.folders()[1]
            assert {b for b in now if now[b] != kept.get(b)} == touched and len(touched) < 8
    assert t.merge(delta.limit(0), versions.yields) == 4
    assert {r.source for r in t.read(2).collect()} == {s for s in want if s != "new"}  # older versions stay


def test_a_failed_merge_publishes_nothing(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "t"), "source", YIELDS, buckets=4)
    delta = spark.createDataFrame([("a", 1, 0, 1)], "source string, total long, hq long, last_seen int")
    t.merge(delta, versions.yields)
    broken = lambda base, new: versions.yields(base, new).withColumn("quality", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        t.merge(delta, broken)
    assert [tuple(r) for r in t.read().collect()] == [("a", 1, 0, 0, 1)]
    assert t.merge(delta, versions.yields) == 2 and t.read().first().total == 2
    with pytest.raises(ValueError, match="another writer"):
        t.publish(2, {})


def test_learning_resumes(spark, tmp_path):
    """A round that fails between its two versions goes on after the first; rounds that are complete are not run again."""
    docs = [(i, f"gold pips {'scam ' if i % 4 == 0 else ''}word{i % 3}", i % 4 > 0) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, positive boolean")
    tokens, bad = T.tokens(F.col("text")), df.filter("doc_id % 20 = 0")
    whole, broken = (versions.VersionedTable(spark, str(tmp_path / x), "value", learning.MODEL, buckets=4) for x in ("whole", "broken"))
    for number in (1, 2):
        part = df.filter(F.col("doc_id") % 2 == number - 1)
        want = learning.cycle(whole, number, part, bad, tokens, "doc_id")
    one = df.filter("doc_id % 2 = 0")
    with pytest.raises(Exception, match="lost"):
        learning.cycle(broken, 1, one, bad.withColumn("text", F.raise_error(F.lit("lost")).cast("string")), tokens, "doc_id")
    assert broken.folders()[0] == 1
    for number in (1, 2):
        got = learning.cycle(broken, number, df.filter(F.col("doc_id") % 2 == number - 1), bad, tokens, "doc_id")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(got) == rows(want) and rows(want) and broken.folders()[0] == 4
    assert rows(learning.cycle(broken, 1, df.limit(0), bad.limit(0), tokens, "doc_id")) == rows(learning.in_use(broken, 2))
    empty = versions.VersionedTable(spark, str(tmp_path / "empty"), "value", learning.MODEL)
    assert learning.cycle(empty, 1, df.limit(0), bad.limit(0), tokens, "doc_id").count() == 0 and empty.folders()[0] == 2


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"chain": [(f"{i:03}", f"{i + 1:03}") for i in range(120)], "star": [("hub", f"x{i}") for i in range(300)], "random": [(str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(60)], "empty": []}[shape]
    rng.shuffle(edges)
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if shape != "chain" and all(root[a] == root[b] for a, b in edges):
            break
    for v in root:
        while root[root[v]] != root[v]:
            root[v] = root[root[v]]
    if shape == "chain":
        root = dict.fromkeys(root, "000")
    got = identity.components(spark.createDataFrame([*edges, (None, "lost"), ("self", "self")], "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == root | {"self": "self"}


def test_aliases_are_one_vertex(spark):
    """Two found rows that name one new vertex, by a chain of names; edges under different names are one."""
    rows = [
        (1, "id1", None, None, 5), (2, "id1", " Ann ", "Tele", 6), (3, None, "ann", "tele", 1), (4, "id2", "ANN", "TELE", 9), (5, None, "ann", "insta", 2), (6, "id3", "ann", "insta", 3),
        (7, None, None, "tele", 1), (8, "", " ", "tele", 1), (9, "id9", "bob", None, 4), (10, "id9", "Bob", "tele", 8),
    ]
    found = spark.createDataFrame(rows, "row int, cid string, nm string, pf string, seen int")
    got = {r.vertex: tuple(r)[1:] for r in identity.resolve(found, "row", "cid", "nm", "pf", "seen").collect()}
    assert got == {"c:id1": ("id1", "ann", "tele", 4, 1), "c:id3": ("id3", "ann", "insta", 2, 2), "c:id9": ("id9", "Bob", "tele", 2, 4)}
    links = spark.createDataFrame([(1, 5, 1, 70), (3, 6, 2, 90), (4, 9, 1, 98), (2, 10, 3, 10), (3, 4, 1, 50), (7, 1, 1, 50)], "src int, dst int, at int, trust int")
    edges = sorted(tuple(r) for r in identity.cross_edges(found, links, "row", "cid", "nm", "pf", "src", "dst", "at", "trust").collect())
    assert edges == [("c:id1", "c:id3", "tele", "insta", True, 2, 75, 2), ("c:id1", "c:id9", "tele", "tele", False, 2, 100, 3)]


def test_dead_letters_of_a_stream(spark, tmp_path):
    """Two sinks from one stream; a batch that is run again adds nothing, and the counts add up."""
    cases = ['{"k": 1}', '{"k": null, "other": 2}', "{}", None, "", "plain", "[1]", "3", '{"k": "x"}', '{"k": 1']
    schema = "i int, p string, at timestamp"
    for part in (0, 1):
        spark.createDataFrame([(i, x, datetime(2024, 1, 1)) for i, x in enumerate(cases) if i % 2 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    assert streams.split_dead_letters(source, "p", "k int", "feed", "at", out) == {"good": 3, "dead": 7, "all": 10}
    read = lambda: (sorted((r.i, r.fields.k) for r in spark.read.parquet(f"{out}/good").collect()), sorted((r.reason, r.payload or "", r.source) for r in spark.read.parquet(f"{out}/dead").collect()))
    good, dead = read()
    assert good == [(0, 1), (1, None), (2, None)]
    assert dead == sorted([("missing", "", "feed"), ("no JSON", "", "feed"), ("no JSON", "plain", "feed"), ("no JSON", '{"k": 1', "feed"), ("no object", "[1]", "feed"), ("no object", "3", "feed"), ("does not fit the schema", '{"k": "x"}', "feed")])
    # the last commit is lost: its batch runs again
    last = max((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    again = streams.split_dead_letters(source, "p", "k int", "feed", "at", out)
    assert again["all"] == 5 and read() == (good, dead)
    assert io.envelopes(spark.createDataFrame([(0, json.dumps({"k": 1}), datetime(2024, 1, 1))], schema), "p", "k int", "feed", "at").count() == 0
