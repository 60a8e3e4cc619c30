"""Shards, ranked search and fill-in-the-middle against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, lexical, sharding

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé日😀\x01\x02019<>PSM-_.") for _ in range(rng.randint(1, 5)))
    space = lambda: "".join(rng.choice(" \t\n\x0b\x0c\r") for _ in range(rng.randint(1, 3)))
    hard = [None, "", " \n\t ", "one", " one", "one ", "\x01", "\x02", "\x020\x021\x01", "\x02 1\x01 0", "a<P>b", "<S>", "x <M", "< P>", "  x\u0085y", "$0 \\1 $", "é日本 " * 50, " " * 30_000, "w " * 20_000, "x" * 50_000]
    return hard + ["".join(word() + space() for _ in range(rng.randint(1, 40))) for _ in range(120)]


def brute_fim(i, t, seed=42):
    t = t or ""
    u = UNIT.findall(t)
    n, h = len(u), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fim(spark):
    rows = [(i, t) for i, t in enumerate(texts() * 3)] + [(None, "a b c d"), (-5, "a b c d"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, fim_text int, head string, sha string")
    got = fim.transform(df)
    assert got.columns[:5] == df.columns
    got = got.withColumn("restored", fim.restore(F.col("fim_output"), F.col("fim_form"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    forms = Counter()
    for r, (i, t) in zip(sorted(got, key=lambda r: key((r.doc_id, r.text))), sorted(rows, key=key), strict=True):
        assert (r.fim_n, r.fim_form, r.fim_prefix, r.fim_middle, r.fim_suffix, r.fim_output) == brute_fim(i, t), (i, t)
        assert r.restored == (t or "") and (r.fim_text, r.head, r.sha) == (1, "x", "y")
        forms[r.fim_form] += 1
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 10


def test_fim_digests_and_parameters(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in fim.digests(df).collect():
        n, form, p, m, _, out = brute_fim(*rows[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert (r.output_sha256, r.restored_sha256) == (sha(out), sha(rows[r.doc_id][1] or ""))
    assert fim.digests(df.limit(0)).count() == 0
    assert {r.fim_form for r in fim.transform(df, fim_percent=0).collect()} == {"plain"}
    own = fim.transform(df.filter("length(text) > 0"), fim_percent=100, spm_percent=0, markers=("[pre]", "[suf]", "[mid]")).collect()
    assert all(r.fim_form == "psm" and r.fim_output == f"[pre]{r.fim_prefix}[suf]{r.fim_suffix}[mid]{r.fim_middle}" and r.fim_prefix + r.fim_middle + r.fim_suffix == r.text for r in own)


def test_fim_very_long_text(spark):
    """A million units and ten million characters in one word: cut whole, without recursion."""
    long = [(i, t) for i, t in enumerate(["ab " * 1_000_000, "x" * 10_000_000 + " y", "\x01" * 1_000_000])]
    df = spark.createDataFrame(long, "doc_id long, text string")
    for r in fim.transform(df, fim_percent=100).withColumn("restored", fim.restore(F.col("fim_output"), F.col("fim_form"))).collect():
        t = long[r.doc_id][1]
        assert r.restored == t and r.fim_prefix + r.fim_middle + r.fim_suffix == t and r.fim_n == (1_000_001, 2, 1)[r.doc_id]


def brute_shards(rows, shards=16, seed=42):
    """(place, row) in order of the fractional ranks."""
    number = lambda x, digits: int(hashlib.sha256(x.encode()).hexdigest()[:digits], 16)
    none = lambda x: "" if x is None else str(x)
    by = {}
    for i, t, s in rows:
        size, crc = len((t or "").encode()) + 1, zlib.crc32((t or "").encode())
        by.setdefault(s, []).append((number(f"{seed}:{none(i)}:{size}:{crc}", 15), i is not None, i or 0, i, size, crc))
    order = []
    for s, members in by.items():
        u = number(f"{seed}:{none(s)}", 13) / float(1 << 52)
        order += [((k + u) / len(members), s is not None, s or "", m[3:]) for k, m in enumerate(sorted(members))]
    order.sort(key=lambda x: x[:3])
    n, out = len(order), []
    for pos, (*_, m) in enumerate(order):
        shard = next(s for s in range(shards) if s * n // shards <= pos < (s + 1) * n // shards)
        out.append((*m, shard, pos - shard * n // shards))
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 17, 400])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, k, k // 2]), rng.choice([None, "", "é日", "x" * rng.randrange(50)]), rng.choice([None, "", "hot", "hot", "hot", "b", f"s{k}"])) for k in range(n)]
    df = spark.createDataFrame([(i, t, s, 1, "z") for i, t, s in rows], "doc_id long, text string, source string, shard int, share string").repartition(3)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign(df).collect()]
    none_first = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=none_first) == sorted(brute_shards(rows), key=none_first)
    rode = sharding.interleave(df, "source", ("doc_id",), shards=4)
    assert rode.columns == ["doc_id", "text", "source", "share", "shard", "slot"]
    back = rode.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in back) == Counter(rows)
    counts = Counter(r.shard for r in back)
    assert all(sorted(r.slot for r in back if r.shard == s) == list(range(counts[s])) for s in counts)
    assert max((counts[s] for s in range(4)), default=0) - min(counts[s] for s in range(4)) <= 1


def test_shards_match_the_mixture(spark):
    """Each source's count in a shard is its share, but for two rows; a source of one row each is spread by chance."""
    rows = [(i, "hot" if i % 3 else f"s{i % 7}" if i % 2 else f"t{i % 11}") for i in range(6000)]
    back = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), shards=8).collect()
    by, total = Counter((r.shard, r.source) for r in back), Counter(s for _, s in rows)
    for s, n in total.items():
        assert all(abs(by[k, s] - n / 8) <= 2 for k in range(8)), s
    rows = [(i, "hot" if i % 3 else f"one{i}") for i in range(3000)]
    back = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), shards=8).collect()
    single = Counter(r.shard for r in back if r.source != "hot")
    assert all(abs(single[k] - 125) <= 3 * 125**0.5 for k in range(8))
    # a copy of the whole table under one id and one source
    same = sharding.interleave(spark.createDataFrame([(1, "a")] * 1000, "doc_id long, source string"), shards=3)
    assert Counter(r.shard for r in same.collect()) == {0: 333, 1: 333, 2: 334}


def test_shards_written(spark, tmp_path):
    rows = [(i, f"t{i}", "ab"[i % 2]) for i in range(200)]
    done = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4)
    sharding.write_shards(done, str(tmp_path / "out"), 8)
    for k in range(4):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(50))


def brute_search(docs, items, k=10):
    words = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = []
    for item, t in items:
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in words(t) if c[x])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_bytes", "block", "room"), [(8 << 20, 100_000, 1_000_000), (60, 3, 5)])
def test_lexical(spark, monkeypatch, shard_bytes, block, room):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "ROUND_TERMS", room)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "The", "tHE", "é", "É", "日本", "x1", "İ", "zebra", "q" * 300, "0", "K", "kelvinK"])
    sep = lambda: rng.choice([" ", "-", "\n", "_", ".", "\x00", "\x7f", "'"])
    text = lambda n: "".join(word() + sep() for _ in range(n))
    docs = [(i, text(rng.randint(1, 12))) for i in range(60)] + [(None, "zebra"), (None, "zebra zebra"), (5, "zebra"), (5, "zebra"), (80, None), (81, ""), (82, "-- ."), (90, "end"), (91, "end"), (92, "rare " * 5000)]
    items = [(i, text(rng.randint(1, 8))) for i in range(12)] + [(12, None), (13, ""), (14, "..."), (15, "unknown"), (16, "end"), (17, "zebra ZEBRA"), (17, "rare")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, query int, df string").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    got = lexical.search(lexical.build(d, shard_bytes=shard_bytes), q).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute_search(docs, items)
    assert lexical.search(lexical.build(d.limit(0)), q).count() == 0
    assert lexical.search(lexical.build(d), q.limit(0)).count() == 0


def test_lexical_ties_at_the_border(spark):
    """More documents of equal score than places: the smallest ids, over many shards."""
    docs = [(i, "tie word") for i in range(500, 0, -1)] + [(1000 + i, "other text here") for i in range(700)]
    got = lexical.search(lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), shard_bytes=100), spark.createDataFrame([(1, "tie")], "item_id long, text string"))
    assert [(r["rank"], r.doc_id) for r in got.orderBy("rank").collect()] == [(k, k) for k in range(1, 11)]


def test_top_k_in_rounds(spark, monkeypatch):
    """Query tiles that need a round each give the rows of one round."""
    from tidemark.llm import topk

    rng = random.Random(12)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4 if i % 9 else 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    read = lambda x: sorted(tuple(r) for r in x.collect())
    want = read(topk.top_k(df, "vec_id % 3 = 0", k=5))
    monkeypatch.setattr(topk, "ROUND_BYTES", 1)
    assert read(topk.top_k(df, "vec_id % 3 = 0", k=5, query_tile=16, shard=40)) == want and len(want) == 500
    assert topk.top_k(df, "vec_id < 0").count() == 0
