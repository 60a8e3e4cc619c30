"""Secret scans against plain Python: spans of every kind, and texts that are hard on pattern matchers."""

import math
import random
import re
import time
from collections import Counter

import pytest

from tidemark.llm import secrets

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: a run of letters and signs that is words only, piece by piece
WORD = re.compile(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[A-Z]?|[A-Z]+")


def allowed(span):
    if re.fullmatch(r"[A-Za-z+/_=-]*", span) and all(WORD.fullmatch(p) for p in re.findall("[A-Za-z]+", span)):
        return True
    return any(re.search(p, span) for p in secrets.ALLOW[1:])


def brute(t, window=20):
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{24,}", t)]
    hot = set()
    for pattern, _, bits in secrets.CLASSES.values():
        for m in re.finditer(pattern, t):
            entropy = lambda i: -sum(c / window * math.log2(c / window) for c in Counter(m[0][i : i + window]).values())  # noqa: E731, B023
            at = [i for i in range(len(m[0]) - window + 1) if entropy(i) >= bits]
            if at and not allowed(m[0][at[0] : at[-1] + window]):
                hot.add((m.start() + at[0], 3, m.start() + at[-1] + window))
    within = lambda x, y: y[0] <= x[0] and x[2] <= y[2]
    fresh = [x for x in hot if not any(within(x, b) for b in base) and not any(within(x, y) for y in hot if y != x)]
    return sorted(base + fresh)


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def hard(n, seed):
    rng = random.Random(seed)
    chunk = [
        lambda: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(15, 60))), lambda: "".join(rng.choice("abcdef0123456789") for _ in range(rng.randint(10, 50))),
        lambda: "".join(rng.choice("aab0") for _ in range(rng.randint(10, 50))), lambda: rng.choice(["é日本 ", "\n", " ", " x ", "= ", "😀"]), lambda: "token=" + "".join(rng.choice(ALPHABET) for _ in range(rng.randint(3, 30))),
        lambda: "AKIA" + "".join(rng.choice("ABC19") for _ in range(rng.randint(10, 30))), lambda: rng.choice(["CamelCaseWords", "plain", "UPPER", "example", "-", "_"]) * rng.randint(1, 4),
    ]
    return ["".join(rng.choice(chunk)() + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("block", [512, 2])
def test_spans_and_redaction(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "BLOCK", block)
    texts = hard(150, block) + ["", "x", "token=abcdef token=abcdef " * 40]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    found = 0
    for r in secrets.scan(df).collect():
        want = brute(texts[r.doc_id])
        assert r.spans == listed(want), texts[r.doc_id]
        found += sum(k == 3 for _, k, _ in want)
    assert found > 100
    for r in secrets.redact(df).collect():
        t, out, at = texts[r.doc_id], "", 0
        for s, _, e in brute(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == out + t[at:]


def test_allow_list_of_words(spark):
    """The possessive pattern takes the same spans as the words taken one by one."""
    rng = random.Random(6)
    spans = ["".join(rng.choice("aAbB-_0") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(s,) for s in spans], "s string").selectExpr("s", f"s rlike {secrets._quoted(secrets.ALLOW[0])} as ok")
    for r in df.collect():
        assert r.ok == (re.fullmatch(r"[A-Za-z+/_=-]*", r.s) is not None and all(WORD.fullmatch(p) for p in re.findall("[A-Za-z]+", r.s))), r.s


def test_long_candidates_end_soon(spark):
    """Joined words, camel case, a megabyte of base64 and ten thousand spans: no recursion, time linear in them."""
    rng = random.Random(2)
    image = "".join(rng.choice(ALPHABET) for _ in range(1_000_000))
    texts = {
        "joined": ("Quartz-Vexing-Jumbo-" * 5000, 0), "camel": ("QuartzVexingJumbo" * 6000, 0), "upper": ("A" * 100_000, 0), "image": (image, 1),
        "spans": ("é password=abcdef1 " * 10_000, 0), "hot": (" ".join(image[i : i + 30] for i in range(0, 300_000, 30)), None),
    }
    secrets.scan(spark.createDataFrame([(0, "warm up")], "doc_id long, text string")).collect()
    for name, (text, entropy) in texts.items():
        began = time.perf_counter()
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        (r,) = secrets.scan(df).collect()
        (cut,) = secrets.redact(df).collect()
        assert time.perf_counter() - began < 90, name
        assert entropy is None or r.n_entropy == entropy
        assert (r.n_assign, cut.text == text) == ((10_000, False) if name == "spans" else (0, name in ("joined", "camel", "upper")))
