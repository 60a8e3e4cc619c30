"""Secret scans with SQL functions only: keyword, key-id and hex patterns, and windowed entropy.

Spans come from splitting a text by a pattern and laying the pieces and matches end to end,
which gives code point and byte positions without leaving the JVM. The entropy scan takes runs
of one character class, slides a window over each and keeps the counts of its characters, packed
into a few longs, and the sum of c * log2 c up to date by one removal and one addition a step.
All is linear in the text, its candidates and its spans: running sums and maxima go by blocks,
characters of a candidate are read by byte, and no pattern makes the matcher recurse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# runs of this class cannot overlap, so asking for the length at once finds the same matches
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: class: (candidate pattern, alphabet, bits per character that a window must reach)
CLASSES = {
    "hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 3.0),
    "base64": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
}
#: spans that match one of these are not reported by the entropy scan: words (in camel case or joined by signs), numbers, keys with "example" in them, one character over and over, UUIDs
#: the loop over words is possessive, so that the matcher walks it without recursion; what it takes could not be read in another way
ALLOW = (
    r"^(?:[+/_=-]++|(?<![A-Za-z])(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+[A-Z]?+|[A-Z]++)(?![A-Za-z]))*+$",
    r"^[0-9+/_=-]*$", r"(?i)[a-z0-9+]example|example[a-z0-9+]", r"^(.)\1+$", r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
)
_NONE = "cast(array() as array<struct<start:int,kind:int,end:int,byte:int>>)"
_LONGS = "cast(array() as array<bigint>)"
#: values of a running sum or maximum that are folded together
BLOCK = 512
#: c * log2 c is kept in whole units of 2^-32, so that a window's sum does not depend on the windows before it
UNIT = 1 << 32


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(values: str, op: str, zero: str) -> str:
    """array<bigint>: for each value, those before it folded by ``op`` (of acc_ and x_), in blocks so that no long array is copied again and again."""

    def fold(of: str, start: str) -> str:
        step = _let("acc_", "s_.at", f"named_struct('at', {op}, 'out', array_append(s_.out, acc_))")
        return f"aggregate({of}, named_struct('at', cast({start} as bigint), 'out', {_LONGS}), (s_, x_) -> {step}, s_ -> s_.out)"

    cut = f"transform(sequence(0, cast((size(v_) - 1) div {BLOCK} as int)), k_ -> slice(v_, k_ * {BLOCK} + 1, {BLOCK}))"
    sums = f"transform(b_, y_ -> aggregate(y_, cast({zero} as bigint), (acc_, x_) -> {op}))"
    blocks = _let("b_", cut, _let("o_", fold(sums, zero), f"flatten(transform(b_, (y_, k_) -> {fold('y_', 'o_[k_]')}))"))
    return _let("v_", values, f"if(size(v_) = 0, {_LONGS}, {blocks})")


def _matches(text: str, pattern: str) -> str:
    """array<struct<start, byte, m, v>>: every leftmost non-overlapping match, where it begins, and its group 2 where it has one."""
    q = _quoted(pattern)
    ends = lambda size: _before(f"transform(m_, (x, i) -> cast({size}(g_[i]) + {size}(x) as bigint))", "acc_ + x_", "0")
    groups = f"regexp_extract_all({text}, {q}, 2)" if pattern is ASSIGN else "m_"
    out = "transform(m_, (x, i) -> named_struct('start', cast(c_[i] + length(g_[i]) as int), 'byte', cast(u_[i] + octet_length(g_[i]) as int), 'm', x, 'v', w_[i]))"
    for name, value in (("w_", groups), ("u_", ends("octet_length")), ("c_", ends("length")), ("g_", f"split({text}, {q}, -1)"), ("m_", f"regexp_extract_all({text}, {q}, 0)")):
        out = _let(name, value, out)
    return out


def _base(text: str, pattern: str, kind: int, least: int) -> str:
    spans = f"transform(filter({_matches(text, pattern)}, x -> length(x.v) >= {least}), x -> named_struct('start', x.start, 'kind', {kind}, 'end', x.start + length(x.m), 'byte', x.byte))"
    return f"if({text} rlike {_quoted(pattern)}, {spans}, {_NONE})"


def _hot(candidate: str, alphabet: str, bits: float, window: int) -> str:
    """struct(first, last): from the first to the last window of the candidate with enough entropy; nulls if none.

    The counts of the window's characters are kept in longs of ``per`` counts each.
    """
    wide = window.bit_length()
    per = 60 // wide
    of = [round(n * math.log2(n) * UNIT) if n else 0 for n in range(window + 2)]
    f = f"array({', '.join(f'{x}L' for x in of)})"
    most = math.floor(window * (math.log2(window) - bits) * UNIT)
    word, shift = (lambda c: f"cast({c} div {per} as int)"), (lambda c: f"{wide} * ({c} % {per})")
    code = lambda i: f"(locate(cast(substring(b, {i} + 1, 1) as string), '{alphabet}') - 1)"
    count = lambda n, c: f"cast(shiftright({n}[{word(c)}], {shift(c)}) & {(1 << wide) - 1}L as int)"
    state = lambda n, e: f"named_struct('n', {n}, 'e', {e}, 'first', s.first, 'last', s.last)"
    changed = lambda n, c, by: f"transform({n}, (w, j) -> if(j = {word(c)}, w {by} shiftleft(1L, {shift(c)}), w))"
    less = _let("o", code(f"i - {window}"), _let("n", count("s.n", "o"), state(changed("s.n", "o", "-"), f"s.e - {f}[n] + {f}[n - 1]")))
    more = _let("k", code("i"), _let("n", count("t.n", "k"), state(changed("t.n", "k", "+"), f"t.e - {f}[n] + {f}[n + 1]")))
    hot = f"i >= {window - 1} and u.e <= {most}L"
    judged = f"named_struct('n', u.n, 'e', u.e, 'first', if({hot}, coalesce(u.first, i - {window - 1}), u.first), 'last', if({hot}, i + 1, u.last))"
    start = f"named_struct('n', cast(array_repeat(0L, {-(-len(alphabet) // per)}) as array<bigint>), 'e', 0L, 'first', cast(null as int), 'last', cast(null as int))"
    step = _let("t", f"if(i < {window}, s, {less})", _let("u", more, judged))
    folded = f"aggregate(sequence(0, length({candidate}) - 1), {start}, (s, i) -> {step}, s -> named_struct('first', s.first, 'last', s.last))"
    return _let("b", f"cast({candidate} as binary)", folded)


def _entropy(text: str, classes: dict, allow: tuple[str, ...], window: int) -> str:
    found = []
    for pattern, alphabet, bits in classes.values():
        suppressed = " or ".join(f"substring(x.m, x.w.first + 1, x.w.last - x.w.first) rlike {_quoted(a)}" for a in allow) or "false"
        hot = f"transform({_matches(text, pattern)}, x -> named_struct('start', x.start, 'byte', x.byte, 'm', x.m, 'w', {_hot('x.m', alphabet, bits, window)}))"
        # the candidates are ASCII, so characters are bytes within them
        span = "named_struct('start', x.start + x.w.first, 'kind', 3, 'end', x.start + x.w.last, 'byte', x.byte + x.w.first)"
        found.append(f"if({text} rlike {_quoted(pattern)}, transform(filter({hot}, x -> x.w.first is not null and not ({suppressed})), x -> {span}), {_NONE})")
    return f"concat({', '.join(found)})"


def _uncovered(base: str, hot: str) -> str:
    """Base spans and those entropy spans that no other span covers: in order of start, the longest first, none before it ends as late."""
    ordered = f"array_sort(transform(concat({base}, {hot}), x -> named_struct('start', x.start, 'less', -x.end, 'kind', x.kind, 'byte', x.byte)))"
    latest = _before("transform(a_, x -> cast(-x.less as bigint))", "greatest(acc_, x_)", "-1")
    kept = "transform(filter(a_, (x, i) -> x.kind < 3 or l_[i] < -x.less), x -> named_struct('start', x.start, 'kind', x.kind, 'end', -x.less, 'byte', x.byte))"
    return f"array_sort({_let('a_', ordered, _let('l_', latest, kept))})"


def with_spans(
    df: DataFrame, text_col: str = "text", into: tuple[str, str] = ("base_spans", "spans"), classes: dict = CLASSES, allow: tuple[str, ...] = ALLOW, window: int = WINDOW
) -> DataFrame:
    """``df`` with two arrays of struct(start, kind, end, byte), sorted, named by ``into``.

    ``kind`` indexes KINDS; positions are code points, ``end`` is exclusive, ``byte`` is where the
    span begins in UTF-8. The first has the three patterns' matches; the second adds entropy
    spans that no base span covers and no other entropy span repeats. A null or empty text has
    none; long texts, candidates and lists of spans are scanned whole, in time linear in them.
    Repeated rows come back as often; an empty table stays empty. Other columns stay as they
    are, but for those named like ``into``. Classes are of ASCII characters.
    """
    base_spans, spans = (f"`{c}`" for c in into)
    hot = free_name(df, "hot_spans")
    t = f"coalesce(`{text_col}`, '')"
    base = f"array_sort(concat({_base(t, ASSIGN, 0, 6)}, {_base(t, ACCESS, 1, 20)}, {_base(t, HEX, 2, 24)}))"
    df = df.withColumns({into[0]: F.expr(base), hot: F.expr(_entropy(t, classes, allow, window))})
    return df.withColumn(into[1], F.expr(f"if(size({hot}) = 0, {base_spans}, {_uncovered(base_spans, hot)})")).drop(hot)


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind], x.start, x.end)), ',')")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: counts of the base spans, their digest, and all spans as text.

    Every row comes back, repeated ones as often; null and empty texts have no span. Extra
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", **options)
    count = lambda k: F.expr(f"cast(size(filter(base_spans, x -> x.kind = {k})) as bigint)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(_listed("base_spans"), "UTF-8"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
        F.expr("cast(size(filter(spans, x -> x.kind = 3)) as bigint)").alias("n_entropy"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; null texts stay null.

    Texts without spans, and all other columns whatever their names, stay as they are. Repeated
    rows come back as often; an empty table stays empty.
    """
    columns = docs.columns
    base, spans = free_name(docs, "base_spans"), free_name(docs, "spans")
    found = with_spans(docs, text_col, (base, spans), **options)
    ends = "transform(a_, x -> cast(x.byte + x.end - x.start as bigint))"
    piece = f"concat(cast(substring(t_, cast(l_[i] + 1 as int), cast(a_[i].byte - l_[i] as int)) as string), '{mark}')"
    kept = f"array_join(transform(filter(sequence(0, size(a_) - 1), i -> a_[i].byte >= l_[i]), i -> {piece}), '')"
    cut = f"concat({kept}, cast(substring(t_, cast(array_max(e_) + 1 as int)) as string))"
    for name, value in (("l_", _before("e_", "greatest(acc_, x_)", "0")), ("e_", ends), ("a_", f"`{spans}`"), ("t_", f"cast(`{text_col}` as binary)")):
        cut = _let(name, value, cut)
    return found.withColumn(text_col, F.expr(f"if(size(`{spans}`) = 0, `{text_col}`, {cut})")).select(*[f"`{c}`" for c in columns])
